"""Interleaved documents: ordered text and media references, and the media they point to.

HTML is parsed to a sequence of structs (position, kind, text, ref, caption). A media store
holds payloads by digest; references find them by a join on the digest, row by row, so a
position and its caption stay with their payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, strings, utf8

#: Bytes in an image row; payloads are padded with bytes 0 to a positive multiple of it.
ROW = 64
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEM_SQL = "array<struct<position int, kind string, text string, ref string, caption string>>"
_PNG = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_RAW, _HIDDEN = {"script", "style"}, {"template", "noscript"}


class _Interleaver(HTMLParser):
    """Collects text runs and media references in page order; a caption goes to the media of the figure around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.raw = 0
        self.hidden: list[tuple[str, int, list[str], int]] = []  # what there was when a template began
        self.figures: list[dict] = []
        self.caption: list[str] | None = None
        self.picture: str | None = None
        self.in_picture = False

    def _flush(self) -> None:
        if text := " ".join(" ".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def _media(self, ref: str, alt: str | None) -> None:
        self._flush()
        item = {"kind": "media", "text": None, "ref": ref, "caption": alt or None}
        self.items.append(item)
        if self.figures:
            self.figures[-1]["items"].append(item)

    def _end_caption(self) -> None:
        if self.caption is not None and (text := " ".join(" ".join(self.caption).split())):
            self.figures[-1]["captions"].append(text)
        self.caption = None

    def _end_figure(self) -> None:
        self._end_caption()
        self._flush()
        figure = self.figures.pop()
        caption = " ".join(figure["captions"])
        for item in figure["items"]:
            item["caption"] = caption or item["caption"]
        if caption and not figure["items"]:  # of a table or a poem: text like any other
            self.words.append(caption)
            self._flush()
        if self.figures and not caption:
            self.figures[-1]["items"] += figure["items"]

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        ref = found.get("src") or (found.get("srcset") or "").strip().split(" ")[0].rstrip(",")
        if tag in _RAW:
            self.raw += 1
        elif tag in _HIDDEN:
            self.hidden.append((tag, len(self.items), list(self.words), len(self.figures)))
        elif tag == "figure":
            self._end_caption()
            self._flush()
            self.figures.append({"items": [], "captions": []})
        elif tag == "figcaption" and self.figures:
            self._end_caption()
            self.caption = []
        elif tag == "picture":
            self.in_picture, self.picture = True, None
        elif tag == "source" and self.in_picture:
            self.picture = self.picture or ref
        elif tag == "img" and self.in_picture:
            if ref := ref or self.picture:
                self._media(ref, found.get("alt"))
            self.in_picture, self.picture = False, None
        elif tag in _MEDIA and ref:
            self._media(ref, found.get("alt"))

    def handle_endtag(self, tag):
        if tag in _RAW:
            self.raw = max(0, self.raw - 1)
        elif tag in _HIDDEN and any(h[0] == tag for h in self.hidden):
            while self.hidden[-1][0] != tag:
                self.hidden.pop()
            _, count, words, depth = self.hidden.pop()
            gone = {id(i) for i in self.items[count:]}
            self.items, self.words, self.figures = self.items[:count], words, self.figures[:depth]
            for figure in self.figures:
                figure["items"] = [i for i in figure["items"] if id(i) not in gone]
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self.figures:
            self._end_figure()
        elif tag == "picture":
            if self.in_picture and self.picture:
                self._media(self.picture, None)
            self.in_picture, self.picture = False, None

    def handle_data(self, data):
        if not self.raw:
            (self.words if self.caption is None else self.caption).append(data)


def parse_items(html: str) -> list[dict]:
    """The ordered items of a page; positions count from 0.

    The captions of a figure, before or after its media, are those media's; outside of figures,
    and of figures without media, they are text. A picture is its image, by the first reference
    that it has. Scripts, styles and templates are left out, an unclosed template is not.
    """
    parser = _Interleaver()
    parser.feed(html)
    parser.close()
    while parser.figures:
        parser._end_figure()
    parser._flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, html: Column, id_col: str) -> DataFrame:
    """Parse pages: id and ``items``, the ordered structs of text and media references.

    A null or empty page has no items. Ids pass through, null and repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            items = [parse_items(h) for h in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.list_(ITEM))], names=[id_col, "items"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(pages[id_col].alias("id"), html.alias("html")).mapInArrow(run, f"`{id_col}` {kind}, items {ITEM_SQL}")


def to_image(payload: bytes) -> bytes:
    """A grey PNG of 8-bit samples, 64 a row, that holds the payload without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each begins with filter type 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The payload of an image that ``to_image`` made; checks every chunk's CRC."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, rows = 8, [], 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", data, 4)[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, ROW + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Height, mean, deviation and entropy of the samples, as one text."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(samples)
    spread = float((counts * (values - mean) ** 2).sum()) / len(samples)
    return f"rows={len(samples) // ROW};mean={mean:.4f};sd={spread ** 0.5:.4f};bits={-(share * np.log2(share)).sum():.4f}"


def padded(text: Column) -> Column:
    """The text as UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / ROW)).cast("int")
    return F.rpad(raw, rows * ROW, F.lit(b"\x00"))


def store_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """A media store of every distinct text: payload_sha256, n_bytes, media.

    It is written to the shared folder in one pass. Copies within a piece of a batch are
    stored once; copies further apart may be stored again, under the same digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = {}
            for raw in dict.fromkeys(utf8(batch, "text")):
                payload = raw + bytes(-len(raw) % ROW or (0 if raw else ROW))
                key = (hashlib.sha256(payload).hexdigest(), len(raw))
                if key not in found:
                    found[key] = to_image(payload)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64()), pa.array(list(found.values()), pa.binary())],
                names=["payload_sha256", "n_bytes", "media"],
            )

    store = docs.select(docs[text_col].alias("text")).mapInArrow(run, "payload_sha256 string, n_bytes long, media binary")
    return materialize(store, "media")


def describe_media(store: DataFrame) -> DataFrame:
    """Read stored media back: a row for each digest with what its bytes hold.

    Raises if a payload does not have the digest it is stored under.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("payload_sha256").to_pylist(), batch.column("media").to_pylist()):
                payload = from_image(image)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"stored media differs from its digest {digest}")
                rows.append((digest, len(payload), zlib.crc32(payload[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["payload_sha256", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    out = store.select("payload_sha256", "media").mapInArrow(
        run, "payload_sha256 string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.groupBy("payload_sha256").agg(*(F.max(c).alias(c) for c in names[1:]))  # equal where repeated


def resolve(sequences: DataFrame, media: DataFrame, id_col: str, prefix: str = "sha256:") -> DataFrame:
    """Give every media reference ``sha256:<digest>`` of interleaved documents its media row.

    One row per item: id, position, kind, text, caption, payload_sha256 and the columns of
    ``media``, null for text and for references that the store lacks. ``media`` has a row for
    each digest, so items keep their number, place and caption.
    """
    items = sequences.select(id_col, F.inline("items"))
    digest = F.when(F.col("ref").startswith(prefix), F.substring(F.col("ref"), len(prefix) + 1, 64))
    # References without a digest would all meet in one task: each gets a key of its own.
    none = F.concat(F.lit("none:"), F.xxhash64(id_col, "position").cast("string"))
    items = items.withColumn("join_key", F.coalesce(digest, none))
    media = media.withColumnRenamed("payload_sha256", "join_key")
    return items.join(media, "join_key", "left").withColumn("payload_sha256", digest).drop("join_key")


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep every text as media, read it back, and return what it holds, a row per document.

    Each document becomes a page whose figure refers to its payload by digest, with the length
    in bytes as the caption; the page is parsed, and the reference is resolved in the store. A
    null text counts as empty (64 bytes 0). Repeated rows give repeated results; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """
    media = materialize(describe_media(store_texts(docs, text_col)), "described")
    size = F.octet_length(F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8"))
    html = F.concat(
        F.lit('<figure><img src="sha256:'), F.sha2(padded(docs[text_col]), 256), F.lit('"><figcaption>'), size.cast("string"), F.lit("</figcaption></figure>")
    )
    found = resolve(interleave(docs, html, id_col), media, id_col)
    return found.select(
        id_col, F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )

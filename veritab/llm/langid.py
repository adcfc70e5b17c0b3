"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with texts of that language.
A text is compressed with every dictionary; the language whose dictionary makes it smallest
wins. Texts whose two best languages are too close are marked as rejected; how close that is
comes from labelled texts that no dictionary holds.

Dictionaries and texts are lower-cased and reduced to their letters. Long texts are compressed
in pieces, each on its own, so that the dictionary rather than the text's own beginning
explains its end; all pieces count.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held, materialize, pieces, strings

#: Labelled texts that are gathered for each language, about; the bound of the sample.
SAMPLE_PER_LANGUAGE = 400
#: Bytes in a dictionary, and characters of a text compressed at once.
DICTIONARY_BYTES, CHUNK = 32 << 10, 4000
#: Languages that one model may have; more raise an error.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Characters of the chunks that fill a dictionary, and bytes of those that are worth it.
DRAWN, SHORTEST_DRAWN = 128, 16
#: Labelled texts, about one in ``HELD_EVERY`` of a sample and in all languages ``HELD_TEXTS`` at
#: most, that set the margin: half of what all but ``HELD_SHARE`` of those told rightly have.
HELD_EVERY, HELD_TEXTS, HELD_SHARE = 5, 400, 0.01
#: Short matches tell languages apart.
_ZSTD = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 3, "search_log": 4, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's words of letters, lower-cased, one space between them."""
    return _OTHER.sub(" ", text.lower()).strip()


@dataclass
class Model:
    """The dictionaries by language, the commonest first, and the margin below which a text is rejected."""

    dictionaries: dict[str, bytes]
    min_margin: float = 0.0


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fill the dictionaries from a bounded sample of the ``usable`` labelled rows.

    Rows are drawn by a hash of their id and text, about ``SAMPLE_PER_LANGUAGE`` in each
    language whatever its share. Copies count once. A part of them stays out of the
    dictionaries and sets the margin. Whole texts are cut into chunks and classified in tasks;
    the driver gets the chunks that a dictionary has room for, and margins. Rows with null text
    or language are not used; without any the model is empty and every text is unknown. More
    than ``MAX_LANGUAGES`` languages raise ValueError, as every text is compressed with each
    dictionary.
    """
    rows = docs.where(usable & docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(docs[lang_col].alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({})
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(docs[lang_col] == lang, F.lit(SAMPLE_PER_LANGUAGE / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    sample = sample.withColumn("aside", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(HELD_EVERY)) == 0)
    sample = materialize(sample, "language-sample")
    # Where a language has no text on one of the sides, all its texts fill its dictionary.
    both = sample.groupBy("lang").agg((F.min("aside") != F.max("aside")).alias("both"))
    sample = sample.join(F.broadcast(both), "lang").select("lang", "text", (F.col("aside") & F.col("both")).alias("aside"))
    chunks = sample.where("not aside").mapInArrow(_chunks, "lang string, chunk binary, k int, crc long")
    distinct = chunks.groupBy("lang", "chunk").agg(F.min(F.struct("k", "crc")).alias("place"))
    order = Window.partitionBy("lang").orderBy("place", "chunk")
    ranked = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DICTIONARY_BYTES // SHORTEST_DRAWN)
    by_language: dict[str, list[bytes]] = {}
    for row in ranked.orderBy("lang", "rank").select("lang", "chunk").collect():
        by_language.setdefault(row["lang"], []).append(bytes(row["chunk"]))
    model = Model({lang: fill(by_language.get(lang, [])) for lang in sorted(counts, key=lambda lang: (-counts[lang], lang))})
    held_out = sample.where("aside").distinct().withColumn("crc", F.crc32(F.col("text").cast("binary"))).orderBy("crc", "lang", "text").limit(HELD_TEXTS)
    told = identify(held_out, model, id_col="lang", min_margin=0.0).where("lang = lang_pred and margin > 0 and margin < double('infinity')")
    right = sorted(r["margin"] for r in told.select("margin").collect())
    # Half the margin that nearly all texts have which the model tells rightly.
    model.min_margin = right[int(HELD_SHARE * len(right))] / 2 if right else 0.0
    return model


def drawn_chunks(text: str) -> list[tuple[bytes, int, int]]:
    """Distinct chunks of a text's letters by their hash: (chunk, place, hash), as many as a dictionary has room for."""
    small = letters(text)
    found = {small[i : i + DRAWN].encode("utf-8", "replace") for i in range(0, len(small), DRAWN)}
    ranked = sorted((zlib.crc32(c), c) for c in found if len(c) >= SHORTEST_DRAWN or len(found) == 1)
    return [(c, k, crc) for k, (crc, c) in enumerate(ranked[: DICTIONARY_BYTES // SHORTEST_DRAWN])]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        rows = [(lang, *c) for lang, text in zip(batch.column("lang").to_pylist(), strings(batch, "text")) for c in drawn_chunks(text)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "chunk", "k", "crc"])


def fill(chunks: list[bytes]) -> bytes:
    """A dictionary of chunks, the first ones at its end, where matches are cheapest."""
    out, room = [], DICTIONARY_BYTES
    for chunk in chunks:
        if room <= 0:
            break
        out.append(chunk)
        room -= len(chunk) + 1
    return b" ".join(reversed(out))[-DICTIONARY_BYTES:]


class Classifier:
    """Compressors made from a model; one for each worker."""

    def __init__(self, model: Model):
        self.languages = list(model.dictionaries)
        self.sizers = []
        plain = zstandard.ZstdCompressionParameters.from_level(3, **_ZSTD)
        for content in model.dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=plain)
            self.sizers.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=plain))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the margin as a share of the smallest size."""
        text = letters(text or "")
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        chunks = [text[i : i + CHUNK].encode("utf-8", "replace") for i in range(0, len(text), CHUNK)]
        sizes = [sum(len(s.compress(c)) for c in chunks) for s in self.sizers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.languages[0], 1.0, math.inf
        best, gap = order[0], sizes[order[1]] - sizes[order[0]]
        # Sizes stand for log-likelihoods; a byte of difference counts as one nat, as short
        # texts are off by a few bytes and long ones differ by hundreds.
        score = 1.0 / sum(math.exp(max(-50.0, float(sizes[best] - s))) for s in sizes)
        return self.languages[best], score, gap / sizes[best]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_margin: float | None = None) -> DataFrame:
    """Classify every whole text: id, lang_pred, score (0 to 1), margin, rejected.

    ``und`` with score 0 if the text is null, empty or has no letter, or the model knows no
    language; such rows are rejected, as are those of any length whose margin, the two best
    sizes' difference over the best, is zero or below ``min_margin`` (the model's if None). Of
    equal sizes the commonest language wins. One row per input row, also for null and repeated
    ids; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        _runner(model, min_margin, id_col, None), f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float | None = None) -> DataFrame:
    """The rows, with all their columns, whose language is not rejected.

    Rows with null, empty or letterless texts go; repeated rows stay or go together; long
    texts are judged whole; an empty table stays empty.
    """
    return docs.mapInArrow(_runner(model, min_margin, None, text_col), docs.schema)


def _runner(model: Model, min_margin: float | None, id_col: str | None, text_col: str | None):
    """Results by row, or with ``text_col`` the rows that stay."""
    name, least = uuid.uuid4().hex, model.min_margin if min_margin is None else min_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = held(f"language {name}", lambda: Classifier(model))
        for batch in pieces(batches, text_col or "text"):
            column = batch.column(text_col or "text").to_pylist()
            found = [classifier.predict(t) for t in column]
            rejected = pa.array([p == UNKNOWN or m <= 0 or m < least for p, _, m in found], pa.bool_())
            if text_col:
                yield batch.filter(pc.invert(rejected))
            else:
                columns = [pa.array([f[i] for f in found], k) for i, k in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, rejected], names=[id_col, "lang_pred", "score", "margin", "rejected"])

    return run

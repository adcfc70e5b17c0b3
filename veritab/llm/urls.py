"""URL filter over a sorted digest array.

Rules are (host, path prefix) pairs that block or allow. The driver makes an index of them: the
sorted 64-bit xxhash of every rule text, and the texts in the same order. Spark broadcasts it,
its size being bounded, and each worker maps its own copy into memory from an unnamed file. A url is judged by the rule texts
it could match - each parent of its host with each prefix of its path that has a length some
rule has - hashed, probed together by binary search, and compared with the stored texts, so a
hash collision never decides.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that an index may have, as every node gets all of it: some million rules.
MAX_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = struct.Struct("<QQ")


def build_index(rules: list[tuple[str, str, str]]) -> bytes:
    """An index of (host, path, verdict) rules: keys, text ends, verdicts, then the texts.

    Of rules with the same host and path the last one counts.
    """
    verdicts = {(host.translate(str.maketrans(UPPER, LOWER)), prefix): verdict for host, prefix, verdict in rules}
    # "\n" keeps host "a" with path "b" apart from host "ab": no host has one.
    entries = sorted((xxhash.xxh64_intdigest(text := f"{h}\n{p}".encode()), text, v == "allow") for (h, p), v in verdicts.items())
    texts = b"".join(e[1] for e in entries)
    parts = [
        _HEAD.pack(len(entries), len(texts)),
        np.array([e[0] for e in entries], dtype="<u8").tobytes(),
        np.cumsum([len(e[1]) for e in entries], dtype="<u8").tobytes(),
        np.array([e[2] for e in entries], dtype=np.uint8).tobytes(),
        texts,
    ]
    if (size := sum(map(len, parts))) > MAX_BYTES:
        raise ValueError(f"an index of {size} bytes; it may have {MAX_BYTES}")
    return b"".join(parts)


class Index:
    """An index mapped into memory from an unnamed temporary file."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            raw = np.memmap(file, dtype=np.uint8, mode="r")
        n, size = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        at = _HEAD.size
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.ends = raw[at + 8 * n : at + 16 * n].view("<u8")
        self.allow = raw[at + 16 * n : at + 17 * n]
        self.texts = raw[at + 17 * n : at + 17 * n + size]
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if n else []
        found = (bytes(self.texts[a:b]).split(b"\n", 1)[1].decode() for a, b in zip(starts, self.ends))
        self.lengths = sorted({len(p) for p in found})  # of path prefixes, in characters

    def text(self, i: int) -> bytes:
        return self.texts[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The entry that holds each text, -1 for none."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1, np.int64)
        probe = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), dtype=np.uint64, count=len(texts))
        at = np.searchsorted(self.keys, probe)
        found = np.full(len(texts), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == probe[i]:
                if self.text(k) == texts[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """For each url the rule that wins, longest text first and longer host on ties."""
        owner, texts, weights = [], [], []
        for n, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            parent = host
            while True:
                for length in self.lengths:
                    if length > len(path):
                        break
                    owner.append(n)
                    texts.append(f"{parent}\n{path[:length]}".encode())
                    weights.append((len(parent) + length, len(parent)))
                _, dot, parent = parent.partition(".")
                if not dot:
                    break
        best: dict[int, tuple] = {}
        for i, k in enumerate(self.find(texts).tolist()):
            if k >= 0 and (owner[i] not in best or best[owner[i]][0] < weights[i]):
                best[owner[i]] = (weights[i], k)
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        for n, (_, k) in best.items():
            out[n] = (self.text(k).decode().replace("\n", "", 1), "allow" if self.allow[k] else "block")
        return out


def host_and_path(df: DataFrame, url_col: str):
    """Columns host and path of a url, by Spark's own functions; both empty without ``://``."""
    url = F.coalesce(df[url_col], F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


_INDEXES: dict[str, Index] = {}


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every url: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. A url
    that no rule fits is on no list and gets ``default``, as does a null url or one without
    ``://`` (host and path empty). One row per input row, repeated ids and urls too; an empty
    table gives none; other columns are not read.
    """
    name, content = uuid.uuid4().hex, pages.sparkSession.sparkContext.broadcast(build_index(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _INDEXES:
            _INDEXES[name] = Index(content.value)
        for batch in batches:
            found = _INDEXES[name].judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(pages, url_col)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    )

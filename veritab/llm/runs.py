"""Periodic runs of words: maximal stretches that repeat with their smallest period.

A run has period q where words q apart are identical, so at lag q it shows at least
max(q, min_words - q) matches in a row. The matches of every lag are counted first: words that
are frequent in the text by the autocorrelation of their places (an FFT, rounded; counts are
whole numbers), rare ones by the differences of their places. Only lags with enough matches,
not counting those inside runs of a divisor that were found before, are scanned for islands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, utf8

#: Differences of places that are held at once, and places probed in a block before a whole scan.
HELD_DIFFERENCES, PROBES = 1 << 20, 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "array<struct<start bigint, length bigint, period bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, by first appearance."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def lag_matches(ids: np.ndarray) -> np.ndarray:
    """How many words equal the one p later, for every lag p up to half of the text.

    A word with c places costs c * c / 2 differences, or an FFT of the whole text whatever c
    is; it is frequent where the FFT is cheaper.
    """
    n = len(ids)
    top = n // 2
    found = np.zeros(top + 1, np.int64)
    counts = np.bincount(ids)
    size = 1 << max(1, n + top).bit_length()
    heavy = counts > max(32, int((2 * size * size.bit_length()) ** 0.5))
    for word in np.flatnonzero(heavy).tolist():
        spectrum = np.fft.rfft(ids == word, size)
        found += np.rint(np.fft.irfft(spectrum * spectrum.conj(), size)[: top + 1]).astype(np.int64)
    # Light words, most frequent first: those with more than r places are a prefix.
    rank = np.empty(len(counts), np.int64)
    by_count = np.argsort(-np.where(heavy, 0, counts), kind="stable")
    rank[by_count] = np.arange(len(counts))
    light = np.flatnonzero(~heavy[ids])
    order = light[np.argsort(rank[ids[light]], kind="stable")]
    word, sizes = rank[ids[order]], counts[by_count]
    if heavy.any():
        sizes = sizes[: len(counts) - int(heavy.sum())]
    stops = np.cumsum(sizes)
    gathered, held = [], 0
    for r in range(1, int(sizes[0]) if len(sizes) else 0):
        stop = int(stops[np.searchsorted(-sizes, -r, side="left") - 1])
        apart = order[r:stop] - order[: stop - r]
        apart = apart[(word[r:stop] == word[: stop - r]) & (apart <= top)]
        gathered.append(apart)
        held += len(apart)
        if held > HELD_DIFFERENCES:
            found += np.bincount(np.concatenate(gathered), minlength=top + 1)
            gathered, held = [], 0
    if held:
        found += np.bincount(np.concatenate(gathered), minlength=top + 1)
    found[0] = 0
    return found


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) of at least ``least`` words that equal the one ``lag`` later.

    Such a stretch covers a whole aligned block of half its least length; blocks are probed
    word by word, and the text is scanned only if one stands.
    """
    half = (least + 1) // 2
    at = np.arange(0, len(ids) - lag - half + 1, half)
    for i in range(min(half, PROBES)):
        if not len(at):
            return []
        at = at[ids[at + i] == ids[at + (i + lag)]]
    if not len(at):
        return []
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    edges = np.flatnonzero(np.diff(same))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def _has_divisor_period(stretch: np.ndarray, period: int) -> bool:
    """Whether a stretch of at least two periods also has a proper divisor of its period as a period."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            shorter = period // prime
            if np.array_equal(stretch[shorter:], stretch[:-shorter]):
                return True
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return False


def find_runs(ids: np.ndarray, min_words: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``min_words`` words and two periods, by start, then period.

    An island of two lags that has a smaller period has a divisor of the lag as one, and lies within a run of
    it; any other island shares no match with runs of divisors, so those matches are left out of a lag's count.
    """
    n = len(ids)
    if n < max(2, min_words):
        return []
    matches = lag_matches(ids)
    lags = np.arange(len(matches))
    need = np.maximum(np.maximum(lags, min_words - lags), 1)
    found: list[tuple[int, int, int]] = []
    # Runs found on the way only lower the counts, so these lags are all that can be open.
    for lag in (np.flatnonzero(matches[1:] >= need[1:]) + 1).tolist():
        least = int(need[lag])
        if matches[lag] < least:
            continue
        for begin, end in islands(ids, lag, least):
            length = end - begin + lag
            if _has_divisor_period(ids[begin : begin + length], lag):
                continue
            found.append((begin, length, lag))
            multiples = np.arange(lag, min(length, len(matches)), lag)
            matches[multiples] -= length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The runs of every whole text, and the text without their repetitions.

    Returns id, n_words, runs (array of start, length, period in words) and collapsed (words
    joined by one space). Words are what stands between the white space of ASCII. ``rewrite``
    may change a row's words before they are read, given its id. A null or empty text has no
    words, no runs and collapses to the empty text; repeated rows give repeated results; a
    null id stays null; an empty table gives no rows; other columns are not read. A task holds
    a few megabytes of texts, or one longer text with a few numbers for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for key, raw in zip(batch.column("id").to_pylist(), utf8(batch, "text")):
                words = raw.split()
                if rewrite is not None:
                    words = rewrite(key, words)
                runs = find_runs(numbered(words), min_words)
                rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(words, runs)))
            sizes, runs, texts = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return read.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUN_SQL}, collapsed string")

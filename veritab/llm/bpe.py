"""BPE encoding and decoding by speculation and verification.

Text is split into words - by way of white-space chunks where it has unusual characters - and
each distinct word is encoded once per Python worker:

1. *Speculate*: greedy longest match proposes the tokens of every new word.
2. *Verify*: a token sequence is the BPE result exactly if every two neighbours are what BPE
   makes of their joined strings. All new neighbour pairs of a batch are tested at once with
   numpy against the merge table.
3. *Repair*: only words with a failing pair are merged exactly, lowest rank first.

The test of step 2 rests on merges being ranked after the merges that build their parts,
which is checked when a vocabulary is loaded (else every word is merged exactly).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Numbers, held, pieces, strings

#: Distinct words and chunks that a worker remembers before it forgets the rare ones, and their
#: characters, so that their memory is bounded too.
MAX_REMEMBERED, MAX_CHARACTERS = 160_000, 4_000_000
#: New words that the library gets in one string.
TOGETHER = 500
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 19
_NO_RANK = int(np.iinfo(np.int64).max)
_NO_MERGE = (_NO_RANK, -1)
# Letters and digits up to U+017F whose lower-casing and classes are the same everywhere.
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼½¾"
_PLAIN = re.compile(f"[!-~¡-įı-ſ]+")
_WORDS = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
# Texts of these characters alone, without special tokens, split into words in one go.
_PLAIN_TEXT = re.compile("[\t-\r -~¡-įı-ſ]*")
# str.split() also splits at these, which are no white space to the library.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# The steps before and after the merges that a vocabulary file must name, as they
# are written out here.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
_NOT_SPACE = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


def read_spec(path: str) -> dict:
    """A vocabulary file's content; raises ValueError where its steps are not those of this module."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")
    if steps != (_NORMALIZER, _PRE_TOKENIZER) or spec.get("decoder") is not None:
        raise ValueError(f"{path}: another normalizer, pre-tokenizer or decoder than this module has")
    if any(spec["model"].get(k) != v for k, v in _PLAIN_MODEL.items()) or spec["model"].get("continuing_subword_prefix") or not spec["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path}: not a plain BPE model with a mark at word ends")
    if any(t.get(k) != v for t in spec.get("added_tokens", []) for k, v in _PLAIN_TOKEN.items()):
        raise ValueError(f"{path}: added tokens that are not matched as they stand")
    return spec


class Library:
    """The library's own tokenizer, and which ids end a word."""

    def __init__(self, path: str, spec: dict | None = None):
        spec = spec or read_spec(path)
        # One thread for a task: the cores belong to other tasks, and each thread keeps memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        known = spec["model"]["vocab"]
        self.size = max([*known.values(), *self.special.values()]) + 1
        self.ends_word = np.zeros(self.size, dtype=bool)
        self.ends_word[[i for text, i in known.items() if text.endswith(self.suffix)]] = True


class Vocabulary(Library):
    """A word-level BPE vocabulary file of the tokenizers library, prepared for the method."""

    def __init__(self, path: str):
        spec = read_spec(path)
        super().__init__(path, spec)
        model, size = spec["model"], self.size
        self.ids: dict[str, int] = model["vocab"]
        self.texts = np.full(size, "", dtype=object)
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.texts[i] = text
        self.letters = _byte_letters()
        self.table = {b: letter for b, letter in enumerate(self.letters)}
        self.longest = max(map(len, self.ids))

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.merges = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self.made = made.tolist()
        #: For each token the rank of the merge that makes it (-1: a letter) and its halves.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.halves = np.full((size, 2), -1, dtype=np.int64)
        self.rank[made] = rank
        self.halves[made, 0], self.halves[made, 1] = left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], rank[order]
        #: Whether later merges only use what earlier ones made, each token by one merge.
        self.ordered = bool((self.rank[left] < rank).all() and (self.rank[right] < rank).all()) and len(set(made.tolist())) == len(made)
        self.whole = self._whole()

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b, a very large number where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NO_RANK)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token arrays a and b: does BPE leave the joined strings as these two tokens?

        While each side builds up, its outer symbol at the border passes through the tokens
        on its inner edge. A merge across the border happens if two such symbols stand there
        at that merge's rank. Equal ranks go to the left pair first.
        """
        good = np.ones(len(a), dtype=bool)
        x, gone_x = a.copy(), np.full(len(a), _NO_RANK)
        while len(x) and (x >= 0).any():
            y, gone_y = b.copy(), np.full(len(b), _NO_RANK)
            while (live := (x >= 0) & (y >= 0) & good).any():
                r = self._merge_rank(np.where(live, x, 0), np.where(live, y, 0))
                good &= ~(live & (r < gone_x) & (r != _NO_RANK) & (r <= gone_y))
                down = np.where(y >= 0, y, 0)
                gone_y, y = np.where(y >= 0, self.rank[down], gone_y), np.where(y >= 0, self.halves[down, 0], -1)
            down = np.where(x >= 0, x, 0)
            gone_x, x = np.where(x >= 0, self.rank[down], gone_x), np.where(x >= 0, self.halves[down, 1], -1)
        return good

    def _whole(self) -> set[str]:
        """The strings that BPE turns into the one token of that name (found by checking halves)."""
        if not self.ordered:
            return set()
        fine = np.ones(self.size, dtype=bool)
        made = np.flatnonzero(self.rank >= 0)
        a, b = self.halves[made, 0], self.halves[made, 1]
        # A merged token stands for its string if its halves do and meet at this very merge.
        meets = self._meets(a, b, self.rank[made])
        for token, left, right, ok in sorted(zip(made.tolist(), a.tolist(), b.tolist(), meets.tolist()), key=lambda t: self.rank[t[0]]):
            fine[token] = ok and fine[left] and fine[right]
        return {text for text, i in self.ids.items() if fine[i]}

    def _meets(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether a and b both come to stand whole at the border and merge at ``rank``."""
        good = np.ones(len(a), dtype=bool)
        x, gone_x, top_x = a.copy(), np.full(len(a), _NO_RANK), True
        while (x >= 0).any():
            y, gone_y, top_y = b.copy(), np.full(len(b), _NO_RANK), True
            while (live := (x >= 0) & (y >= 0)).any():
                if not (top_x and top_y):
                    r = self._merge_rank(np.where(live, x, 0), np.where(live, y, 0))
                    good &= ~(live & (r < gone_x) & (r != _NO_RANK) & (r <= gone_y))
                down = np.where(y >= 0, y, 0)
                gone_y, y, top_y = np.where(y >= 0, self.rank[down], gone_y), np.where(y >= 0, self.halves[down, 0], -1), False
            down = np.where(x >= 0, x, 0)
            gone_x, x, top_x = np.where(x >= 0, self.rank[down], gone_x), np.where(x >= 0, self.halves[down, 1], -1), False
        return good & (self._merge_rank(a, b) == rank)

    def symbols(self, word: str) -> list[int]:
        """The single letters that BPE starts from; the last one carries the word end."""
        return [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]

    def merge_exactly(self, word: str) -> list[int]:
        """BPE by its definition: the lowest rank first, of equal ranks the leftmost."""
        out, get = self.symbols(word), self.merges.get
        if len(out) > 64:
            return self._merge_long(out)
        ranks = [get(pair, _NO_MERGE)[0] for pair in zip(out, out[1:])]
        while ranks and (best := min(ranks)) < _NO_RANK:
            i = ranks.index(best)
            out[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((out[i - 1], out[i]), _NO_MERGE)[0]
            if i < len(ranks):
                ranks[i] = get((out[i], out[i + 1]), _NO_MERGE)[0]
        return out

    def _merge_long(self, out: list[int]) -> list[int]:
        """The same with a heap and links, for words of thousands of letters."""
        n, merges = len(out), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, out[i], out[i + 1]) for i in range(n - 1) if (m := merges.get((out[i], out[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j < 0 or out[j] != b:
                continue
            out[i], out[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k, right in ((before[i], i), (i, after[i])):
                if k >= 0 and right >= 0 and (m := merges.get((out[k], out[right]))):
                    heapq.heappush(heap, (m[0], k, out[k], out[right]))
        return [x for x in out if x >= 0]

    def greedy(self, word: str) -> list[int] | None:
        """Longest matches from the left; None where no token fits."""
        whole, ids, end, out, at = self.whole, self.ids, len(word), [], 0
        closed = word + self.suffix
        while at < end:
            stop = min(end, at + self.longest)
            if stop == end and (piece := closed[at:]) in whole:
                out.append(ids[piece])
                break
            for stop in range(stop - (stop == end), at, -1):
                if (piece := word[at:stop]) in whole:
                    out.append(ids[piece])
                    at = stop
                    break
            else:
                return None
        return out


class WordEncoder:
    """Encodes texts as the library does, remembering what it has made of each chunk.

    ``by_library``: new chunks are encoded by the library itself instead of by this method.
    """

    def __init__(self, path: str, by_library: bool = False):
        self.vocabulary = Library(path) if by_library else Vocabulary(path)
        self.by_library = by_library
        self.stats = {"words": 0, "repaired": 0}
        self._start()

    def _start(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.chunks, self.characters = Numbers(), 0
        self.starts, self.lengths, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, np.uint32)

    def _forget_rare(self) -> None:
        """Keep what came more than once, half of the bounds at most, with its ids."""
        order = np.argsort(-self.uses, kind="stable")[: MAX_REMEMBERED // 2]
        sizes = np.fromiter(map(len, self.chunks), np.int64, len(self.chunks))
        keep = np.zeros(len(self.uses), bool)
        keep[order[(self.uses[order] > 1) & (np.cumsum(sizes[order]) <= MAX_CHARACTERS // 2)]] = True
        names = [c for c, kept in zip(self.chunks, keep.tolist()) if kept]
        lengths, starts, pool = self.lengths[keep], self.starts[keep], self.pool
        self._start()
        for c in names:
            self.chunks[c]
        self.chunks.fresh, self.characters = [], sum(map(len, names))
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        self._remember(lengths, pool[at])

    def _split(self, chunk: str) -> list[str | int]:
        """The words of a chunk in byte letters; ids for special tokens."""
        v = self.vocabulary
        if v.cut is not None and "<" in chunk and (found := v.cut.search(chunk)):
            head, tail = chunk[: found.start()], chunk[found.end() :]
            return (self._split(head) if head else []) + [v.special[found[0]]] + (self._split(tail) if tail else [])
        if _PLAIN.fullmatch(chunk):
            words = _WORDS.findall(chunk.lower())
            if chunk.isascii():
                return words
            return [w if w.isascii() else w.encode().decode("latin-1").translate(v.table) for w in words]
        normal = v.library.normalizer.normalize_str(chunk)
        return [w for w, _ in v.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn_words(self, words: list[str]) -> None:
        """Speculate, verify, repair: adds the ids of new words."""
        v = self.vocabulary
        self.stats["words"] += len(words)
        proposed = [v.greedy(w) if v.ordered else None for w in words]
        lengths = np.array([len(p) if p else 0 for p in proposed], dtype=np.int64)
        flat = np.array([i for p in proposed if p for i in p], dtype=np.int64)
        bad = lengths == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            inside = owner[1:] == owner[:-1]
            keys = flat[:-1][inside] * v.size + flat[1:][inside]
            distinct, back = np.unique(keys, return_inverse=True)
            known = [self.pairs.get(k) for k in distinct.tolist()]
            new = np.array([k is None for k in known], dtype=bool)
            verdict = np.array([bool(k) for k in known], dtype=bool)
            if new.any():
                verdict[new] = v.compatible(distinct[new] // v.size, distinct[new] % v.size)
                self.pairs.update(zip(distinct[new].tolist(), verdict[new].tolist()))
            bad[owner[1:][inside][~verdict[back]]] = True
        for word, ids, wrong in zip(words, proposed, bad.tolist()):
            self.words[word] = v.merge_exactly(word) if wrong else ids
        self.stats["repaired"] += int(bad.sum())

    def _learn_chunks(self, chunks: list[str], single: bool) -> None:
        """Learn the ids of new chunks; ``single`` says that each is one word as it stands."""
        if self.by_library:
            self._remember(*self._by_library(chunks, single))
            return
        split = [self._split(c) for c in chunks]
        if len(self.words) > MAX_REMEMBERED // 8:
            self.words.clear()
        if new := [w for w in {w for words in split for w in words if isinstance(w, str)} if w not in self.words]:
            self._learn_words(new)
        known = self.words
        ids = [[i for w in words for i in (known[w] if isinstance(w, str) else (w,))] for words in split]
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        self._remember(lengths, np.array([i for x in ids for i in x], dtype=np.uint32))

    def _by_library(self, chunks: list[str], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of chunks from the library; a single word's ids end where a word ends."""
        v = self.vocabulary
        if not single and not all(c == c.lower() and _PLAIN.fullmatch(c) and _WORDS.fullmatch(c) for c in chunks):
            made = v.library.encode(chunks, is_pretokenized=True, add_special_tokens=False)
            return np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(chunks)), np.array(made.ids, dtype=np.uint32)
        made = v.library.encode_batch_fast([" ".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(m.ids, dtype=np.uint32) for m in made])
        ends = np.flatnonzero(v.ends_word[ids])
        return np.diff(ends, prepend=-1), ids

    def _remember(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.uses = np.append(self.uses, np.zeros_like(lengths))
        self.pool = np.append(self.pool, ids)

    def _pieces(self, text: str) -> tuple[list[str], bool]:
        """The words of a plain text, else its chunks; and whether they are words."""
        if _PLAIN_TEXT.fullmatch(text) and not (self.vocabulary.cut is not None and self.vocabulary.cut.search(text)):
            return _WORDS.findall(text.lower()), True
        return (_NOT_SPACE.findall(text) if any(c in text for c in _ODD_SPACE) else text.split()), False

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end."""
        if len(self.chunks) > MAX_REMEMBERED or self.characters > MAX_CHARACTERS:
            self._forget_rare()
        cut = [self._pieces(t) for t in texts]
        split, plain = [words for words, _ in cut], all(single for _, single in cut)
        chunks = list(chain.from_iterable(split))
        at = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        if self.chunks.fresh:
            fresh, self.chunks.fresh = self.chunks.fresh, []
            self.characters += sum(map(len, fresh))
            self._learn_chunks(fresh, plain)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        last = np.cumsum(counts)
        bounds = np.where(last > 0, ends[np.maximum(last, 1) - 1], 0) if len(ends) else np.zeros(len(texts), np.int64)
        return self.pool[take], bounds

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder: tokens joined by one space."""
        return " ".join(self.vocabulary.texts[ids].tolist())


def encoder(path: str, by_library: bool = False) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    return held(f"bpe {path} {by_library}", lambda: WordEncoder(path, by_library))


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, the digests of nothing. Ids pass through as they
    are, null and repeated ones too; one row per input row; other columns are not read.
    ``tokenizer`` is a path that exists on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in pieces(batches, "text", AT_ONCE):
            ids, ends = coder.encode(strings(batch, "text"))
            starts = np.concatenate([[0], ends[:-1]])
            little = ids.astype("<u4", copy=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(starts, ends)]),
                    pa.array([hashlib.sha256(coder.decode(ids[a:b]).encode()).hexdigest() for a, b in zip(starts, ends)]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

"""Byte-pair encoding and decoding by speculation and verification.

A word's pieces are proposed by greedy longest match. Whether a proposal is the exact
encoding is a question about adjacent pairs only: a boundary between two tokens holds if
no merge across it would have come before the merges that made the two tokens. One
vectorised walk down the merge trees tests every adjacent pair of a batch of new words;
words with a failing pair, and those alone, are merged exactly, step by step.

The vocabulary file (its path is a parameter) is read by the workers, or sent by the
driver in a broadcast of its fixed size: it is 2 MB and does not grow with the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from timbral.llm.common import map_arrow

#: Distinct words whose encodings a worker keeps from batch to batch, so from task to task; beyond it, those stay that the last batch met again.
MEMO_WORDS = 200_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.names = {i: t for t, i in ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        size = max(self.names) + 1
        self.symbols = byte_symbols()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: The time at which a token is made (its merge's rank; -1: never merged), and its halves.
        self.birth, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, made = (ids[a], ids[b]), ids[a + b]
            self.ranks[pair] = (rank, made)
            if self.birth[made] < 0:
                self.birth[made], self.left[made], self.right[made] = rank, *pair
        keys = np.array([a * size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, keys[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        #: Tokens by their bytes' symbols, for the longest match: those in the middle of a word and those that end it.
        self.inner = {t: i for t, i in ids.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in ids.items() if t.endswith(self.end) and t != self.end}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._drop_unmade()

    def _drop_unmade(self) -> None:
        """Tokens that exact merging of their own text doesn't give can't be proposed."""
        for table, closed in ((self.inner, False), (self.final, True)):
            for t in [t for t, i in table.items() if len(t) > 1 and self.merge(t, closed) != [i]]:
                del table[t]

    def merge(self, word: str, closed: bool = True) -> list[int]:
        """Exact merging: always the earliest merge that is possible, the leftmost first."""
        ids = [self.inner[c] for c in word]
        if closed:
            ids[-1] = self.final[word[-1]]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*r, i) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or self.ranks.get((ids[i], ids[j])) != (rank, made):
                continue
            ids[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the rest of the word as one closing token goes first."""
        out, at, n = [], 0, len(word)
        inner, final = self.inner, self.final
        while at < n:
            rest = word[at:] if n - at <= self.longest else None
            if rest in final:
                out.append(final[rest])
                break
            for k in range(min(self.longest, n - at - 1), 0, -1):
                if (t := inner.get(word[at : at + k])) is not None:
                    out.append(t)
                    at += k
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether the boundary between them survives merging.

        Walks back in time: the later made of the two that meet at the boundary comes apart,
        and the pair that met before it must have no merge that was due by then. Of equal
        tokens the left one was made first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            bx, by = self.birth[x], self.birth[y]
            go = np.maximum(bx, by) >= 0
            todo, x, y, bx, by = (v[go] for v in (todo, x, y, bx, by))
            of_left = bx > by
            due = np.where(of_left, bx, by + 1)  # a merge of this rank on the right comes after that of the boundary
            x, y = np.where(of_left, self.right[x], x), np.where(of_left, y, self.left[y])
            a[todo], b[todo] = x, y
            keys = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < due)
            good[todo[bad]] = False
            todo = todo[~bad]
        return good

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Exact encodings of words in byte symbols; how many had to be merged exactly."""
        proposed = [self.propose(w) for w in words]
        counts = np.array([max(0, len(p) - 1) for p in proposed])
        if not counts.sum():
            return proposed, 0
        pairs = np.array([(p[i], p[i + 1]) for p in proposed for i in range(len(p) - 1)], np.int64)
        owner = np.repeat(np.arange(len(words)), counts)
        failing = np.unique(owner[~self.compatible(pairs[:, 0], pairs[:, 1])]).tolist()
        for i in failing:
            proposed[i] = self.merge(words[i])
        return proposed, len(failing)


class Coder:
    """Encodes and decodes whole texts as the tokenizers library does with the same file."""

    #: The file's split pattern, in the words of the regex library (a fixed value).
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, text: str, decodes: bool = True) -> None:
        self.vocabulary, self.decodes = Vocabulary(text), decodes
        self.pieces = regex.compile(self.PIECES).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.specials, key=len, reverse=True))) + ")")
        self.memo: dict[str, tuple[bytes, str]] = {}

    def _learn(self, words: set[str]) -> None:
        symbols = self.vocabulary.symbols
        new = list(words)
        coded, _ = self.vocabulary.encode_words(["".join(symbols[b] for b in w.encode()) for w in new])
        names = self.vocabulary.names
        for w, ids in zip(new, coded, strict=True):
            self.memo[w] = (np.array(ids, "<u4").tobytes(), " ".join(names[i] for i in ids) if self.decodes else "")

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter; white space only parts pieces, so it needs no folding."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text; no decoded text from a coder that doesn't decode."""
        cut: list[list[tuple[str | None, list[str]]]] = []
        new: set[str] = set()
        for text in texts:
            parts: list[tuple[str | None, list[str]]] = []
            for part in self.specials.split(text) if self.vocabulary.specials else [text]:
                if part in self.vocabulary.specials:
                    parts.append((part, []))
                elif part:
                    words = self.pieces(self.normal(part))
                    new.update(words)
                    parts.append((None, words))
            cut.append(parts)
        memo = self.memo
        again = new.intersection(memo)
        self._learn(new.difference(memo))
        if len(memo) > MEMO_WORDS:  # this batch still has all of its words
            self.memo = {w: memo[w] for w in again}
        for parts in cut:
            ids, names = [], []
            for special, words in parts:
                got = [memo[w] for w in words] if special is None else [(np.array([self.vocabulary.specials[special]], "<u4").tobytes(), special)]
                ids += [g[0] for g in got]
                if self.decodes:
                    names += [g[1] for g in got]
            yield b"".join(ids), " ".join(names)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.batch([text or ""]))[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): the tokens, blank-separated; unknown ids give nothing."""
        names = self.vocabulary.names
        return " ".join(names[i] for i in ids if i in names)


#: Coders of this worker by vocabulary: they and their memos outlast a task.
_CODERS: dict[tuple[str, bool], Coder] = {}


def coder(vocabulary: str, decodes: bool = True) -> Coder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest(), decodes
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(vocabulary, decodes)
    return _CODERS[key]


def with_tokens(docs: DataFrame, vocabulary_path: str, add: Callable[[pa.Array, list[tuple[bytes, str]]], list[pa.Array]], names: list[str], schema: str, decodes: bool = True) -> DataFrame:
    """docs: (doc_id, text) -> doc_id and the columns that add makes of the texts and their (ids, decoded text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, decodes)
        for b in batches:
            got = list(own.batch([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), *add(b.column(1), got)], ["doc_id", *names])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id long, {schema}")


def _ids(got: list[tuple[bytes, str]]) -> pa.Array:
    ends = np.cumsum([0, *(len(i) // 4 for i, _ in got)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(i for i, _ in got), "<i4"), pa.int32()))


def ids(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """As encode, but (doc_id, ids) alone: no text is decoded, kept or moved."""
    return with_tokens(docs, vocabulary_path, lambda _, got: [_ids(got)], ["ids"], "ids array<int>", decodes=False)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, ids array<int>, decoded string), one row per row.

    A null text is encoded as an empty one: no ids, an empty string. Repeated rows and null
    ids of documents stay; an empty table gives no rows; other columns are dropped.
    """

    def add(_: pa.Array, got: list[tuple[bytes, str]]) -> list[pa.Array]:
        return [_ids(got), pa.array([d for _, d in got], pa.string())]

    return with_tokens(docs, vocabulary_path, add, ["ids", "decoded"], "ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """As encode, but (doc_id, n_tokens, ids_sha256, decoded_sha256): the same work without moving the ids."""

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def add(_: pa.Array, got: list[tuple[bytes, str]]) -> list[pa.Array]:
        return [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([sha(i) for i, _ in got], pa.string()), pa.array([sha(d.encode()) for _, d in got], pa.string())]

    return with_tokens(docs, vocabulary_path, add, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")

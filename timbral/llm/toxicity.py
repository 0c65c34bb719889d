"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of the examples that are in LEAST documents and in COMMON of all at
most, by counts over all documents. A term's weight is its inverse document frequency,
raised by how surely toxic examples use it more than others (its likelihood-ratio
statistic beyond SURE). Examples lie in blocks, those of a like heaviest term together;
each term has a posting per block with the greatest weight there, which bounds the cosine
of the whole block. Blocks are searched in order of their bounds until none can reach
the k-th best, so the neighbours are exact. Their votes, weighted by distance and shrunk to the
examples' rate, are the score, and the nearest are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import cut as cut_lineage
from timbral.llm.common import map_arrow
from timbral.llm.labelled import fold, sample

#: Labelled documents that serve as examples at most, whatever the input's size.
EXAMPLES = 6_000
#: Documents that have a term at least, and the share of all that have it at most.
LEAST, COMMON = 2, 0.1
#: The likelihood-ratio statistic that chance exceeds in one term of twenty, and how much a unit beyond it adds to a weight.
SURE, RAISE = 3.84, 0.1
NEIGHBOURS, BLOCK, CUT = 15, 256, 0.5
#: Blocks that are searched first; then those that may still reach the k-th best.
AHEAD = 4
WORD = re.compile(r"[^\W\d_]+")


#: bytes.translate table for ASCII texts: lower-cases letters, and turns all else into blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return text.encode("ascii").translate(LETTERS).decode("ascii").split() if text.isascii() else WORD.findall(text.lower())


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> (term, n, toxic): examples that have the term; the row of term '' counts all."""
    n, toxic = Counter(), Counter()
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = {"", *words_of(text)}
            n.update(own)
            if y:
                toxic.update(own)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64()), pa.array([toxic[t] for t in n], pa.int64())], ["term", "n", "toxic"])


def _frequencies(terms: dict[str, int]):
    """(text) -> (term, n): documents that have it; term -1 counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(terms) + 1, np.int64), 0  # the last place takes words that are no terms
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                own = set(words_of(text))
                seen[np.fromiter(map(terms.get, own, repeat(-1)), np.int64, len(own))] += 1
        at = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([n, *seen[at]], pa.int64())], ["term", "n"])

    return run


def raised(n: np.ndarray, toxic: np.ndarray, examples: int, of_toxic: int) -> np.ndarray:
    """1, and more for terms that toxic examples have more surely: by the statistic of n examples with the term, `toxic` of them toxic."""
    expected = n * (of_toxic / max(1, examples))
    other = n - toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        sure = 2 * (np.where(toxic > 0, toxic * np.log(toxic / expected), 0) + np.where(other > 0, other * np.log(other / (n - expected)), 0))
    return 1 + RAISE * np.where(toxic > expected, np.maximum(sure - SURE, 0), 0)


class Index:
    """Examples' unit vectors as postings by term, in order of example; per term and block the greatest weight and where the block's postings lie."""

    def __init__(self, terms: dict[str, int], weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, names: list[int]) -> None:
        self.terms, self.weight = terms, weight
        self.rate = float((y.sum() + 0.5) / (len(y) + 1.0))
        units = [self.unit(*v) for v in vectors]
        heaviest = [int(ids[w.argmax()]) if len(ids) else -1 for ids, w in units]
        order = sorted(range(len(units)), key=lambda i: (heaviest[i], i))
        #: The examples as they lie in the index; rank is their order among equals.
        self.y, self.names, self.rank = y[order].astype(float), np.array(names, np.int64)[order], np.array(order, np.int64)
        self.blocks = (len(order) + BLOCK - 1) // BLOCK
        ids = np.concatenate([units[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weights = np.concatenate([units[i][1] for i in order]) if order else np.zeros(0)
        place = np.repeat(np.arange(len(order)), [len(units[i][0]) for i in order])
        by_term = np.lexsort((place, ids))
        ids, self.example, self.weights = ids[by_term], place[by_term].astype(np.int32), weights[by_term]
        block = self.example // BLOCK
        self.begin = np.flatnonzero(np.diff(ids, prepend=-1) | np.diff(block, prepend=-1)) if len(ids) else np.zeros(0, np.int64)
        self.end = np.append(self.begin[1:], len(ids))
        self.block = block[self.begin]
        self.greatest = np.maximum.reduceat(self.weights, self.begin) if len(ids) else np.zeros(0)
        self.first = np.searchsorted(ids[self.begin], np.arange(len(terms) + 1))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often each is used)."""
        words = words_of(text)
        used = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        used.sort()
        first = np.flatnonzero(np.diff(used, prepend=-1))  # no term is -1, so those that are none fall away
        return used[first], np.diff(first, append=len(used))

    def unit(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[ids]
        return ids, w / np.sqrt((w**2).sum()) if len(w) else w

    @staticmethod
    def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers from each start to its end, and how many each has."""
        sizes = ends - starts
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def nearest(self, ids: np.ndarray, n: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k of greatest cosine, over 0; of equal ones the first examples."""
        ids, w = self.unit(ids, n)
        posting, sizes = self._spread(self.first[ids], self.first[ids + 1])
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(posting):
            return found, cosines
        w, block = np.repeat(w, sizes), self.block[posting]
        bound = np.bincount(block, w * self.greatest[posting], self.blocks)
        todo = np.argsort(-bound, kind="stable")
        todo = todo[: np.count_nonzero(bound)]
        at, stop = 0, AHEAD
        while at < len(todo) and stop > at:
            here = slice(None)
            if stop - at < len(todo):
                chosen = np.zeros(self.blocks, bool)
                chosen[todo[at:stop]] = True
                here = np.flatnonzero(chosen[block])
            flat, sizes = self._spread(self.begin[posting[here]], self.end[posting[here]])
            own = np.bincount(self.example[flat], np.repeat(w[here], sizes) * self.weights[flat], len(self.y))
            hit = np.flatnonzero(own)
            found, cosines = np.concatenate([found, hit]), np.concatenate([cosines, own[hit]])
            if len(found) > k:  # those that tie with the k-th, for all that rounding may do, stay for the order
                near = cosines >= np.partition(cosines, -k)[-k] - 1e-11
                found, cosines = found[near], cosines[near]
            order = np.lexsort((self.rank[found], -np.round(cosines, 12)))[:k]
            found, cosines = found[order], cosines[order]
            # of the rest, all blocks that may still hold one as near as the k-th
            at, stop = stop, np.count_nonzero(bound >= cosines[-1] - 1e-9) if len(found) == k else len(todo)
        return found, cosines

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The score, and the documents that it rests on, nearest first."""
        near, cosines = self.nearest(*self.counts(text))
        votes = 1 / (1.02 - np.minimum(cosines, 1.0))
        return float(((votes * self.y[near]).sum() + self.rate) / (votes.sum() + 1)), self.names[near].tolist()


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> Index:
    """No labelled rows at all give an index that scores every text alike.

    The examples' words come to the driver, with their counts, and are sent to the workers: the number and the
    length of examples are bounded, so this doesn't grow with the documents. Of examples with the same
    text one counts for a term's likelihood ratio.
    """
    examples = cut_lineage(sample(docs, labels, label, most).withColumn("y", F.least("y", F.lit(1))))
    used = map_arrow(examples.groupBy("text").agg(F.max("y").alias("y")).select("y", "text"), _used, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow().sort_by("term")
    every, n, toxic = used.column(0).to_pylist(), used.column(1).to_numpy(), used.column(2).to_numpy()
    of_all = (int(n[0]), int(toxic[0])) if every else (0, 0)  # '' sorts first
    every, n, toxic = every[1:], n[1:], toxic[1:]

    found = map_arrow(docs.select("text"), _frequencies({t: i for i, t in enumerate(every)}), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().sort_by("term")
    df = np.zeros(len(every) + 1, np.int64)
    df[found.column(0).to_numpy() + 1] = found.column(1).to_numpy()
    total, df = int(df[0]), df[1:]
    kept = np.flatnonzero((df >= LEAST) & (df <= max(LEAST, COMMON * total)))
    terms = {every[i]: at for at, i in enumerate(kept.tolist())}
    weight = (np.log((1 + total) / (1 + df[kept])) + 1) * raised(n[kept], toxic[kept], *of_all)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(terms, weight, [], np.zeros(0), [])
        for b in batches:
            got = [own.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], ["doc_id", "y", "ids", "n"])

    rows = map_arrow(examples.select("doc_id", "y", "text"), vectors, "doc_id long, y int, ids array<int>, n array<int>").toArrow().sort_by("doc_id")
    ids, counts = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("ids", "n"))
    ends = np.cumsum([0, *pc.list_value_length(rows.column("ids")).to_pylist()]).tolist()
    vectors_of = [(ids[a:b], counts[a:b]) for a, b in pairwise(ends)]
    y, names = rows.column("y").to_numpy().astype(int), rows.column("doc_id").to_pylist()
    del found, used, rows
    pa.default_memory_pool().release_unused()  # else the driver keeps it beside all that follows
    return Index(terms, weight, vectors_of, y, names)


def _scored(docs: DataFrame, index: Index, add, schema: str) -> DataFrame:  # noqa: ANN001
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield add(b, [own.score(t) for t in b.column(at).to_pylist()])

    return map_arrow(docs, run, schema)


def score(docs: DataFrame, index: Index, cut: float = CUT) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, held_out, score, predicted, evidence), one row per row.

    A text without terms of the index, a null or empty one too, has the examples' rate as its score
    and no evidence. A null doc_id is not held out. Repeated rows stay; an empty table gives no
    rows; other columns are not looked at. Ties of distance go to the examples of least id.
    """

    def add(b: pa.RecordBatch, got: list[tuple[float, list[int]]]) -> pa.RecordBatch:
        s = np.array([g[0] for g in got], float)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array([g[1][:5] for g in got], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"]
        )

    return _scored(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), index, add, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def reject(docs: DataFrame, index: Index, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the cut."""

    def add(b: pa.RecordBatch, got: list[tuple[float, list[int]]]) -> pa.RecordBatch:
        return b.filter(pa.array([g[0] < cut for g in got], pa.bool_()))

    return _scored(docs, index, add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

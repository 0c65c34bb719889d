"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through sharded BK-trees.

Fingerprints at Hamming distance r or less agree on one of r + 1 bands of bits. Each
(band, value) is a shard, dealt to a task by the shuffle; there it becomes a BK-tree
(children keyed by their integer distance to the parent) that is searched along the
edges within the radius only. Shards over SHARD_ROWS are dealt once more by a band of
their other bits, which loses no link for the same reason. A shard reports for each
fingerprint one link to the root of its local group, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import LOWER, cut, map_arrow
from timbral.llm.components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 3
#: Fingerprints of a shard from which on it is dealt once more.
SHARD_ROWS = 512


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if set in over half of the shingles' hashes; a text without words has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= n:
        return digest(join(words), HASH_SEED)
    count = len(words) - n + 1
    ones = np.zeros(64, np.int64)
    shingles = map(join, zip(*(words[i:] for i in range(n)), strict=False))
    for at in range(0, count, 1 << 14):
        k = min(1 << 14, count - at)
        hashes = np.fromiter((digest(next(shingles), HASH_SEED) for _ in range(k)), np.uint64, k)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(k, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _fingerprint_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return run


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add_and_find(self, key: int, radius: int) -> list[int]:
        """Adds key, distinct from those in the tree; returns the nodes within the radius."""
        keys, edges = self.keys, self.edges
        me = len(keys)
        keys.append(key)
        edges.append({})
        if not me:
            return []
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            d = (keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(node)
            down = edges[node]
            if len(down) <= 2 * radius + 1:
                stack.extend(c for e, c in down.items() if -radius <= e - d <= radius)
            else:
                stack.extend(down[e] for e in range(d - radius, d + radius + 1) if e in down)
        node = 0
        while True:
            d = (keys[node] ^ key).bit_count()
            child = edges[node].get(d)
            if child is None:
                edges[node][d] = me
                return found
            node = child


def shard_links(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """One link per fingerprint of a local group but the first: (fingerprint, root)."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, key in enumerate(prints):
        near = tree.add_and_find(key, radius)
        root.append(i)
        for j in near:
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(prints[i], prints[top(i)]) for i in range(len(prints)) if top(i) != i]


def _link_batches(radius: int):
    def links(prints: np.ndarray) -> list[tuple[int, int]]:
        return shard_links(np.unique(prints).view(np.uint64).tolist(), radius)

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, in batches that don't heed the shards' ends."""
        open_shard, parts = None, []
        for b in batches:
            shard, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(shard):
                continue
            ends = np.flatnonzero(np.diff(shard)) + 1
            pairs: list[tuple[int, int]] = []
            for s, part in zip(shard[np.concatenate([[0], ends])].tolist(), np.split(prints, ends), strict=True):
                if s != open_shard:
                    if sum(map(len, parts)) > 1:
                        pairs += links(np.concatenate(parts))
                    open_shard, parts = s, []
                parts.append(part)
            yield out(pairs)
        if sum(map(len, parts)) > 1:
            yield out(links(np.concatenate(parts)))

    return run


def _bands(radius: int, low: int, high: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands of the bits from low to high."""
    cuts = [low + (high - low) * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _band(column: F.Column, first: int, bits: int) -> F.Column:
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << bits) - 1))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: (print) distinct fingerprints -> (u, v): links that join exactly the fingerprints a chain of links joins."""
    spark = prints.sparkSession
    bands = _bands(radius, 0, 64)
    sharded = prints.select(
        "print", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _band(F.col("print"), a, k).alias("value")) for i, (a, k) in enumerate(bands)])).alias("s")
    ).select("print", "s.band", (F.col("s.band") * F.lit(1 << 40) + F.col("s.value")).alias("shard"))
    sizes = sharded.groupBy("shard").count()
    sized = sharded.join(sizes.filter("count > 1"), "shard")
    rest = []  # for each band, the other bits moved together, then banded once more
    for a, k in bands:
        others = F.col("print").bitwiseAND(F.lit((1 << a) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned("print", a + k) if a + k < 64 else F.lit(0).cast("long"), a))
        rest.append(F.array(*[F.xxhash64("shard", F.lit(j), _band(others, x, y)) for j, (x, y) in enumerate(_bands(radius, 0, 64 - k))]))
    again = F.element_at(F.array(*rest), F.col("band") + 1)
    dealt = sized.select("print", F.explode(F.when(F.col("count") > SHARD_ROWS, again).otherwise(F.array("shard"))).alias("shard"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(dealt.repartition(n, "shard").sortWithinPartitions("shard").select("shard", "print"), _link_batches(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per row of docs.

    fingerprint: 16 lower-case hex digits; component_id: the least doc_id that a chain of
    links reaches. A null text counts as empty and has fingerprint 0; empty texts are
    linked to one another like any other. A null doc_id keeps its row and is never a
    component_id unless all of its component are null. Repeated rows stay; an empty table gives no
    rows; other columns are dropped.
    """
    prints = cut(map_arrow(docs.select(F.col("doc_id"), F.col("text")), _fingerprint_batches(n), "doc_id long, print long"))
    least = prints.groupBy("print").agg(F.min("doc_id").alias("doc"))
    nodes = components(links(least.select("print"), radius)).withColumnsRenamed({"node": "print"})
    roots = least.join(nodes, "print", "left").select("print", "doc", F.coalesce("root", "print").alias("root"))
    of_root = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_print = roots.join(of_root, "root").select("print", "component_id")
    return prints.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

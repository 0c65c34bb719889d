"""Near copies by exact Jaccard similarity of word shingles: one survivor of each group.

Candidates come from two sides. SimHash's sharded BK-trees (simhash.links, of the texts' 64-bit fingerprints of
the same shingles, at its own radius) link the closest copies. A similarity of 0.8 is 10 bits on
average, beyond any radius that its bands can shard, so the rest
meet in one of BANDS buckets of ROWS minima of keyed hashes each: two texts of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8 and
more above. Each candidate pair is then compared shingle by shingle, so that no link
rests on a hash of the shingles. A bucket's texts are first compared with its first one.
Of buckets whose texts no chain of links has joined yet, all pairs of unlike groups
are then held against each other by a sketch of SKETCH minima, one byte each, and only those
that agree in AGREE of them go on: one of similarity 0.8 agrees in less with probability
1e-5. So groups of copies take linear work. What still grows with the square, within a
task, is comparing the sketches of a bucket's texts that are like one another but below 0.8.

Texts pass a shuffle only where they may have to: nodes that meet others, and rows whose node repeats or goes,
are told by a bitmap of exact.BITS bits. A bit that another node set costs a shuffled row and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm import exact, simhash
from timbral.llm.common import LOWER, cut, map_arrow, shared_folder
from timbral.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SKETCH, AGREE = 800, 0.74
SEED = 42
#: Candidate pairs of a batch that a worker hands on.
PAIRS = 1 << 15
_KEYS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
_SKETCH_KEYS = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (2, SKETCH), np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(own: list[bytes], n: int = SHINGLE_WORDS) -> set[bytes]:
    """A text of fewer words is one shingle, a text without words the empty one."""
    return {b" ".join(own)} if len(own) <= n else set(map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False)))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def node(own: list[bytes]) -> int:
    """Texts of the same words are one node."""
    return xxhash.xxh64_intdigest(b" ".join(own), SEED)


def minima(own: set[bytes], keys: np.ndarray) -> np.ndarray:
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own))
    least = np.full(keys.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * keys[0] + keys[1]).min(axis=0))
    return least


def buckets(own: set[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(band.tobytes(), j) for j, band in enumerate(minima(own, _KEYS).reshape(BANDS, ROWS))]


def sketch(own: set[bytes]) -> bytes:
    return minima(own, _SKETCH_KEYS).astype(np.uint8).tobytes()


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _may_be(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows, with a column node, and `survives`: whether it may be one of the nodes. The bitmap's size is fixed, so it is broadcast."""
    bits = nodes.select(F.expr(f"pmod(node, {exact.BITS})").alias("bit"))
    bitmap = bits.groupBy(F.expr(f"bit div {exact.CELL}").alias("cell")).agg(F.bitmap_construct_agg(F.col("bit") % exact.CELL).alias("bits"))
    return exact._marked(rows, bitmap, "node")


def _printed(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...) -> (node, size, print, keys, row), written to the shared folder: the one pass over all texts in Python."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in b.column(at).to_pylist():
                own = words(t)
                own_shingles = shingles(own)
                nodes.append(node(own))
                sizes.append(len(own_shingles))
                prints.append(simhash.fingerprint(t, SHINGLE_WORDS))
                keys += buckets(own_shingles)
            ends = pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32())
            row = pa.StructArray.from_arrays(b.columns, names=b.schema.names)
            yield pa.RecordBatch.from_arrays([_longs(nodes), pa.array(sizes, pa.int64()), _longs(prints), pa.ListArray.from_arrays(ends, _longs(keys)), row], ["node", "size", "print", "keys", "row"])

    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    path = f"{shared_folder(docs.sparkSession)}/near-copies-{uuid4().hex}"
    map_arrow(docs, run, f"node long, size long, print long, keys array<long>, row struct<{row}>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _alike(prints: DataFrame) -> DataFrame:
    """prints: (node, print, ...) -> (u, v): candidate pairs by SimHash. Nodes of one fingerprint are linked to the least of them, and those by the BK-trees' links."""
    nodes = prints.select("node", "print").distinct()
    least = cut(nodes.groupBy("print").agg(F.min("node").alias("least")))
    within = nodes.join(least, "print").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda c, name: least.select(F.col("print").alias(c), F.col("least").alias(name))
    between = simhash.links(least.select("print")).join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    return cut(within.unionByName(between).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, sketch), the sketch followed by the keys of the text's buckets"""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(own) + np.array(buckets(own), np.uint64).tobytes() for own in (shingles(words(t)) for t in b.column(1).to_pylist())], pa.binary())], ["node", "sketch"])


def with_first(nodes: list[int], sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket's first text with the others, where sizes allow the similarity."""
    for j in range(1, len(nodes)):
        if min(sizes[0], sizes[j]) >= SIMILARITY * max(sizes[0], sizes[j]):
            yield nodes[0], nodes[j]


def of_unlike_roots(nodes: list[int], sizes: list[int], roots: list[int], sketches: list[bytes], key: int | None = None) -> Iterator[tuple[int, int]]:
    """All pairs of a bucket of unlike roots, but for the first text's, whose sizes and sketches allow the similarity.

    key: of the bucket; a pair comes only in the first of the buckets that it shares.
    """
    size, root = np.array(sizes), np.array(roots)
    byte = np.frombuffer(b"".join(x[:SKETCH] for x in sketches), np.uint8).reshape(len(nodes), SKETCH)
    own = None if key is None else np.frombuffer(b"".join(x[SKETCH:] for x in sketches), np.int64).reshape(len(nodes), BANDS)
    for i in range(2, len(nodes)):
        j = 1 + np.flatnonzero((root[1:i] != root[i]) & (np.minimum(size[1:i], size[i]) >= SIMILARITY * np.maximum(size[1:i], size[i])))
        if own is not None:
            j = j[own[i][(own[j] == own[i]).argmax(axis=1)] == key]
        for k in j[(byte[j] == byte[i]).mean(axis=1) >= AGREE].tolist():
            yield nodes[k], nodes[i]


def _pairs(rows: DataFrame, again: bool) -> DataFrame:
    """rows: (key, node, size), with root and sketch for the second time -> (u, v) distinct candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and node, in batches that don't heed the buckets' ends."""

        def bucket() -> Iterator[tuple[int, int]]:
            if len(held) > 1:
                keys, *rest = map(list, zip(*held, strict=True))
                yield from of_unlike_roots(*rest, keys[0]) if again else with_first(*rest)

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["u", "v"])

        held: list[tuple] = []
        pairs: list[tuple[int, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[0][0]:
                    for p in bucket():
                        pairs.append(p)
                        if len(pairs) == PAIRS:
                            yield out(pairs)
                            pairs = []
                    held = []
                held.append(row)
        for p in bucket():
            pairs.append(p)
            if len(pairs) == PAIRS:
                yield out(pairs)
                pairs = []
        if pairs:
            yield out(pairs)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(rows.repartition(n, "key").sortWithinPartitions("key", "node").select("key", "node", "size", *["root", "sketch"] * again), run, "u long, v long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, a, b) -> the (u, v) whose texts a and b are similar enough."""
    for batch in batches:
        near = [jaccard(shingles(words(a)), shingles(words(b))) >= SIMILARITY for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    joined = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return cut(map_arrow(joined.select("u", "v", "a", "b"), _verify, "u long, v long"))


def groups(docs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """docs: (doc_id, text, ...) -> (node, root, first): each node that has near copies, its group's root and the node that survives.

    That is the one of least doc_id (none before any), of equal ones the least node. prints: those of docs, if made before.
    """
    prints = _printed(docs.select("doc_id", "text")) if prints is None else prints
    keyed = prints.select("node", "size", "keys").dropDuplicates(["node"]).select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    rows = cut(keyed.join(shared, "key"))
    alike = _alike(prints)
    met = rows.select("node").unionByName(alike.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    candidates = _may_be(prints.select("node", "row.text"), met).filter("survives")
    texts = cut(candidates.groupBy("node").agg(F.min("text").alias("text")).join(met, "node"))
    near = _verified(_pairs(rows, False).unionByName(alike).distinct(), texts)
    known = cut(components(near))
    rooted = rows.join(known, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    open_rows = rooted.join(open_keys, "key")
    sketches = cut(map_arrow(texts.join(open_rows.select("node").distinct(), "node").select("node", "text"), _sketches, "node long, sketch binary"))
    more = _verified(_pairs(open_rows.join(sketches, "node"), True), texts)
    nodes = components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    least = prints.groupBy("node").agg(F.min(F.struct("row.doc_id")).alias("doc"))
    named = cut(nodes.join(least, "node"))
    first = named.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first")).select("root", F.col("first.node").alias("first"))
    return named.join(first, "root").select("node", "root", "first")


def drop(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...), one row of each group of near copies, all columns as they are.

    A group is what chains of pairs of similarity SIMILARITY or more join; texts of the same
    words are always one, and so are null, empty and blank ones. The row of least doc_id
    stays, one without an id before any; of repeated ids the least node, then the least row. Names of other columns are free.
    """
    prints = _printed(docs)
    lost = cut(groups(docs, prints).filter("node <> first").select("node"))
    repeated = prints.groupBy("node").count().filter("count > 1").select("node")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = prints.select("node", F.struct("row.doc_id", "row.text", *[F.col(f"row.`{c}`") for c in rest]).alias("row"))
    marked = _may_be(rows, lost.unionByName(repeated))
    one = marked.filter("survives").groupBy("node").agg(F.min("row").alias("row")).join(lost, "node", "left_anti")
    kept = marked.filter("not survives").select("row").unionByName(one.select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

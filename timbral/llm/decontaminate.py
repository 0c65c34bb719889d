"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A benchmark item's windows of WINDOW words (shorter items are one window) are sets of
SHINGLE-word shingles. Containment must be whole, so each window needs one prefix token
only: its rarest shingle. Shingles are ordered by rarity with counts over all documents, made by one
scan; the prefix alone is then joined, by a second scan that splits only texts in which a prefix may
occur. Its matches are cut down by position and length and the window's words compared exactly.

What may occur is told by bitmaps of hashes, in words of 64 bits: BITS / 64 rows at most, however large the
benchmark and the corpus, so they are broadcast, and nothing else passes an exchange but
hashes and the few words around a prefix token. A bit set by another hash costs a
comparison and changes no result. The prefix is broadcast if it has BROADCAST_ROWS rows at most; beyond it that join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import cut

WINDOW, SHINGLE = 10, 5
BROADCAST_ROWS = 500_000
#: Bits of a bitmap; it is broadcast as up to BITS / 64 rows of 16 bytes.
BITS = 1 << 26
SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # A-Z are words' letters here; case is folded later
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> F.Column:
    """Words in their own case."""
    return F.expr(f"filter(split(coalesce({column}, ''), '{SEPARATORS}'), w -> w <> '')")


def _shingles(k: int) -> str:
    """Hashes of all shingles of the array `low`, in order: candidates only, words are compared after."""
    at = ", ".join(f"low[i + {j}]" if j else "low[i]" for j in range(k))
    return f"CASE WHEN size(low) >= {k} THEN transform(sequence(0, size(low) - {k}), i -> xxhash64({at})) ELSE array() END"


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words): the windows of all items, A-Z in lower case; each once per item."""
    low = F.expr(f"transform(words, w -> translate(w, '{UPPER}', '{LOWER}'))")
    items = benchmark.select("item_id", _words("text").alias("words")).select("item_id", low.alias("words")).filter("size(words) > 0")
    return items.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {window}, 0)), i -> slice(words, i + 1, {window}))")).alias("words")).distinct()


def _bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits) of the hashes."""
    bit = hashes.select(F.expr(f"pmod({column}, {BITS})").alias("bit"))
    return bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def _may_be(rows: DataFrame, bitmap: DataFrame, column: str) -> DataFrame:
    """The rows whose hash may be one of the bitmap's."""
    met = rows.withColumn("word", F.expr(f"pmod({column}, {BITS}) div 64")).join(F.broadcast(bitmap), "word")
    return met.filter(F.expr(f"bit_get(bits, cast(pmod({column}, {BITS}) % 64 as int)) = 1")).drop("word", "bits")


def _low(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, _words("text").alias("words")).withColumn("low", F.expr("transform(words, w -> lower(w))"))


def _found(docs: DataFrame, windows: DataFrame, k: int, window: int) -> DataFrame:
    """(doc_id, text_hash, start, stop, item) of the windows, which have k words or more, that docs: (doc_id, text, text_hash) hold."""
    tokens = cut(windows.select("item_id", "words", F.posexplode(F.expr(_shingles(k))).alias("offset", "h")))
    # 1: how often each of the benchmark's shingles occurs, and in which texts
    seen = _low(docs, "text_hash").select("text_hash", F.explode(F.expr(_shingles(k))).alias("h"))
    met = cut(_may_be(seen, _bitmap(tokens, "h"), "h"))
    rare = met.groupBy("h").agg(F.count("*").alias("n"))
    # 2: the rarest shingle of each window; a window with one that never occurs is nowhere
    chosen = tokens.join(rare, "h", "left").groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("t")).filter("t.n > 0")
    prefix = cut(chosen.select("item_id", F.col("words").alias("wanted"), F.col("t.h").alias("h"), F.col("t.offset").alias("offset")))
    held = prefix.count()
    # 3: only texts with a chosen shingle are split again, and only the words around it are compared
    at = _bitmap(prefix, "h")
    texts = _may_be(docs, _bitmap(_may_be(met, at, "h"), "text_hash"), "text_hash")
    reach = window - k
    around = (
        _may_be(_low(texts, "doc_id", "text_hash").select("doc_id", "text_hash", "words", F.posexplode(F.expr(_shingles(k))).alias("p", "h")), at, "h")
        .select("doc_id", "text_hash", "h", "p", F.greatest(F.col("p") - reach, F.lit(0)).alias("near_at"), F.expr(f"slice(words, greatest(p - {reach}, 0) + 1, {2 * reach + k})").alias("near"))
    )
    # where the window would start, in the document and in what was kept around the shingle
    return (
        around.join(F.broadcast(prefix) if held <= BROADCAST_ROWS else prefix, "h").withColumn("start", F.expr("p - offset"))
        .filter("start >= near_at and start - near_at + size(wanted) <= size(near)")
        .filter(F.expr(f"transform(slice(near, start - near_at + 1, size(wanted)), w -> translate(w, '{UPPER}', '{LOWER}')) = wanted"))
        .select("doc_id", "text_hash", "start", F.expr("start + size(wanted)").alias("stop"), F.col("item_id").cast("string").alias("item"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, starts array<struct<start, stop>>, items array<string>) of the documents with a hit."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    windows = cut(_windows(benchmark, window)).withColumn("low", F.expr("transform(words, w -> lower(w))"))
    parts = [(SHINGLE, windows.filter(f"size(words) >= {SHINGLE}")), (1, windows.filter(f"size(words) < {SHINGLE}"))]
    found = [_found(own, these, k, window) for k, these in parts if not these.isEmpty()]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, starts array<struct<start int, stop int>>, items array<string>")
    all_ = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return all_.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("starts"), F.sort_array(F.collect_set("item")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: (doc_id, text, ...), benchmark: (item_id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    One row per row of docs. Texts without words, null ones too, have no hits and hit nothing; null
    ids stay; repeated rows have equal results; an item whose id repeats counts once, one whose id
    is null hits words but is no item in the list. Empty tables give no rows, or rows without hits.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(_words("text")).cast("long").alias("n_words"))
    found = hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    covered = "aggregate(starts, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct('n', a.n + greatest(x.stop - greatest(x.start, a.end), 0), 'end', greatest(a.end, x.stop)), a -> a.n)"
    joined = own.join(found, F.expr("doc_id <=> d and text_hash <=> t"), "left")
    n_hit = F.coalesce(F.expr(covered), F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    found = hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & F.xxhash64(docs["text"]).eqNullSafe(found["t"]), "left_anti")

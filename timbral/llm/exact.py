"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

A first scan keeps two numbers of each text. Lengths that two rows share survive; of their
rows, the (length, prefix hash) pairs that two rows share; only rows of those are hashed in
full, by a second scan, and grouped by it. What survives a step goes on as a bitmap of BITS
bits that Spark combines: its size doesn't depend on the data, so it may be broadcast, and
no text passes a shuffle. Two keys on one bit cost a needless full hash and change no
result, as full hashes decide.

Rows meet the figures of their group in two ways: groups with more than one row in HOT of
all (at most HOT of them, whatever the data) are broadcast, so the rows of a hot group stay
where they are; the others are joined by hash and none is larger than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import cut

#: Code points of the normalised text that the prefix hash reads.
PREFIX = 256
#: Bits of a bitmap of survivors (8 MB), kept in cells of CELL bits.
BITS, CELL = 1 << 26, 1 << 15
#: A group is hot with more than one row in so many.
HOT = 4096
SPACE = r"[\x20\x09-\x0D]+"

LENGTH, PAIR = "n", "xxhash64(n, prefix)"
IS_SET = f"shiftright(cast(conv(hex(substring(bits, cast(bit % {CELL} div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1"


def normal(text: str = "text") -> F.Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.length("norm").cast("long")).withColumn("prefix", F.xxhash64(F.substring("norm", 1, PREFIX)))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """(cell, bits): the bitmap of the keys that two rows or more have."""
    bits = rows.groupBy(F.expr(key).alias("key")).count().filter("count > 1").select(F.expr(f"pmod(key, {BITS})").alias("bit"))
    return bits.groupBy(F.expr(f"bit div {CELL}").alias("cell")).agg(F.bitmap_construct_agg(F.col("bit") % CELL).alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, key: str) -> DataFrame:
    """rows with `survives`: whether the bit of their key is set. The bitmap has BITS / CELL rows at most."""
    placed = rows.withColumn("bit", F.expr(f"pmod({key}, {BITS})")).withColumn("cell", F.expr(f"bit div {CELL}"))
    return placed.join(F.broadcast(bitmap), "cell", "left").withColumn("survives", F.coalesce(F.expr(IS_SET), F.lit(False))).drop("bit", "cell", "bits")


def groups(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, text_hash, keep_id, group_size, kept), one row per row of docs.

    Texts are equal when they are without white space; null counts as empty, and empty texts
    are equal to one another. Of equal texts the row with the most code points in the original
    text stays, then that of the least doc_id (a null id comes last), then one of those that
    share both: a repeated row stays once. keep_id is null where the row that stays has no
    id. text_hash is that of the original text; with `digest`, text_sha256 of the normalised one is a
    column too (of every row, so all texts are hashed; the groups don't need it). An empty table gives no rows; other columns are dropped.
    """
    own = docs.select("doc_id", "text", normal().alias("norm"))
    numbers = cut(_sized(own).select("n", "prefix"))
    alike = _marked(numbers, _shared(numbers, LENGTH), LENGTH).filter("survives")
    marked = _marked(_sized(own.withColumn("row", F.monotonically_increasing_id())), _shared(alike, PAIR), PAIR)
    if digest:
        marked = marked.withColumn("text_sha256", F.sha2("norm", 256))
    also = ["text_sha256"] if digest else []
    full = F.when(F.col("survives"), F.unhex(also[0] if also else F.sha2("norm", 256))).alias("full")
    rows = cut(marked.select("doc_id", "row", F.xxhash64("text").alias("text_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), *also, full))
    return _with_groups(rows, also)


def _with_groups(rows: DataFrame, also: list[str]) -> DataFrame:
    first = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    sizes = cut(rows.filter("full is not null").groupBy("full").agg(F.count("*").alias("size"), first.alias("best")).filter("size > 1"))
    most = rows.count() // HOT + 1
    out = ["doc_id", "text_hash", *also, "row"]
    hot = rows.join(F.broadcast(sizes.filter(F.col("size") > most)), "full", "left")
    cold = hot.filter("size is null and full is not null").drop("size", "best").join(sizes.filter(F.col("size") <= most), "full", "left")
    alone = hot.filter("size is null and full is null")
    met = hot.filter("size is not null").unionByName(cold).unionByName(alone).select(*out, "size", "best")
    return met.select(
        "doc_id", "text_hash", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"), *also,
    )


def drop(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat both id and text, one."""
    of_row = F.struct(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    keys = cut(groups(docs).groupBy(of_row.alias("key")).agg(F.bool_or("kept").alias("stays"), F.bool_and("kept").alias("whole")).filter("not whole").select("key.*", "stays"))
    mine = docs["doc_id"].eqNullSafe(keys["of_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["of_hash"])
    others = docs.join(keys, mine, "left_anti")
    again = docs.join(keys.filter("stays"), mine).select(*[docs[c] for c in docs.columns], F.struct("of_id", "of_hash").alias("_row")).dropDuplicates(["_row"]).drop("_row")
    return others.unionByName(again)

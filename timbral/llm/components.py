"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014).

Every round is two grouped minima (combined before the shuffle) and two equi-joins
that adaptive execution can split, so a node with very many links is no single task's
work; nothing is collected but one count a round. Links grow fewer from round to round, so
that count also says how many partitions the next round needs: a small table has few tasks
and files in each of a round's exchanges, however many partitions the session's shuffles have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import cut

MAX_ROUNDS = 60
#: A round has a partition for so many links, SMALLEST at least and the session's number at most.
LINKS, SMALLEST = 1 << 16, 8


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges: (a, b), a < b. Links neighbours of each node to the least of them and the node itself."""
    near = (
        edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        if large
        else edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
    )
    least = near.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    joined = near.join(least, "n")
    if large:
        out = joined.filter("m > n").select(F.col("low").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("low").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("low").alias("a"), F.col("n").alias("b")))
    return out.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def _size(edges: DataFrame) -> tuple:
    """The number of links and a sum of their hashes, which tells two rounds' links apart."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) of longs, in any order and with repeats -> (node, root), one row per linked node.

    root is the least node of the component and has a row of its own. Links of a node to
    itself and links with a null end are ignored; no links give no rows.
    """
    edges = cut(
        links.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    )
    sign = _size(edges)
    for _ in range(MAX_ROUNDS):
        parts = max(SMALLEST, -(-sign[0] // LINKS))
        edges = cut(_star(_star(edges.coalesce(parts), True, parts), False, parts))
        now = _size(edges)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

"""Places of rows in any order, over a table or within groups, without a window over either.

Rows are dealt by range of (group, order), with bounds that Spark samples, and sorted within
their partition, where they count themselves by monotonically_increasing_id. What came before a partition's share of
a group is an exclusive sum over the counts of such shares, of which there are no more than groups and
partitions together. So a group that has a third of all rows is numbered by as many tasks as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.shared import cut


def numbered(df: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "place", total: str | None = None) -> DataFrame:
    """df with `name`: the row's place from 0 in `order` within its group, and with `total`: the group's rows.

    Rows that are equal in all of order have places next to one another, in no stated order. Null groups and keys are
    groups and keys like others; nulls come first, as in sort.
    """
    own = df.columns
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    sorts = [F.col(c) for c in by] + columns
    laid = df.repartitionByRange(*sorts).sortWithinPartitions(*sorts) if sorts else df
    at = F.monotonically_increasing_id()
    rows = cut(laid.select(*own, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # a group's rows in a partition stand together, from _from on
    shares = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        shares = shares.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    keys = [c.replace("`", "") for c in ("_part", *by)]
    side = shares.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(keys)], "_from", "_before", *(["_total"] if total else []))
    if not by:
        side = F.broadcast(side)  # a row a partition
    met = rows.join(side, [rows[c].eqNullSafe(side[f"_s{i}"]) for i, c in enumerate(keys)])
    place = (F.col("_at") - F.col("_from") + F.col("_before")).cast("long").alias(name)
    return met.select(*own, place, *([F.col("_total").alias(total)] if total else []))

"""Exact quantiles of groups of any size, by histogram refinement.

Groups of at most GROUP rows (or one row in SHARE of all, whichever is more) are sorted within the
group. Others, at most SHARE of them whatever the data, are never brought together: their range is cut
into BUCKETS equal parts, rows are counted by part (combined before the shuffle), and only the parts that hold
a wanted rank are cut again, within their own least and greatest value, until they are small or hold
one value. A row is read again only where its part still matters, and the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.shared import cut

GROUP, SHARE, BUCKETS = 100_000, 4096, 4096
#: Rounds at most: each leaves a part with one value or 1/BUCKETS of its range, and doubles span some 2^2100.
ROUNDS = 200


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def _bucket() -> Column:
    """The part of [low, high] that v is in; infinities and NaN, which counts as the greatest, have parts of their own. Monotone in v, as each step rounds monotonically."""
    v, low, high = F.col("v") / 2, F.col("low") / 2, F.col("high") / 2
    inner = F.when(high > low, F.least(F.floor((v - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    return F.when(F.isnan("v"), BUCKETS + 1).when(F.col("v") == float("inf"), BUCKETS).when(F.col("v") == float("-inf"), -1).otherwise(inner).cast("long")


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """(by, names): for each of shares the value at share x (n - 1), interpolated between neighbours; null values don't count, groups without others have no row.

    The same as an exact percentile; NaN is greater than all, null groups are groups like others.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"))
    finite = F.when(_finite(F.col("v")), F.col("v"))
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")))
    most = max(GROUP, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SHARE)
    h = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ranks = F.array(*[F.struct(F.lit(2 * i + j).alias("i"), f(x).cast("long").alias("rank")) for i, x in enumerate(h) for j, f in enumerate((F.floor, F.ceil))])
    hot = sizes.filter(F.col("n") > most).select(*keys, "low", "high", F.lit("").alias("part"), F.lit(float("-inf")).alias("least"), F.lit(float("nan")).alias("most"), ranks.alias("wanted"))
    found, cold = [], rows
    if not hot.isEmpty():
        cold = _meet(rows, hot, keys, "left_anti")
        found = _refined(rows, hot, keys, most)
    values = _cold(cold, keys, ranks)
    for f in found:
        values = values.unionByName(f)
    at = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("at"))
    side = sizes.select(*[F.col(k).alias(f"_o{k}") for k in keys], "n")
    out = at.join(side, [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys])
    low, high = (lambda i: F.col("at")[F.lit(2 * i)]), (lambda i: F.col("at")[F.lit(2 * i + 1)])
    rest = lambda i: h[i] - F.floor(h[i])
    between = [F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * rest(i)).alias(nm) for i, nm in enumerate(names)]
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *between)


def _meet(rows: DataFrame, parts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows and the parts of hot groups, which are few whatever the data."""
    side = F.broadcast(parts.withColumnsRenamed({k: f"_o{k}" for k in keys}))
    return rows.join(side, [rows[k].eqNullSafe(side[f"_o{k}"]) for k in keys] or F.lit(True), how)


def _refined(rows: DataFrame, hot: DataFrame, keys: list[str], most: int) -> list[DataFrame]:
    """(keys, i, v) of the wanted ranks of hot groups, round by round."""
    found, part = [], [*keys, "part"]
    inside = F.col("v").between(F.col("least"), F.col("most"))
    for _ in range(ROUNDS):
        met = _meet(rows, hot, keys).filter(inside).withColumn("bucket", _bucket())
        counts = met.groupBy(*part, "bucket").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("wanted").alias("wanted"))
        placed = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*part).orderBy("bucket")) - F.col("m"))
        own = F.filter("wanted", lambda x: x["rank"].between(F.col("before"), F.col("before") + F.col("m") - 1))
        shifted = F.transform(own, lambda x: F.struct(x["i"].alias("i"), (x["rank"] - F.col("before")).alias("rank")))
        held = cut(placed.withColumn("wanted", shifted).filter("size(wanted) > 0").withColumn("part", F.concat_ws("/", "part", F.col("bucket").cast("string"))).drop("bucket", "before"))
        found.append(held.filter("least = most").select(*keys, F.explode("wanted").alias("x"), "least").select(*keys, F.col("x.i").alias("i"), F.col("least").alias("v")))
        many = held.filter("least < most")
        small = _meet(rows, many.filter(F.col("m") <= most).drop("m"), keys).filter(inside)
        at = small.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("v")) - 1)
        found.append(_at_ranks(at, F.col("wanted"), keys))
        hot = many.filter(F.col("m") > most).withColumn("low", F.col("least")).withColumn("high", F.col("most")).drop("m")
        if hot.isEmpty():
            return found
    raise RuntimeError(f"quantiles did not settle in {ROUNDS} rounds")


def _at_ranks(placed: DataFrame, wanted: Column, keys: list[str]) -> DataFrame:
    own = placed.withColumn("x", F.explode(F.filter(wanted, lambda x: x["rank"] == F.col("_r"))))
    return own.select(*keys, F.col("x.i").alias("i"), "v")


def _cold(rows: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """Groups of bounded size, each sorted whole."""
    group = Window.partitionBy(*keys)
    placed = rows.withColumn("n", F.count("*").over(group)).withColumn("_r", F.row_number().over(group.orderBy("v")) - 1)
    return _at_ranks(placed, ranks, keys)

"""Profiling operators: crosstabs, distributions, rankings and set comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.draws import shuffle_key
from timbral.operators.numbering import numbered
from timbral.operators.quantiles import quantiles

#: Vectors of a block of pairwise.
BLOCK = 512


def crosstab(df: DataFrame, row: str, column: str, values: list[str], distinct: str | None = None) -> DataFrame:
    """Counts (of rows, or of distinct values) by row and column, 0 where there are none."""
    grouped = df.groupBy(row).pivot(column, values)
    return (grouped.agg(F.countDistinct(distinct)) if distinct else grouped.count()).na.fill(0)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles by group; a group of any size is never one task's work. Groups without values have nulls."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    names = ["q25", "q50", "q75"]
    q = quantiles(df, by, value, [0.25, 0.5, 0.75], names).withColumnsRenamed({b: f"_q_{b}" for b in by})
    joined = plain.join(q, [plain[b].eqNullSafe(q[f"_q_{b}"]) for b in by], "left")
    return joined.select(*by, "n", "mean", "std", "min", *[F.round(x, 6).alias(x) for x in names], "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def stratified(df: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, chosen by keyed hash."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(key, seed=seed), key))).filter(F.col("_r") <= most).drop("_r")


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For each key: rows on either side, and where it is."""
    left, right = a.groupBy(key).agg(F.count("*").alias("n_left")), b.groupBy(key).agg(F.count("*").alias("n_right"))
    side = F.when(F.col("n_left").isNull(), "right").when(F.col("n_right").isNull(), "left").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("side", side).na.fill(0, ["n_left", "n_right"])


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean vector of each group: components are averaged by (group, place), partially before the shuffle."""
    means = vectors.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("v"))
    back = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return back.select(group, F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("centroid"))


def pairwise(c: DataFrame, group: str, vector: str, least: float | None = None) -> DataFrame:
    """(a, b, cosine): dot products of all pairs of groups a < b, or of those of at least `least`.

    Groups are numbered in order and cut into blocks of BLOCK; a pair of blocks is one product of two
    matrices, so a vector is sent once for each block and a task holds two blocks. No row is
    made for a place of a vector, nor for a pair under `least`. Vectors are unit vectors of one length.
    """
    placed = numbered(c.select(group, vector), [group], name="_at").withColumn("_b", F.floor(F.col("_at") / BLOCK).cast("int"))
    last = placed.agg(F.coalesce(F.max("_b"), F.lit(-1))).first()[0]
    rows = placed.select(F.explode(F.sequence(F.lit(0), F.lit(max(last, 0)))).alias("_o"), group, vector, "_at", "_b")
    keyed = rows.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    kind = c.schema[group].dataType.simpleString()

    def product(p: pd.DataFrame) -> pd.DataFrame:
        first, second = (p[p["_b"] == p[side].iloc[0]].sort_values("_at") for side in ("_i", "_j"))
        x, y = (np.array(q[vector].tolist(), float).reshape(len(q), -1) for q in (first, second))
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        dots = x @ y.T
        wanted = first["_at"].to_numpy()[:, None] < second["_at"].to_numpy()[None, :]
        if least is not None:
            wanted &= dots >= least
        i, j = np.nonzero(wanted)
        return pd.DataFrame({"a": first[group].to_numpy()[i], "b": second[group].to_numpy()[j], "cosine": dots[i, j]})

    return keyed.groupBy("_i", "_j").applyInPandas(product, f"a {kind}, b {kind}, cosine double")


def off_diagonal(c: DataFrame, vector: str) -> DataFrame:
    """(pairs, mean_cosine) of all pairs of unit vectors: (|sum|^2 - sum of |v|^2) / (n (n - 1)); sums by place, combined before the shuffle. Fewer than two give no pairs and a null."""
    places = c.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    one = places.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("cross"))
    return one.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.when(F.col("n") > 1, F.col("cross") / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def tree_counts(files: DataFrame, wanted: F.Column) -> DataFrame:
    """files: (rel array<string>, ...) -> (folder, files, direct): of the folders that directly hold a wanted file, or have one that does below them, how many files such folders hold.

    direct are the files of the folder itself, 0 where it holds no wanted one; files are those of it and of all such folders below. The root
    is the empty folder. Counts are made by folder before its ancestors are laid out, so a row is repeated by depth only.
    """
    folder = F.slice("rel", F.lit(1), F.size("rel") - 1)
    own = files.groupBy(folder.alias("parts")).agg(F.count("*").alias("direct"), F.bool_or(wanted).alias("holds")).filter("holds")
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), "/").alias("folder"), (k == F.size("parts")).alias("own")))
    laid = own.select("direct", F.explode(above).alias("x"))
    return laid.groupBy("x.folder").agg(F.sum("direct").alias("files"), F.sum(F.when(F.col("x.own"), F.col("direct")).otherwise(0)).alias("direct"))


def lists_by(df: DataFrame, group: str, key: str, values: list[str], item: str) -> DataFrame:
    """(group, a sorted list of items for each of values): empty where there are none. A row is a group's; where a group is too large for one, its counts are what to ask for."""
    lists = [F.array_sort(F.collect_list(F.when(F.col(key) == v, F.col(item)))).alias(v) for v in values]
    return df.groupBy(group).agg(*lists)


def latest_numbered(names: DataFrame, name: str, prefix: str = "checkpoint-") -> DataFrame:
    """(name, number): the one with the greatest number behind the prefix; names of another form don't count."""
    number = F.regexp_extract(name, f"^{prefix}.*?([0-9]+)$", 1)
    return names.filter(number != "").agg(F.max_by(name, number.cast("long")).alias(name), F.max(number.cast("long")).alias("number"))

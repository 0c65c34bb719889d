"""How many rows each clip becomes. All arithmetic is in doubles: a decimal literal would round differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.functions import strategy


def factor(total: Column, share: Column | float, own: Column) -> Column:
    """max(1, ceil(total * share / own)); an empty class is a division by zero, which is an error."""
    share = F.lit(float(share)) if isinstance(share, int | float) else share
    return F.greatest(F.lit(1), F.ceil(total.cast("double") * share / own.cast("double")).cast("long")).cast("long")


def balanced(counts: DataFrame, ratio: Column | float, times: Column | int) -> DataFrame:
    """counts: (n_bonafide, n_spoof, ...) -> with bonafide_factor, spoof_factor, what they give, and the share of clean rows."""
    times = F.lit(times) if isinstance(times, int) else times
    ratio = F.lit(float(ratio)) if isinstance(ratio, int | float) else ratio
    b, s = F.col("n_bonafide"), F.col("n_spoof")
    total = (b + s) * times
    out = counts.withColumn("bonafide_factor", factor(total, ratio, b)).withColumn("spoof_factor", factor(total, F.lit(1.0) - ratio, s))
    return achieved(out)


def simple(counts: DataFrame, times: int) -> DataFrame:
    return achieved(counts.withColumn("bonafide_factor", F.lit(times).cast("long")).withColumn("spoof_factor", F.lit(times).cast("long")))


def achieved(df: DataFrame) -> DataFrame:
    b, s = F.col("n_bonafide") * F.col("bonafide_factor"), F.col("n_spoof") * F.col("spoof_factor")
    clean = F.col("n_bonafide") + F.col("n_spoof")
    return (
        df.withColumn("bonafide_rows", b).withColumn("spoof_rows", s).withColumn("total_rows", b + s)
        .withColumn("bonafide_pct", F.round(F.lit(100.0) * b / (b + s), 6)).withColumn("clean_pct", F.round(F.lit(100.0) * clean / (b + s), 6))
        .withColumn("total_factor", F.round((b + s) / clean, 6))
    )


def by_class(factors: DataFrame) -> DataFrame:
    """One row of factors -> two rows (file_type, factor): a side of two rows, small whatever the data."""
    return factors.select(F.explode(F.array(
        F.struct(F.lit("bonafide").alias("file_type"), F.col("bonafide_factor").alias("factor")), F.struct(F.lit("spoof").alias("file_type"), F.col("spoof_factor").alias("factor")),
    )).alias("x")).select("x.*")


def planned(n: Column, times: Column) -> dict[str, Column]:
    """Rows per type where `times` counts extra copies; each part is cut to an integer and the rest is lost."""
    extra = n.cast("double") * times.cast("double")
    parts = {k: F.floor(extra * F.lit(p)).cast("long") for k, p in strategy.TYPE_MIX.items()}
    return parts | {"originals": n.cast("long"), "total": (n + n * times).cast("long")}


def parse_factor(c: Column) -> Column:
    """'3x' -> 3; anything else is null."""
    return F.when(c.rlike("^[+-]?[0-9]+x$"), F.regexp_replace(c, "x", "").cast("long"))

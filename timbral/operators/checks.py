"""Assertions on tables: each gives rows of what is wrong, or a verdict that needs no rows on the driver but one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.functions import labels
from timbral.operators import corpus


def required_columns(df: DataFrame, names: list[str]) -> tuple[bool, str]:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        return False, f"missing columns: {', '.join(missing)}"
    return (False, "no rows") if df.isEmpty() else (True, "ok")


def bank(vectors: DataFrame, size: int, key: str = "speaker_id", vector: str = "embedding") -> DataFrame:
    """Vectors, all of them and not the first alone, that have another size or a value that isn't a number."""
    bad = F.when(F.size(vector) != size, F.lit("size")).when(F.exists(vector, lambda v: F.isnan(v) | v.isNull()), F.lit("not a number"))
    return vectors.select(key, bad.alias("problem")).filter("problem is not null")


def layout(files: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Speakers that lack a split."""
    return files.groupBy("speaker_id").agg(F.array_sort(F.array_except(F.array(*map(F.lit, splits)), F.collect_set("split"))).alias("missing")).filter("size(missing) > 0")


def shares(distribution: DataFrame) -> DataFrame:
    """(dist, p) -> (dist, total, valid): shares sum to 1 within a hundredth."""
    return distribution.groupBy("dist").agg(F.round(F.sum("p"), 6).alias("total"), (F.abs(F.sum("p") - 1) < 0.01).alias("valid"))


def integrity(files: DataFrame) -> DataFrame:
    """files: (path, folder, speaker_id, filename) -> (path, type, error). A speaker of another country hides what is wrong with its files."""
    f = F.col("filename")
    kind = (
        F.when(F.lower(F.substring("speaker_id", 1, 2)) != labels.folder_country(F.col("folder")), F.lit("speaker")).when(~f.contains("_"), F.lit("name"))
        .when(F.concat_ws("_", F.slice(F.split(f, "_"), 1, 2)) != F.col("speaker_id"), F.lit("owner"))
    )
    text = F.when(kind == "speaker", "country of the folder differs").when(kind == "name", "no underscore").otherwise("another speaker's id")
    return files.select("path", kind.alias("type"), text.alias("error")).filter("type is not null")


def verify(files: DataFrame) -> DataFrame:
    """files: (speaker_id, split, filename, file_type) -> (check, passed, detail): splits are disjoint, classes are there, names are well formed."""
    overlap = corpus.split_overlap(files.select("speaker_id", "split")).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("n"))
    classes = files.groupBy("split").agg(F.countDistinct("file_type").alias("k")).agg(F.count_if(F.col("k") < 2).alias("n"))
    names = files.agg(F.count_if(~labels.valid_name(F.col("filename"))).alias("n"))
    named = [df.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("long").alias("detail")) for name, df in (("independence", overlap), ("classes", classes), ("names", names))]
    return named[0].unionByName(named[1]).unionByName(named[2])

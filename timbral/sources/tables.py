"""Text formats of the corpus as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "file_path string, speaker_id string, country string, gender string, split string, text string"


def protocol(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly four fields; of lines with one audio id the last in the file counts."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("at")).filter("size(f) = 4")
    rows = lines.select(F.col("f")[0].alias("speaker_id"), F.col("f")[1].alias("audio_id"), F.col("f")[2].alias("system_id"), F.col("f")[3].alias("key"), "at")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("audio_id").orderBy(F.desc("at")))).filter("r = 1").drop("r", "at")


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(speaker_id, split) of a JSON object of lists; a list that isn't there is empty."""
    schema = "train array<string>, val array<string>, test array<string>"
    j = spark.read.schema(schema).option("multiLine", "true").json(path)
    pairs = F.flatten(F.array(*[F.expr(f"transform(coalesce({s}, array()), x -> struct(x AS speaker_id, '{s}' AS split))") for s in ("train", "val", "test")]))
    return j.select(F.explode(pairs).alias("p")).select("p.*")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The pipe-separated transcripts, without rows that have no text; file_path becomes audio_path."""
    return spark.read.schema(METADATA).option("sep", "|").option("header", "true").csv(path).dropna(subset=["text"]).withColumnRenamed("file_path", "audio_path")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(step, avg_quality) of a JSON array that may hold bare NaN."""
    return spark.read.schema("step long, avg_quality double").option("multiLine", "true").option("allowNonNumericNumbers", "true").json(path)


def list_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")

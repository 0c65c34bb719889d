"""Clips that arrive: the resumable batch of the corpus as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timbral.operators import corpus


def clip_stream(spark: SparkSession, path: str, schema: str = "clip_id long, speaker_id string, file_type string, technique string, duration double, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def augment_stream(clips: DataFrame, by_class: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every new clip is fanned out and labelled once. Draws are keyed, so a replayed batch makes the same rows, and its folder is overwritten."""

    def batch(rows: DataFrame, n: int) -> None:
        made = corpus.system_ids(corpus.parameters(corpus.fan_out(rows, by_class)))
        made.select("clip_id", "speaker_id", "file_type", "copy", "system_id").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={n}")

    return clips.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(clips: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Clips of each class by event-time window, with a watermark that bounds the state."""
    return clips.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "file_type").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))

"""The corpus' tables, made from a star schema: clips from events, waves from embeddings, transcripts from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, speaker_id, file_type, technique, duration): a speaker id is country, gender and number."""
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*map(F.lit, ("ar", "cl", "co", "pe", "ve"))), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    sex = F.when(F.pmod("user_id", F.lit(2)) == 0, "f").otherwise("m")
    genuine = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("event_id").alias("clip_id"), F.concat(code, sex, F.lit("_"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("speaker_id"),
        F.when(genuine, "bonafide").otherwise("spoof").alias("file_type"), F.when(~genuine, F.col("event_type")).alias("technique"), F.col("value").alias("duration"),
    )


CLIPS_SQL = """clips as (select event_id as clip_id, ['ar','cl','co','pe','ve'][user_id % 5 + 1] || case when user_id % 2 = 0 then 'f' else 'm' end || '_' || lpad(user_id::varchar, 5, '0') as speaker_id,
  case when event_type in ('purchase', 'signup') then 'bonafide' else 'spoof' end as file_type, case when event_type not in ('purchase', 'signup') then event_type end as technique, value as duration from events)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wave_id, label, x array<double>): toy waveforms."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("wave_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


WAVES_SQL = "waves as (select vec_id as wave_id, label::bigint as label, embedding::double[] as x from embeddings)"

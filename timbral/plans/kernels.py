"""Queries through the numpy kernels: no SQL can express them, tests hold them to closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions import signals, strategy
from timbral.operators import corpus, kernels
from timbral.plans.registry import query
from timbral.sources.adapters import waves


def _rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Two augmented copies of each wave, of one kind, with the waves themselves as rooms and noises."""
    w = waves(spark, sf_dir)
    ids = w.select(F.col("wave_id").alias("clip_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("copy")).withColumn("aug", F.lit(kind))
    narrow = corpus.parameters(ids)
    category = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("wave_id") % 3 + 1).cast("int")).alias("category")
    named = w.withColumn("path", F.col("wave_id").cast("string"))
    rooms = named.select(category(list(strategy.ROOM_MIX)), "path", F.col("x").alias("wave"))
    noises = named.select(category(list(strategy.NOISE_MIX)), "path", F.col("x").alias("wave"))
    picked = kernels.with_dictionaries(narrow, {"rir": (rooms, "room"), "noise_wave": (noises, "noise")})
    return picked.join(w.select(F.col("wave_id").alias("clip_id"), "x"), "clip_id")


def _summary(out: DataFrame) -> DataFrame:
    return out.select("clip_id", "copy", F.size("y").alias("samples"), F.round(signals.rms(F.col("y")), 6).alias("rms"), F.round(signals.peak(F.col("y")), 6).alias("peak"))


@query(None)
def wave_codec_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(kernels.augment(_rows(spark, sf_dir, "codec")))


@query(None)
def wave_rawboost_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(kernels.augment(_rows(spark, sf_dir, "rawboost")))


@query(None)
def wave_rir_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(kernels.augment(_rows(spark, sf_dir, "rir")))

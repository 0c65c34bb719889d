"""Where corpora go: protocol text, splits as JSON, transcripts, WAV files, and manifests of what is done."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions.labels import protocol_line
from timbral.functions.shared import exists
from timbral.operators.kernels import WAVE_ROWS
from timbral.sinks import tree


def write_protocol(p: DataFrame, path: str) -> None:
    """Sorted lines below split=.../; a split without rows has no folder. Each split is range-partitioned by id, so no task holds it all."""
    lines = p.select("split", "audio_id", protocol_line("speaker_id", "audio_id", "system_id", "key").alias("value"))
    lines.repartitionByRange("split", "audio_id").sortWithinPartitions("split", "audio_id").select("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def write_splits(members: DataFrame, path: str) -> None:
    """One JSON object of sorted lists. Speakers are a dimension; the file's form asks for one row."""
    lists = members.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("speaker_id")))).alias(s) for s in ("train", "val", "test")])
    lists.select(F.to_json(F.struct("train", "val", "test")).alias("value")).write.mode("overwrite").text(path)


def write_metadata(t: DataFrame, path: str) -> None:
    t.write.mode("overwrite").option("sep", "|").option("header", "true").csv(path)


def write_tree(rows: DataFrame, path: str) -> None:
    """The primary sink of waveforms: Parquet by split and speaker; dynamic, so a rerun replaces what it makes anew."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "speaker_id").parquet(path)


def wav_files(rows: DataFrame, rate: int = 16000) -> DataFrame:
    """rows: (target, y, ...) -> (target, content): 16-bit WAV files; the columns rate and channels, where there are any, count before the argument."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), WAVE_ROWS):
                some = p[at : at + WAVE_ROWS]
                yield pd.DataFrame({"target": some.target, "content": [_wav(*x) for x in zip(some.y, some.rate, some.channels, strict=True)]})

    has = set(rows.columns)
    own = [F.col(c) if c in has else F.lit(d).alias(c) for c, d in (("rate", rate), ("channels", 1))]
    return rows.select("target", "y", *own).mapInPandas(run, "target string, content binary")


def _wav(y: np.ndarray, rate: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(int(channels))
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes((np.clip(np.asarray(y, float), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def write_wavs(rows: DataFrame, root: str, rate: int = 16000) -> None:
    """rows: (relative, y) -> WAV files below root, published together."""
    tree.write(wav_files(rows.withColumnRenamed("relative", "target"), rate), root)


class Manifest:
    """What a run has done, as an append-only table; a restart takes what isn't in it."""

    def __init__(self, spark: SparkSession, path: str, **keys: str) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def done(self) -> DataFrame | None:
        if not exists(self.spark, self.path):
            return None
        d = self.spark.read.parquet(self.path)
        for k, v in self.keys.items():  # a run resumes only one of the same factor and folder
            d = d.filter(F.col(k) == v)
        return d

    def pending(self, todo: DataFrame, key: str) -> DataFrame:
        d = self.done()
        return todo if d is None else todo.join(d.select(key).distinct(), key, "left_anti")

    def add(self, ids: DataFrame) -> None:
        ids.withColumns({k: F.lit(v) for k, v in self.keys.items()}).write.mode("append").parquet(self.path)

    def progress(self, total: int) -> float:
        d = self.done()
        return 0.0 if not total or d is None else 100.0 * d.count() / total

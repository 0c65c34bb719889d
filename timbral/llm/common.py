"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; with BATCH_BYTES it bounds what a Python worker holds.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As LOWER, and turns what separates words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ into blanks.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else the context's checkpoint folder.

    A local session without either gets a temporary folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="timbral-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS rows and about BATCH_BYTES bytes; the session's settings stay as they are.

    A worker outlasts its tasks, so what Arrow keeps of one for later goes back when the task ends.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.get_total_buffer_size())))
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(sliced(batches))
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)

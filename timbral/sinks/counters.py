"""Nested counters of what a run writes, observed while it writes: status needs no second pass, and a restart goes on from them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from timbral.functions.shared import exists

#: Where a counter stands: ("train", "spoof", "TTS") is counters["train"]["spoof"]["TTS"].
Path = tuple[str, ...]

SCHEMA = "batch string, path array<string>, n long, started double, ended double"


def partition_counts(splits: list[str], techniques: list[str], other: str = "other") -> dict[Path, Column]:
    """Of rows (split, file_type, technique): all, and for each split bonafide and spoof by technique. A technique that isn't named, or none, counts as `other`."""
    counts: dict[Path, Column] = {("rows",): F.lit(True)}
    for split in splits:
        here = F.col("split") == split
        spoof = here & (F.col("file_type") == "spoof")
        counts[split, "bonafide"] = here & (F.col("file_type") == "bonafide")
        for technique in techniques:
            counts[split, "spoof", technique] = spoof & (F.col("technique") == technique)
        counts[split, "spoof", other] = spoof & ~F.coalesce(F.col("technique").isin(techniques), F.lit(False))
    return counts


class Counters:
    """Counters of a run below a path, an append-only table with a few rows a batch. A batch that is run again replaces its own counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, batch: str, counts: dict[Path, Column], write: Callable[[DataFrame], None]) -> dict[Path, int]:
        """Writes rows by `write`, which must run them once, whole; then records how many met each condition.

        Counters come from tasks that end well, so a task tried again counts once. A run that dies between both steps
        has the batch written and not recorded: it is not done, and is written again.
        """
        seen, started = Observation(), time.time()
        write(rows.observe(seen, *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(counts.values())]))
        found = {p: int(seen.get[f"n{i}"]) for i, p in enumerate(counts)}
        ended = time.time()
        new = self.spark.createDataFrame([(batch, list(p), n, started, ended) for p, n in found.items()], SCHEMA)
        new.coalesce(1).write.mode("append").parquet(self.path)
        return found

    def table(self) -> DataFrame:
        """(batch, path, n, started, ended): the last record of each batch."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        own = self.spark.read.schema(SCHEMA).parquet(self.path)
        last = own.groupBy("batch").agg(F.max("ended").alias("ended"))
        return own.join(last, ["batch", "ended"], "left_semi")

    def done(self) -> DataFrame:
        """(batch): what a restart can leave out."""
        return self.table().select("batch").distinct()

    def totals(self) -> DataFrame:
        """(path, n) over all batches."""
        return self.table().groupBy("path").agg(F.sum("n").alias("n"))

    def nested(self) -> dict:
        """The totals as nested dictionaries: a row a counter, whatever the corpus' size."""

        def put(tree: dict, row: tuple) -> dict:
            *folders, name = row.path
            reduce(lambda t, k: t.setdefault(k, {}), folders, tree)[name] = row.n
            return tree

        return reduce(put, self.totals().collect(), {})

    def progress(self, total: int) -> float:
        """Percent of total rows that the counter ("rows",) has; 0 of nothing."""
        return 100.0 * self.nested().get("rows", 0) / total if total else 0.0

    def seconds(self) -> float:
        """From the first batch's start to the last one's end."""
        r = self.table().agg((F.max("ended") - F.min("started")).alias("s")).first()
        return r.s or 0.0

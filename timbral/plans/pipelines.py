"""The corpus from end to end, over tables: partition, augment, verify, sub-sample. Nothing is read twice for a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.functions import factors
from timbral.functions.shared import exists
from timbral.operators import corpus
from timbral.sinks import files
from timbral.sinks.counters import Counters, partition_counts


def partition(clips: DataFrame, seed: int = 42) -> DataFrame:
    """clips with a speaker-disjoint `split` and a `filename` in it."""
    return corpus.file_names(clips).join(corpus.split_speakers(clips, seed), "speaker_id")


def augmented(partitioned: DataFrame, ratio: float, times: int, seed: int = 42) -> DataFrame:
    """The protocol of a balanced corpus: factors come from the training split and hold for it alone."""
    by_class = factors.by_class(corpus.balanced_factors(partitioned.filter("split = 'train'"), ratio, times))
    return corpus.protocol(corpus.with_factor(partitioned, by_class, only=F.col("split") == "train"), seed)


def run(clips: DataFrame, out: str, ratio: float = 0.5, times: int = 3, seed: int = 42) -> DataFrame:
    """Writes the protocol below out, and returns its statistics."""
    p = augmented(partition(clips, seed), ratio, times, seed)
    p.write.mode("overwrite").parquet(f"{out}/protocol.parquet")
    written = clips.sparkSession.read.parquet(f"{out}/protocol.parquet")
    files.write_protocol(written, f"{out}/protocol")
    return corpus.protocol_statistics(written)


def partition_batches(clips: DataFrame, out: str, techniques: list[str], batches: int = 8, seed: int = 42, after: Callable[[int, Counters], None] | None = None) -> Counters:
    """Writes a partition in batches of speakers to {out}/clips, and its counters to {out}/counters, both while rows are written; a restart writes the batches that aren't recorded.

    after(batch, counters) is called when a batch is recorded. Names and splits are settled once, before the first batch, below {out}/named.
    """
    spark, splits = clips.sparkSession, ["train", "val", "test"]
    counters, named, speakers = Counters(spark, f"{out}/counters"), f"{out}/named", f"{out}/speakers"
    done = {r.batch for r in counters.done().collect()}  # a row a batch
    if "speakers" not in done:
        counters.write(corpus.split_speakers(clips, seed), "speakers", {(s, "speakers"): F.col("split") == s for s in splits}, lambda d: d.write.mode("overwrite").parquet(speakers))
    members = spark.read.schema("speaker_id string, split string").parquet(speakers)
    own = corpus.file_names(clips).join(members, "speaker_id").withColumn("batch", F.pmod(F.xxhash64("speaker_id"), F.lit(batches)))
    if not exists(spark, f"{named}/_SUCCESS"):
        own.write.mode("overwrite").partitionBy("batch").parquet(named)
    for b in range(batches):
        if str(b) not in done:
            rows = spark.read.schema(own.schema).parquet(named).filter(F.col("batch") == b).drop("batch")
            counters.write(rows, str(b), partition_counts(splits, techniques), lambda d, b=b: d.write.mode("overwrite").parquet(f"{out}/clips/part={b}"))
            if after:
                after(b, counters)
    return counters


def batch(clips: DataFrame, out: str, names: list[str], ratio: float = 0.5) -> dict[str, str]:
    """A run per factor; one that fails doesn't end the others."""
    status = {}
    for name in names:
        try:
            run(clips, f"{out}/augmented_{name}_balanced_{int(ratio * 100)}{int((1 - ratio) * 100)}", ratio, int(name.removesuffix("x")))
            status[name] = "success"
        except Exception as e:  # noqa: BLE001  the status is the result
            status[name] = f"{type(e).__name__}: {e}"
    return status


def subset(protocol: DataFrame, present: DataFrame, n: int = 10, require_both: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the top speakers whose audio is there, counts of those missing by speaker). present: (audio_id)."""
    chosen = protocol.join(F.broadcast(corpus.top_speakers(protocol, n, require_both).select("speaker_id")), "speaker_id", "left_semi")
    missing = chosen.join(present.select("audio_id"), "audio_id", "left_anti").groupBy("speaker_id").agg(F.count("*").alias("missing"))
    return chosen.join(present.select("audio_id"), "audio_id", "left_semi"), missing

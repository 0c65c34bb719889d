"""Counters that are observed while rows are written: nested, added up over batches, whole after a restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.plans import pipelines
from timbral.sinks.counters import Counters, partition_counts


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def clips(spark):
    spoof = F.col("id") % 5 > 1
    technique = F.when(spoof, F.element_at(F.array(F.lit("TTS"), F.lit("VC.v2"), F.lit("new"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")))
    return spark.range(600).select(F.col("id").alias("clip_id"), F.format_string("arf_%05d", F.col("id") % 40).alias("speaker_id"), F.when(spoof, "spoof").otherwise("bonafide").alias("file_type"), technique.alias("technique"))


def writer(path):
    return lambda d: d.write.mode("overwrite").parquet(path)


def test_batches_add_up_and_a_repeated_one_replaces_itself(spark, tmp_path):
    c = Counters(spark, str(tmp_path / "counters"))
    assert (c.nested(), c.progress(10), c.seconds()) == ({}, 0.0, 0.0)
    even = {("rows",): F.lit(True), ("ids", "even"): F.col("id") % 2 == 0}
    assert c.write(spark.range(7), "a", even, writer(str(tmp_path / "a"))) == {("rows",): 7, ("ids", "even"): 4}
    c.write(spark.range(2), "b", even, writer(str(tmp_path / "b")))
    assert c.nested() == {"rows": 9, "ids": {"even": 5}}
    c.write(spark.range(10), "b", even, writer(str(tmp_path / "b")))
    again = Counters(spark, str(tmp_path / "counters"))
    assert again.nested() == {"rows": 17, "ids": {"even": 9}} and again.progress(34) == 50.0 and again.progress(0) == 0.0 and again.seconds() > 0
    c.write(spark.range(0), "c", even, writer(str(tmp_path / "c")))
    assert again.nested() == {"rows": 17, "ids": {"even": 9}} and again.done().count() == 3


def test_a_batch_that_fails_is_not_recorded(spark, tmp_path):
    c = Counters(spark, str(tmp_path / "counters"))
    with pytest.raises(Exception, match="no number"):
        c.write(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("no number"))).otherwise(F.col("id")).alias("id")), "a", {("rows",): F.lit(True)}, writer(str(tmp_path / "a")))
    assert c.nested() == {} and c.done().count() == 0


def test_partition_counts(spark):
    """A technique that isn't named, and none at all, count as other; no row counts twice."""
    rows = spark.createDataFrame([("train", "spoof", "TTS"), ("train", "spoof", None), ("val", "spoof", "new"), ("val", "bonafide", None), (None, "spoof", "TTS"), ("val", None, "TTS")], "split string, file_type string, technique string")
    counts = partition_counts(["train", "val"], ["TTS"])
    found = rows.agg(*[F.count_if(c).alias("/".join(p)) for p, c in counts.items()]).first().asDict()
    assert found == {"rows": 6, "train/bonafide": 0, "train/spoof/TTS": 1, "train/spoof/other": 1, "val/bonafide": 1, "val/spoof/TTS": 0, "val/spoof/other": 1}


def test_partition_goes_on_after_a_stop(spark, clips, tmp_path):
    """A run that ends after its second batch leaves the rest; the next one writes that alone, and counters are those of what is written."""
    out, seen = str(tmp_path / "out"), []

    def stop(b, _):
        seen.append(b)
        if b == 1:
            raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        pipelines.partition_batches(clips, out, ["TTS", "VC.v2"], 4, after=stop)
    seen.clear()
    progress = []
    counters = pipelines.partition_batches(clips, out, ["TTS", "VC.v2"], 4, after=lambda b, c: (seen.append(b), progress.append(c.progress(600))))
    assert seen == [2, 3] and progress[-1] == 100.0 and progress == sorted(progress)
    written = spark.read.parquet(f"{out}/clips")
    assert written.count() == written.select("clip_id").distinct().count() == 600
    nested = counters.nested()
    assert nested.pop("rows") == 600 and sum(s["speakers"] for s in nested.values()) == 40
    for r in written.groupBy("split").agg(F.count_if(F.expr("file_type = 'bonafide'")).alias("b"), F.count_if(F.expr("technique = 'VC.v2'")).alias("v"), F.count_if(F.expr("file_type = 'spoof'")).alias("s")).collect():
        assert nested[r.split]["bonafide"] == r.b and nested[r.split]["spoof"]["VC.v2"] == r.v and sum(nested[r.split]["spoof"].values()) == r.s


def test_partition_of_nothing(spark, clips, tmp_path):
    counters = pipelines.partition_batches(clips.limit(0), str(tmp_path / "none"), ["TTS"], 2)
    assert counters.progress(0) == 0.0 and counters.nested()["rows"] == 0

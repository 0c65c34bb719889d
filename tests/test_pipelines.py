from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.__main__ import main
from timbral.functions.strategy import Registry, Strategy, check_arguments
from timbral.operators import checks, corpus, speech
from timbral.plans import pipelines
from timbral.sources import audio


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def clips(spark):
    kind = F.when(F.col("id") % 7 < 2, "bonafide").otherwise("spoof")
    return spark.range(400).select(
        F.col("id").alias("clip_id"), F.format_string("arf_%05d", F.col("id") % 30).alias("speaker_id"), kind.alias("file_type"), F.when(kind == "spoof", "TTS").alias("technique"), F.lit(1.0).alias("duration")
    )


def test_run(spark, clips, tmp_path):
    out = str(tmp_path / "run")
    stats = {r.split: r for r in pipelines.run(clips, out).collect()}
    assert sum(r.n_clean for r in stats.values()) == 400
    assert stats["val"].n_augmented == stats["test"].n_augmented == 0 < stats["train"].n_augmented
    p = spark.read.parquet(f"{out}/protocol.parquet")
    grammar = r"^(-|RIR_[A-Z]+_[A-Z]{3}_SNR\d+|CODEC_\d+K_LOSS\d+PCT(_BP)?(_Q\d+)?|RAWBOOST_(NONE|[A-Z]{2}(_[A-Z]{2})*))$"
    assert p.filter(~F.col("system_id").rlike(grammar)).count() == 0
    assert p.select("audio_id").distinct().count() == p.count()
    present = p.filter("audio_id not like '%7'").select("audio_id")
    kept, missing = pipelines.subset(p, present, 2)
    assert kept.select("speaker_id").distinct().count() == 2 and missing.count() <= 2


def test_batch_fails_alone(clips, tmp_path):
    status = pipelines.batch(clips, str(tmp_path), ["2x", "abc", "3x"])
    assert status["2x"] == status["3x"] == "success" and "ValueError" in status["abc"]
    assert (tmp_path / "augmented_3x_balanced_5050").is_dir()


def test_command_line(clips, tmp_path, capsys):
    clips.write.parquet(str(tmp_path / "clips"))
    assert main(["augment", str(tmp_path / "clips"), str(tmp_path / "out"), "--factors", "2x"]) == 0
    assert main(["augment", str(tmp_path / "clips"), str(tmp_path / "out"), "--factors", "x2"]) == 2
    assert main(["status", str(tmp_path / "none"), "--total", "5"]) == 0
    assert '"percent": 0.0' in capsys.readouterr().out


def test_strategies():
    r = Registry()
    assert r.get("3x").planned(18204) == {"originals": 18204, "total": 72816, "rir": 32767, "codec": 16383, "rawboost": 5461}
    assert r.get("7x").factor == 7
    for name, error in (("nope", KeyError), ("ax", ValueError)):
        with pytest.raises(error):
            r.get(name)
    with pytest.raises(ValueError, match="rooms"):
        r.register("bad", Strategy("bad", 2, rooms={"smallroom": 0.5}))
    assert check_arguments(0.5, ["2x", "15x"]) == [] and len(check_arguments(1.0, ["2", "x3", "3.5x", ""])) == 5


def test_checks(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, float("nan")])], "speaker_id string, embedding array<double>")
    assert {tuple(r) for r in checks.bank(v, 2).collect()} == {("b", "size"), ("c", "not a number")}
    assert checks.required_columns(v, ["speaker_id"])[0] and not checks.required_columns(v, ["text"])[0] and not checks.required_columns(v.limit(0), ["speaker_id"])[0]
    files = spark.createDataFrame([("p1", "Chile", "clf_1", "clf_1_2.wav"), ("p2", "Peru", "clf_1", "x.wav"), ("p3", "Chile", "clf_1", "x.wav"), ("p4", "Chile", "clf_1", "clf_9_2.wav")], "path string, folder string, speaker_id string, filename string")
    assert {(r.path, r.type) for r in checks.integrity(files).collect()} == {("p2", "speaker"), ("p3", "name"), ("p4", "owner")}
    lay = spark.createDataFrame([("a", "train"), ("a", "val"), ("a", "test"), ("b", "train")], "speaker_id string, split string")
    assert [tuple(r) for r in checks.layout(lay).collect()] == [("b", ["test", "val"])]


def test_speech(spark):
    rows = spark.createDataFrame([("s1", "a", [1.0, 0.0]), ("s1", "b", [0.0, 1.0]), ("s2", "c", None)], "speaker_id string, path string, x array<double>")
    t = {r.path: (r.text, r.error is None) for r in speech.transcribe(rows, lambda x: f"{len(x)} samples").collect()}
    assert t == {"a": ("2 samples", True), "b": ("2 samples", True), "c": (None, False)}
    bank = speech.speaker_bank(rows, lambda x: [float(v) for v in x])
    assert np.allclose(bank.first().centroid, [0.5**0.5] * 2) and bank.count() == 1
    texts = spark.createDataFrame([("s1", "hi"), ("s2", "you"), ("s2", None)], "speaker_id string, text string")
    got = {r.text: (list(r.input_ids), sum(r.embedding)) for r in speech.examples(texts, bank, lambda s: [ord(c) for c in s], 2).collect()}
    assert got["you"] == ([121, 111, 117], 0.0) and set(got) == {"hi", "you"}


def test_projection(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    got = np.array([r.projection for r in speech.project(df, "id", "v").orderBy("id").collect()])
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ s[2][:2].T))


def test_source_tree(spark):
    paths = ["Real/Chile/clf_1/a.wav", "Diff/Chile-Chile/clf_1-clf_2/b.wav", "TTS/Chile/TTS-clf_2_1.wav", "TTS-VC/T/x/TTS-clf_1_clf_2_9.wav", "Real/Peru/pef_9/z.wav"]
    files = spark.createDataFrame([(p, p.split("/"), 1) for p in paths], "path string, rel array<string>, length long")
    speakers = spark.createDataFrame([("clf_1",), ("clf_2",)], "speaker_id string")
    got = {(r.speaker_id, r.technique, r.path.split("/")[0]) for r in audio.source_tree(files, speakers).collect()}
    assert got == {("clf_1", "bonafide", "Real"), ("clf_1", "Diff", "Diff"), ("clf_2", "TTS", "TTS"), ("clf_1", "TTS-VC", "TTS-VC"), ("clf_2", "TTS-VC", "TTS-VC")}
    inv = {r.filename: (r.category, r.subcategory, r.format) for r in audio.inventory(files).collect()}
    assert inv["TTS-clf_2_1.wav"] == ("TTS", "Chile", "wav")
    rir = {r.subcategory for r in audio.rir_inventory(files, {"Real": "real", "Diff": "simulated"}).collect()}
    assert rir == {"NA", "Chile-Chile"}


def test_a_run_of_several_strategies(spark, clips):
    """A table of strategies: each clip follows its own, ids run within each, an unknown one is an error."""
    r = Registry()
    r.register("rooms only", Strategy("rooms only", 3, types={"rir": 1.0}, rooms={"largeroom": 1.0}, noises={"music": 1.0}, snr=((7.0, 8.0, 1.0),)))
    r.register("halves", Strategy("halves", 2, types={"codec": 0.5, "rawboost": 0.5}))
    mixes = r.mixes(spark, ["rooms only", "halves", "4x"])
    by = mixes.table.select("strategy", (F.col("extra") + 1).alias("factor"), F.explode(F.array(F.lit("bonafide"), F.lit("spoof"))).alias("file_type"))
    mine = pipelines.partition(clips).withColumn("strategy", F.element_at(F.array(*map(F.lit, ("rooms only", "halves", "4x"))), (F.floor(F.col("clip_id") / 30) % 3 + 1).cast("int")))
    p = corpus.protocol(corpus.with_factor(mine, by, only=F.col("split") == "train"), mixes=mixes)
    kinds = {(x.strategy, x.kind) for x in p.select("strategy", F.regexp_extract("system_id", "^[A-Z]*", 0).alias("kind")).distinct().collect()}
    assert kinds == {("rooms only", ""), ("rooms only", "RIR"), ("halves", ""), ("halves", "CODEC"), ("halves", "RAWBOOST"), *(("4x", k) for k in ("", "RIR", "CODEC", "RAWBOOST"))}
    assert {x.system_id for x in p.filter("strategy = 'rooms only' and system_id <> '-'").collect()} == {"RIR_LARGE_MUS_SNR7"}
    sizes = p.groupBy("strategy", "split").agg(F.count("*").alias("n"), F.countDistinct("audio_id").alias("ids"), F.max(F.substring("audio_id", -7, 7)).alias("last")).collect()
    assert len(sizes) == 9 and all(x.n == x.ids == int(x.last) for x in sizes)
    with pytest.raises(Exception, match="unknown strategy 9x"):
        corpus.parameters(spark.range(1).select(F.col("id").alias("clip_id"), F.lit(1).alias("copy"), F.lit("rir").alias("aug"), F.lit("9x").alias("strategy")), mixes=mixes).collect()
    with pytest.raises(ValueError, match="name of its own"):
        r.mixes(spark, ["4x", "4x"])


def test_default_table_is_the_default(spark, clips):
    """A table with the default strategy draws what the constants draw."""
    mixes = Registry().mixes(spark, ["3x"])
    rows = corpus.fan_out(clips, spark.createDataFrame([("bonafide", 5), ("spoof", 3)], "file_type string, factor long"))
    plain = corpus.system_ids(corpus.parameters(rows))
    table = corpus.system_ids(corpus.parameters(rows.withColumn("strategy", F.lit("3x")), mixes=mixes))
    key = ["clip_id", "copy", "system_id"]
    assert plain.select(*key).exceptAll(table.select(*key)).count() == 0 == table.select(*key).exceptAll(plain.select(*key)).count()

from __future__ import annotations

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.functions import factors, labels
from timbral.operators import corpus, kernels
from timbral.sinks import files
from timbral.sources import audio, tables
from timbral.streaming import ingest


@pytest.fixture(scope="module")
def spark():
    return session()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("b", "s", "r", "m", "fb", "fs"), [(80, 176, 0.5, 3, 5, 3), (80, 176, 0.6, 5, 10, 3), (80, 176, 0.7, 3, 7, 2), (10, 90, 0.7, 3, 21, 2), (80, 176, 0.5, 10, 16, 8)])
def test_factors(spark, b, s, r, m, fb, fs):
    row = factors.balanced(spark.createDataFrame([(b, s)], "n_bonafide long, n_spoof long"), r, m).first()
    assert (row.bonafide_factor, row.spoof_factor) == (fb, fs)


def test_empty_class_is_an_error(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|[Dd]ivision"):
        factors.balanced(spark.createDataFrame([(0, 5)], "n_bonafide long, n_spoof long"), 0.5, 3).collect()


def test_planned(spark):
    c = factors.planned(F.lit(18204), F.lit(3))
    assert [one(spark, c[k]) for k in ("originals", "rir", "codec", "rawboost", "total")] == [18204, 32767, 16383, 5461, 72816]


def test_labels(spark):
    assert one(spark, labels.rir_label(F.lit("smallroom"), F.lit("noise"), F.lit(12.9))) == "RIR_SMALL_NOI_SNR12"
    assert one(spark, labels.codec_label(F.lit(8000), F.lit(0.02), F.lit(True), F.lit(8))) == "CODEC_8K_LOSS2PCT_BP_Q8"
    assert one(spark, labels.codec_label(F.lit(16000), F.lit(0.0), F.lit(False), F.lit(0))) == "CODEC_16K_LOSS0PCT"
    ops = F.array(*map(F.lit, ("linear_filter", "additive_noise", "gain_variation")))
    assert one(spark, labels.rawboost_label(ops)) == "RAWBOOST_LF_AN_GV"
    assert one(spark, labels.rawboost_label(F.array().cast("array<string>"))) == "RAWBOOST_NONE"
    for r, name in ((0.5, "5050"), (0.8, "8019"), (0.9, "909")):
        assert one(spark, labels.output_name(F.lit("3x"), F.lit(r))) == f"augmented_3x_balanced_{name}"
    for text, n in (("2x", 2), ("15x", 15), ("2", None), ("x3", None), ("abc", None), ("3.5x", None), ("", None)):
        assert one(spark, factors.parse_factor(F.lit(text))) == n


def test_names(spark):
    def parse(n):
        return one(spark, labels.parse_filename(F.lit(n))).asDict()

    assert parse("arf_00295_0025366257.wav") == {"is_synthetic": False, "attack_type": None, "voice_ids": ["arf_00295"], "num_speakers": 1}
    assert parse("CycleGAN-arf_00295-clm_07049_x.wav")["voice_ids"] == ["arf_00295", "clm_07049"]
    assert parse("TTS-VC-arf_00295_1.wav")["attack_type"] == "TTS"
    assert parse("xxf_1_2.wav")["voice_ids"] == []
    assert one(spark, labels.list_line_ids(F.lit("CycleGAN-arf_00295-clm_07049_x"))) == ["arf_00295-clm"]


def test_fan_out_counts_and_splits(spark):
    clips = spark.range(300).select(F.col("id").alias("clip_id"), F.format_string("arf_%05d", F.col("id") % 40).alias("speaker_id"), F.when(F.col("id") % 3 == 0, "bonafide").otherwise("spoof").alias("file_type"))
    by = factors.by_class(corpus.balanced_factors(clips, 0.5, 3))
    out = corpus.fan_out(clips, by)
    f = {r.file_type: r.factor for r in by.collect()}
    assert out.count() == 100 * f["bonafide"] + 200 * f["spoof"]
    assert out.filter("aug = '-'").count() == 300
    members = corpus.split_speakers(clips)
    assert members.groupBy("split").count().orderBy("split").rdd.map(tuple).collect() == [("test", 4), ("train", 32), ("val", 4)]
    assert corpus.split_overlap(members).count() == 0


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16000) * 0.1
    assert abs(20 * np.log10(kernels.rms(kernels.normalise(x))) + 20) < 1e-9
    noise = rng.standard_normal(4000)
    added = kernels.mix(x, noise, 10.0) - x
    assert abs(20 * np.log10(kernels.rms(x) / kernels.rms(added)) - 10) < 1e-6
    assert np.array_equal(kernels.mix(np.zeros(50), noise, 10.0), np.zeros(50))
    impulse = np.zeros(9)
    impulse[4] = 1
    assert np.allclose(kernels.convolve_same(x, impulse), kernels.to_peak(x))
    h = rng.standard_normal(33)
    assert np.allclose(kernels.convolve_same(x, h), kernels.to_peak(np.convolve(x, h, "same")))
    tone = lambda f: np.sin(2 * np.pi * f * np.arange(16000) / 16000)
    assert kernels.rms(kernels.bandpass(tone(1000), 16000)) > 0.69
    assert kernels.rms(kernels.bandpass(tone(50), 16000)) < 0.02
    assert kernels.rms(kernels.bandpass(tone(7000), 16000)) < 0.02
    assert np.allclose(kernels.resample(kernels.resample(tone(440), 16000, 8000), 8000, 16000), tone(440), atol=1e-6)
    assert len(kernels.resample(x[:101], 16000, 8000)) == 51
    lost = kernels.drop_packets(np.ones(330), 16000, 1.0, rng)
    assert lost[:320].sum() == 0 and lost[320:].sum() == 10
    assert kernels.quantise(np.array([2.5 / 128]), 8)[0] * 128 == 2
    assert np.abs(kernels.rawboost(x, ["linear_filter", "clipping"], rng)).max() <= 0.99


def test_audio_tree(spark, tmp_path):
    for rel, n in (("train/arf_00001/bonafide_arf_00001_0000.wav", 800), ("clm_00002/test/spoof_TTS_clm_00002_0000.WAV", 400), ("train/arf_00001/notes.txt", 0)):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        if n:
            with wave.open(str(p), "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
                w.writeframes((np.sin(np.arange(n)) * 1000).astype("<i2").tobytes())
        else:
            p.write_text("x")
    (tmp_path / "train/arf_00001/bad.wav").write_bytes(b"no audio")
    tree = {r.filename: (r.split, r.speaker_id, r.file_type) for r in audio.split_tree(audio.scan(spark, str(tmp_path))).collect()}
    assert tree == {"bonafide_arf_00001_0000.wav": ("train", "arf_00001", "bonafide"), "spoof_TTS_clm_00002_0000.WAV": ("test", "clm_00002", "spoof"), "bad.wav": ("train", "arf_00001", "spoof")}
    got = {r.path.rsplit("/", 1)[1]: (r.x and len(r.x), r.error is None) for r in audio.decode(spark, str(tmp_path)).collect()}
    assert got == {"bonafide_arf_00001_0000.wav": (800, True), "spoof_TTS_clm_00002_0000.WAV": (400, True), "bad.wav": (None, False)}
    files.write_wavs(spark.createDataFrame([("a/b.wav", [0.0, 0.5, -0.5])], "relative string, y array<double>"), str(tmp_path / "out"))
    assert np.allclose(audio.read_wav((tmp_path / "out/a/b.wav").read_bytes())[0], [0, 0.5, -0.5], atol=1e-4)
    assert tuple(one(spark, audio.path_speaker(F.lit("/d/arf_1/train/x.wav")))) == ("train", "arf_1")


def test_text_formats(spark, tmp_path):
    (tmp_path / "p.txt").write_text("s a1 - bonafide\ns a2 X spoof extra\n\ns a3 X\ns a1 Y spoof\n")
    assert [tuple(r) for r in tables.protocol(spark, str(tmp_path / "p.txt")).select("audio_id", "system_id", "key").collect()] == [("a1", "Y", "spoof")]
    (tmp_path / "s.json").write_text('{"train": ["a", "b"],\n "test": ["c"]}')
    assert sorted(map(tuple, tables.splits(spark, str(tmp_path / "s.json")).collect())) == [("a", "train"), ("b", "train"), ("c", "test")]
    (tmp_path / "m.json").write_text('[{"step": 1, "avg_quality": NaN},\n {"step": 2, "avg_quality": 4.5}]')
    assert tables.metrics(spark, str(tmp_path / "m.json")).filter("isnan(avg_quality)").count() == 1
    p = spark.createDataFrame([("train", "s", "LA_T_0000002", "-", "spoof"), ("train", "s", "LA_T_0000001", "-", "bonafide")], "split string, speaker_id string, audio_id string, system_id string, key string")
    files.write_protocol(p, str(tmp_path / "out"))
    assert tables.protocol(spark, str(tmp_path / "out/split=train")).count() == 2


def test_manifest(spark, tmp_path):
    m = files.Manifest(spark, str(tmp_path / "done"), factor="3x")
    todo = spark.range(10).withColumnRenamed("id", "clip_id")
    assert m.pending(todo, "clip_id").count() == 10 and m.progress(10) == 0
    m.add(todo.filter("clip_id < 4"))
    assert m.pending(todo, "clip_id").count() == 6 and m.progress(10) == 40
    assert files.Manifest(spark, str(tmp_path / "done"), factor="5x").pending(todo, "clip_id").count() == 10


def test_stream(spark, tmp_path):
    clips = spark.range(20).select(F.col("id").alias("clip_id"), F.lit("arf_00001").alias("speaker_id"), F.lit("spoof").alias("file_type"), F.lit("TTS").alias("technique"), F.lit(1.0).alias("duration"), F.current_timestamp().alias("ts"))
    clips.write.parquet(str(tmp_path / "in"))
    by = spark.createDataFrame([("spoof", 3)], "file_type string, factor long")
    for _ in range(2):  # the second run finds nothing new
        ingest.augment_stream(ingest.clip_stream(spark, str(tmp_path / "in")), by, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60

"""The header source and the file-tree sink: byte ranges, bad files, failed tasks, reruns."""

from __future__ import annotations

import os
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.sinks import files, tree
from timbral.sources import audio, headers


@pytest.fixture(scope="module")
def spark():
    return session()


def put_wav(path, frames, rate=16000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"\x00" * frames * channels * width)


def flac(rate, channels, bits, frames):
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | frames
    return b"fLaC" + b"\x80\x00\x00\x22" + b"\x10\x00\x10\x00" + b"\x00" * 6 + packed.to_bytes(8, "big") + b"\x00" * 16


def tree_of(root):
    return {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if not f.startswith(".")}


def test_headers(spark, tmp_path):
    put_wav(tmp_path / "chile/clf_1/a.wav", 24000, 48000, 2, 3)
    put_wav(tmp_path / "chile/clf_1/deep/er/b.WAV", 1, 8000, 1, 1)
    (tmp_path / "chile/clf_1/c.flac").write_bytes(flac(44100, 2, 24, 441_000))
    odd = b"RIFF\x00\x00\x00\x00WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\x00" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF) + b"\x00" * 3200
    (tmp_path / "odd.wav").write_bytes(odd)
    for name, content in (("empty.wav", b""), ("cut.wav", odd[:30]), ("text.wav", b"not audio at all"), ("nodata.wav", odd[:12] + b"data\x00\x00\x00\x00"), ("unknown.flac", flac(16000, 1, 16, 0))):
        (tmp_path / "bad" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "bad" / name).write_bytes(content)
    (tmp_path / "notes.txt").write_text("x")
    rows = {"/".join(r.rel): r for r in headers.read(spark, str(tmp_path)).collect()}
    good = {k: (r.format, r.rate, r.channels, r.bits, r.frames, r.duration) for k, r in rows.items() if r.error is None}
    assert good == {
        "chile/clf_1/a.wav": ("wav", 48000, 2, 24, 24000, 0.5), "chile/clf_1/deep/er/b.WAV": ("wav", 8000, 1, 8, 1, 0.0001),
        "chile/clf_1/c.flac": ("flac", 44100, 2, 24, 441_000, 10.0), "odd.wav": ("wav", 16000, 1, 16, 1600, 0.1),
    }
    assert {k for k, r in rows.items() if r.error} == {f"bad/{n}" for n in ("empty.wav", "cut.wav", "text.wav", "nodata.wav", "unknown.flac")}
    assert {(r.country, r.speaker_id, r.rate) for r in audio.properties(headers.read(spark, str(tmp_path))).collect()} == {("chile", "clf_1", 48000), ("chile", "clf_1", 8000), ("chile", "clf_1", 44100)}
    with pytest.raises(Exception, match="no folder"):
        headers.read(spark, str(tmp_path / "none")).collect()


def test_bytes_read_of_a_large_file(spark, tmp_path):
    put_wav(tmp_path / "small.wav", 10)
    size = 3_000_000_000  # sparse
    with open(tmp_path / "large.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", size + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", size))
        f.truncate(size + 44)
    r = headers.read(spark, str(tmp_path)).filter("length > 1000000").first()
    assert r.duration == size / 32000 and r.length == size + 44 and r.bytes_read <= 64


def test_planning_by_folders(tmp_path, monkeypatch):
    """Few folders are opened up by the driver; every file belongs to one partition."""
    for i in range(6):
        for j in range(4):
            put_wav(tmp_path / f"d{i}/s{j}/x.wav", 5)
    put_wav(tmp_path / "top.wav", 5)
    for most in (1, 3, 10, 1000):
        monkeypatch.setattr(headers, "FOLDERS", most)
        reader = headers.HeaderReader(f"file://{tmp_path}", (".wav",))
        parts = reader.partitions()
        found = [p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()]
        assert len(found) == len(set(found)) == 25


def test_inventories(spark, tmp_path):
    for p in ("music/fma/a.wav", "music/b.wav", "c.wav", "simulated/small/d.wav", "real/x/e.wav"):
        put_wav(tmp_path / p, 1600)
    (tmp_path / "music/fma/bad.wav").write_bytes(b"x")
    found = headers.read(spark, str(tmp_path))
    got = {r.filename: (r.category, r.subcategory, r.duration) for r in audio.master_inventory(found).collect()}
    assert got == {"a.wav": ("music", "fma", 0.1), "b.wav": ("music", "generic", 0.1), "c.wav": ("unknown", "unknown", 0.1), "d.wav": ("simulated", "small", 0.1), "e.wav": ("real", "x", 0.1)}
    rooms = audio.rir_inventory(found, {"simulated": "simulated", "real": "real"})
    assert {(r.category, r.subcategory, r.duration) for r in rooms.filter("category <> 'unknown'").collect()} == {("simulated", "small", 0.1), ("real", "NA", 0.1)}
    assert audio.simulated(rooms).count() == 1
    assert audio.missing_folders(spark, str(tmp_path), ("music", "speech")) == ["speech"]
    with pytest.raises(FileNotFoundError):
        audio.missing_folders(spark, str(tmp_path / "none"), ())
    assert [r.path.rsplit("/", 1)[1] for r in audio.scan(spark, str(tmp_path), ordered=True).collect()] == ["c.wav", "b.wav", "a.wav", "bad.wav", "e.wav", "d.wav"]


def test_copy_and_rerun(spark, tmp_path):
    for i in range(20):
        put_wav(tmp_path / f"in/f{i}.wav", 10 + i)
    rows = spark.range(24).select(F.concat(F.lit("train/s"), F.col("id") % 3, F.lit("/n"), "id", F.lit(".wav")).alias("target"), F.concat(F.lit(f"{tmp_path}/in/f"), "id", F.lit(".wav")).alias("source")).repartition(5)
    out = str(tmp_path / "out")
    tree.write(rows, out)
    first = {k: v for k, v in tree_of(out).items() if k.endswith(".wav")}
    assert first == {f"train/s{i % 3}/n{i}.wav": 44 + 2 * (10 + i) for i in range(20)}
    os.remove(f"{out}/train/s0/n3.wav")
    before = os.stat(f"{out}/train/s1/n4.wav").st_mtime_ns
    tree.write(rows, out)
    assert os.stat(f"{out}/train/s1/n4.wav").st_mtime_ns == before and {k: v for k, v in tree_of(out).items() if k.endswith(".wav")} == first
    assert sorted((r.written, r.present, r.missing) for r in tree.reports(spark, out).collect()) == [(1, 19, 4), (20, 0, 4)]
    assert not os.path.exists(f"{out}/_staging")
    with pytest.raises(Exception, match="FileNotFoundError"):
        tree.write(rows, str(tmp_path / "strict"), strict=True)
    assert tree_of(tmp_path / "strict") == {}


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    tree.write(spark.createDataFrame([("kept.bin", b"old")], "target string, content binary"), out)
    bad = spark.range(40).select(F.when(F.col("id") == 37, F.lit("../outside")).otherwise(F.concat(F.lit("d/f"), "id")).alias("target"), F.lit("content").cast("binary").alias("content")).repartition(3)
    with pytest.raises(Exception, match="not a path below the root"):
        tree.write(bad, out)
    assert {k for k in tree_of(out) if not k.startswith("_committed")} == {"kept.bin"} and not os.path.exists(f"{out}/_staging")
    with pytest.raises(Exception, match="target"):
        tree.write(spark.range(1), out)
    with pytest.raises(Exception, match="appended"):
        bad.write.format("file_tree").mode("overwrite").save(out)


def test_subset(spark, tmp_path):
    p = spark.createDataFrame([("s1", "LA_T_2", "-", "spoof"), ("s1", "LA_T_1", "-", "bonafide"), ("s2", "LA_T_3", "-", "bonafide")], "speaker_id string, audio_id string, system_id string, key string")
    (tmp_path / "a.flac").write_bytes(flac(16000, 1, 16, 160))
    audio_files = spark.createDataFrame([("LA_T_1", f"{tmp_path}/a.flac"), ("LA_T_2", f"{tmp_path}/gone.flac")], "audio_id string, source string")
    tree.copy_subset(p, audio_files, str(tmp_path / "out"))
    assert os.path.exists(tmp_path / "out/flac/LA_T_1.flac") and not os.path.exists(tmp_path / "out/flac/LA_T_2.flac")
    assert [r.value for r in spark.read.text(str(tmp_path / "out/protocol")).collect()] == ["s1 LA_T_1 - bonafide", "s1 LA_T_2 - spoof", "s2 LA_T_3 - bonafide"]
    assert [r.value for r in spark.read.text(str(tmp_path / "out/README")).collect()] == ["s1: 1 bonafide, 1 spoof", "s2: 1 bonafide, 0 spoof"]


def test_wavs_with_their_own_rates(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", [0.0, 0.5] * 100, 8000, 2), ("b.wav", [0.1] * 50, 44100, 1)], "target string, y array<double>, rate int, channels int")
    tree.write(files.wav_files(rows), str(tmp_path))
    assert {(r.rate, r.channels, r.frames) for r in headers.read(spark, str(tmp_path)).collect()} == {(8000, 2, 100), (44100, 1, 50)}

"""Blocked similarity, roll-ups of trees, length batches and lists, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.operators import profile, speech


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.mark.parametrize("block", [3, 512])
def test_pairwise_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(profile, "BLOCK", block)
    v = np.random.default_rng(2).standard_normal((17, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(f"s{i:02}", x.tolist()) for i, x in enumerate(v)], "g string, v array<double>").repartition(4)
    got = {(r.a, r.b): r.cosine for r in profile.pairwise(df, "g", "v").collect()}
    expected = {(f"s{i:02}", f"s{j:02}"): float(v[i] @ v[j]) for i in range(17) for j in range(i + 1, 17)}
    assert got.keys() == expected.keys() and np.allclose([got[k] for k in expected], list(expected.values()))
    assert {(r.a, r.b) for r in profile.pairwise(df, "g", "v", least=0.2).collect()} == {k for k, c in expected.items() if c >= 0.2}
    assert profile.pairwise(df.limit(0), "g", "v").count() == 0 == profile.pairwise(df.limit(1), "g", "v").count()


def test_tree_counts(spark):
    paths = ["a/b/x.wav", "a/b/y.txt", "a/c/z.txt", "d/w.wav", "top.txt", "a/b/e/v.wav"]
    files = spark.createDataFrame([(p.split("/"),) for p in paths], "rel array<string>")
    got = {r.folder: (r.files, r.direct) for r in profile.tree_counts(files, F.element_at("rel", -1).endswith(".wav")).collect()}
    assert got == {"": (4, 0), "a": (3, 0), "a/b": (3, 2), "a/b/e": (1, 1), "d": (1, 1)}


def test_batches(spark):
    rows = spark.createDataFrame([(i, [float(i)] * (3 + i * 7 % 11)) for i in range(25)], "id long, x array<double>")
    out = speech.collate(speech.batches(rows, "id", F.size("x"), 4), "x").collect()
    lengths = sorted((len(r.x) - len(r.x) % 2, r.id) for r in out)
    for place, (kept, i) in enumerate(lengths):
        r = next(r for r in out if r.id == i)
        padded = max(k for k, _ in lengths[place // 4 * 4 : place // 4 * 4 + 4])
        assert (r.batch, r.kept, r.padded, r.attention) == (place // 4, kept, padded, kept) and r.labels == [float(i)] * kept + [-100.0] * (padded - kept)


def test_lists_and_latest(spark):
    df = spark.createDataFrame([("s", "b", 3), ("s", "b", 1), ("t", "c", 2)], "g string, k string, i long")
    assert {r.g: (r.b, r.c) for r in profile.lists_by(df, "g", "k", ["b", "c"], "i").collect()} == {"s": ([1, 3], []), "t": ([], [2])}
    names = spark.createDataFrame([("checkpoint-900",), ("checkpoint-10000",), ("runs-99999",), ("checkpoint-x",)], "name string")
    assert tuple(profile.latest_numbered(names, "name").first()) == ("checkpoint-10000", 10000)
    assert tuple(profile.latest_numbered(names.limit(0), "name").first()) == (None, None)


def test_batched_models(spark, tmp_path):
    """One load a worker, calls in batches, and only a bad value has an error."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(values):
            open(f"{folder}/call-{len(values)}-{uuid.uuid4().hex}", "w").close()
            if any(v < 0 for v in values):
                raise ValueError("negative")
            return [f"{v}!" for v in values]

        return model

    rows = spark.range(0, 200, 1, 1).select(F.when(F.col("id") == 77, -1).otherwise(F.col("id")).alias("v"))
    model = speech.Batched(f"stub {folder}", load, 50)
    got = speech.apply_model(rows, "v", model, "text", "string").collect()
    assert [r.text for r in got] == [None if r.v < 0 else f"{r.v}!" for r in got] and [r.error for r in got if r.error] == ["ValueError: negative"]
    names = [p.name for p in tmp_path.iterdir()]
    workers = {n.split("-")[1] for n in names if n.startswith("load")}
    assert sum(n.startswith("load") for n in names) == len(workers) == 1
    assert sum(n.startswith("call-50") for n in names) == 4 and sum(n.startswith("call-1-") for n in names) == 50
    short = speech.Batched(f"short {folder}", lambda: lambda values: values[:1], 10)
    assert speech.apply_model(rows.limit(3), "v", short, "w", "long").filter("error is null").count() == 3

"""The history of op4: nothing is lost by merging under a repeated name, by order, or by a batch that is cut short."""

from __future__ import annotations

import pytest

from tests.harness import session
from timbral.llm import substrings


@pytest.fixture(scope="module")
def spark():
    return session()


def batch(spark, k):
    return spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(80)))], "doc_id long, text string")


def lost(index, spark, k):
    return index.dedup(batch(spark, k)).first().n_removed


def test_compact_under_one_name(spark, tmp_path):
    index = substrings.RunIndex(spark, str(tmp_path / "runs"), 3)
    for k in (1, 2, 3):
        index.append(batch(spark, k), f"b{k}")
        index.compact("all")
        assert [n for n, _ in index.runs()] == ["all"] and [lost(index, spark, j) for j in (1, 2, 3)] == [80 if j <= k else 0 for j in (1, 2, 3)]
    assert len(list((tmp_path / "runs/runs").iterdir())) == 1


def test_oldest_first(spark, tmp_path):
    index = substrings.RunIndex(spark, str(tmp_path / "runs"), 3)
    for k in (2, 10, 1):
        index.append(batch(spark, k), str(k))
    index.compact("merged", 2)
    assert [n for n, _ in index.runs()] == ["merged", "1"]
    with pytest.raises(ValueError, match="isn't merged"):
        index.compact("1", 1)
    index.append(batch(spark, 7), "1")  # a batch of the same name makes way
    assert [lost(index, spark, j) for j in (2, 10, 1, 7)] == [80, 80, 0, 80]


def test_a_batch_cut_short_counts_for_nothing(spark, tmp_path, monkeypatch):
    index = substrings.RunIndex(spark, str(tmp_path / "runs"), 3)
    index.append(batch(spark, 1), "one")
    real = substrings.RunIndex._publish

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(substrings.RunIndex, "_publish", stopped)
    for step in (lambda: index.append(batch(spark, 2), "two"), lambda: index.compact("one"), lambda: index.append(batch(spark, 3), "one")):
        with pytest.raises(KeyboardInterrupt):
            step()
    monkeypatch.setattr(substrings.RunIndex, "_publish", real)
    assert [lost(index, spark, k) for k in (1, 2, 3)] == [80, 0, 0]
    number, runs = index._log()
    with pytest.raises(RuntimeError, match="another"):
        index._publish(number, runs)


def test_empty_batches(spark, tmp_path):
    index = substrings.RunIndex(spark, str(tmp_path / "runs"), 3)
    assert index.history() is None and index.runs() == []
    index.compact("nothing")
    index.append(batch(spark, 1).limit(0), "empty")
    assert lost(index, spark, 1) == 0
    index.append(batch(spark, 1), "full")
    index.compact("both")
    assert lost(index, spark, 1) == 80

"""Decontamination of very long texts: linear in their length, whichever way the prefix is joined."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.harness import session
from tests.llm.test_operators import brute_hits
from timbral.llm import decontaminate


@pytest.fixture(scope="module")
def spark():
    return session()


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_long_texts(spark, monkeypatch, tmp_path, limit):
    """Texts of 16,000 words, some of them all benchmark: right, and few bytes are written, with no broadcast of the prefix either."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 30])))) for i in range(40)]
    long = [word() for _ in range(16_000)]
    for at, (_, text) in zip(range(100, 16_000, 800), items, strict=False):
        long[at : at + len(text.split())] = text.upper().split()
    rows = [(1, " ".join(long)), (None, "x " + items[2][1]), (2, " ".join(t for _, t in items)), (3, "plain text"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "bits": F.lit(2), "words": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    try:
        if not limit:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = Counter(map(tuple, decontaminate.report(d, b).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)
    assert folder_bytes(tmp_path / "shared") < 2_000_000
    exchanged = decontaminate.hits(d, b)._jdf.queryExecution().toString()
    assert "words" not in [c for line in exchanged.split("\n") if "Exchange hashpartitioning(h" in line for c in line.split()]


def test_a_bitmap_that_is_all_ones(spark, monkeypatch):
    """Every hash may be in it: more is compared, and the hits are the same."""
    monkeypatch.setattr(decontaminate, "BITS", 64)
    r = random.Random(9)
    items = [(i, " ".join(r.choices("abcdef", k=r.randint(1, 14)))) for i in range(12)]
    rows = [(i, " ".join(r.choices("abcdefg", k=r.randint(0, 60)))) for i in range(80)]
    got = Counter(map(tuple, decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)

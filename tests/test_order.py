"""Numbering in any order and quantiles by refinement, against plain Python, with hot groups, ties and nulls."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import session
from timbral.operators import quantiles as q
from timbral.operators.numbering import numbered
from timbral.operators.profile import describe


@pytest.fixture(scope="module")
def spark():
    return session()


def test_numbered(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, *range(5)]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k long, id long").repartition(7).withColumnsRenamed({})
    got = numbered(df, [F.desc("k"), "id"], ("g",), "place", total="n").collect()
    groups = defaultdict(list)
    for g, k, i in rows:
        groups[g].append((k is None, -(k or 0), i))
    expected = {}
    for g, members in groups.items():
        for place, (_, _, i) in enumerate(sorted(members)):
            expected[i] = (g, place, len(members))
    assert {x.id: (x.g, x.place, x.n) for x in got} == expected
    whole = numbered(df, ["id"]).collect()
    assert all(x.place == x.id for x in whole)
    assert numbered(df.limit(0), ["id"], ("g",)).count() == 0
    assert sorted(x.place for x in numbered(df, ["k"]).collect()) == list(range(4000))


def test_a_hot_group_is_many_tasks_work(spark):
    """No partition that is sorted holds the group: its rows lie in as many as they fill."""
    df = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("k"))
    laid = df.repartitionByRange(8, "g", "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(laid) == 8 and max(x["count"] for x in laid) < 10_000
    got = numbered(df, ["k"], ("g",)).orderBy("k").select("place").collect()
    assert [x.place for x in got] == list(range(40_000))


def expected_quantiles(rows, shares):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    out = {}
    for g, values in groups.items():
        values.sort(key=lambda v: (math.isnan(v), v))
        at = []
        for p in shares:
            h = p * (len(values) - 1)
            low, high = values[math.floor(h)], values[math.ceil(h)]
            at.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        out[g] = at
    return out


SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("kind", ["uniform", "ties", "wide", "narrow", "odd"])
@pytest.mark.parametrize("bounds", [(100_000, 4096, 4096), (60, 10**9, 16)])
def test_quantiles(spark, monkeypatch, kind, bounds):
    """Whole groups, and refinement of hot ones in rounds of few and of many parts."""
    for name, value in zip(("GROUP", "SHARE", "BUCKETS"), bounds, strict=True):
        monkeypatch.setattr(q, name, value)
    r = random.Random(kind)
    draw = {
        "uniform": lambda: r.uniform(-5, 5), "ties": lambda: float(r.randint(0, 3)), "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300),
        "narrow": lambda: 1.0 + r.randint(0, 40) * 2.0**-52, "odd": lambda: r.choice([math.inf, -math.inf, math.nan, 0.0, -0.5, r.random(), None]),
    }[kind]
    rows = [(r.choice(["hot"] * 8 + ["x", None]), draw()) for _ in range(1500)] + [("single", 2.5), ("empty", None)]
    if bounds[0] == 60 and kind == "wide":
        rows = rows[:300]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x[0]: list(x)[1:] for x in q.quantiles(df, ["g"], "v", SHARES, [f"p{i}" for i in range(len(SHARES))]).collect()}
    expected = expected_quantiles(rows, SHARES)
    assert set(got) == set(expected)
    for g, values in expected.items():
        assert np.array_equal(np.array(got[g]), np.array(values), equal_nan=True) or np.allclose(got[g], values, rtol=1e-12, equal_nan=True), (g, got[g], values)


def test_describe_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0), ("e", None)], "g string, v double")
    got = {x.g: (x.n, x.mean, x.q25, x.q50, x.q75) for x in describe(df, ["g"], "v").collect()}
    assert got == {"a": (2, 1.5, 1.25, 1.5, 1.75), None: (1, 4.0, 4.0, 4.0, 4.0), "e": (0, None, None, None, None)}
    assert describe(df.limit(0), ["g"], "v").count() == 0

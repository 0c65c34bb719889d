"""Every query with SQL gives the rows of its SQL; every query gives the same rows however the data is partitioned."""

from __future__ import annotations

import pytest

from tests.harness import TESTDATA, rows, same, session
from timbral.catalogue import oracle_sql, queries
from timbral.operators import corpus
from timbral.plans import augmentation


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    assert same(queries()[name](spark, f"{TESTDATA}/sf0.001"), oracle_sql()[name], "sf0.001") > 0


@pytest.mark.parametrize("name", ["protocol_rows", "speaker_split", "wave_codec_chain", "wave_rawboost_chain", "wave_rir_chain"])
def test_partitioning(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = queries()[name](spark, f"{TESTDATA}/sf0.001")
        return rows(df.columns, [tuple(r) for r in df.collect()])

    try:
        assert run("1") == run("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["protocol_rows", "subset_extract", "top_speakers_any", "top_speakers_both"])
def test_ids_beyond_seven_digits(spark, name, monkeypatch):
    """Numbers start at 9,999,501, so ids of seven digits and of eight meet; the protocol of the operator itself stays unique."""
    first_ids = corpus.first_ids
    monkeypatch.setattr(corpus, "first_ids", lambda c: first_ids(c).selectExpr("* except (first)", "first + 9999500 as first"))
    sql = oracle_sql()[name]
    late = sql.replace("lpad((row_number()", "lpad((9999500 + row_number()")
    assert late != sql
    assert same(queries()[name](spark, f"{TESTDATA}/sf0.001"), late, "sf0.001") > 0
    if name == "protocol_rows":
        p = corpus.protocol(augmentation.placed(spark, f"{TESTDATA}/sf0.001"))
        assert p.select("audio_id").distinct().count() == p.count()
        assert p.filter("length(audio_id) = 13").count() > 0

"""What Python workers hold when a task has ended."""

from __future__ import annotations

import pyarrow as pa

from tests.harness import TESTDATA, session
from timbral.llm import bpe, common
from timbral.llm.queries import VOCABULARY


def test_memo_after_batch(monkeypatch):
    """A batch with more new words than the memo may keep leaves none of them behind, and has all its ids."""
    vocabulary = open(VOCABULARY, encoding="utf-8").read()
    coder, texts = bpe.Coder(vocabulary), [f"word{chr(97 + i % 26)} other{chr(97 + i // 26)} the" for i in range(400)]
    expected = list(coder.batch(texts))
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    coder.memo = {}
    assert list(coder.batch(texts)) == expected and len(coder.memo) <= 5
    assert list(coder.batch(["the"])) == list(coder.batch(["the"])) and len(coder.memo) == 1


def test_arrow_gives_back(monkeypatch):
    """What Arrow keeps goes back once, after a task's last batch."""
    events = []

    class Pool:
        def release_unused(self):
            events.append("released")

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    run = common.map_arrow(Frame(), lambda batches: batches, "n long")
    rows = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64())], ["n"])
    for b in run(iter([rows])):
        events.append(b.num_rows)
    assert events == [256, 256, 88, "released"]


def test_ids():
    """The ids alone, of null and empty texts too, are those of encode."""
    spark = session()
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "a </s> b")], "doc_id long, text string"))
    got, whole = bpe.ids(docs, VOCABULARY), bpe.encode(docs, VOCABULARY).drop("decoded")
    assert got.schema == whole.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))

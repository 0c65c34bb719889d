"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import corpus_pipeline as p
from tests.harness import TESTDATA, session
from tests.llm.test_operators import brute_hits, low
from timbral.llm import bpe, pii, toxicity

SF = f"{TESTDATA}/sf0.001"


def brute_survivors(rows):
    """One row of each group that chains of pairs of Jaccard similarity 0.8 or more (5-word shingles) join: the least doc_id, none before any."""
    words = [tuple(x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", low(r.text))) for r in rows]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} if len(w) > 5 else {w} for w in words]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, r in enumerate(rows):
        key = (r.doc_id is not None, r.doc_id or 0)
        if find(i) not in best or key < best[find(i)][0]:
            best[find(i)] = key, r
    return [r for _, r in best.values()]


def test_run():
    spark = session()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    index = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if index.score(r.text)[0] < toxicity.CUT]
    got = p.drop_toxic(spark, docs, SF)
    assert got.columns == columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, rows))

    n = len(rows)
    rows = brute_survivors(rows)
    assert 0 < len(rows) < n
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if not brute_hits(r.text, items)[-1]]
    coder = bpe.coder(open(p.VOCABULARY, encoding="utf-8").read())
    expected = Counter((r.doc_id, tuple(coder.encode(pii.redacted(r.text)))) for r in rows)
    out = p.run(spark, SF)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected and all(r.n_tokens == len(r.ids) for r in got)
    (path,) = {f.rsplit("/", 2)[0] for f in out.inputFiles()}
    assert [x.name for x in Path(path.removeprefix("file:").replace("///", "/")).iterdir() if not x.name.startswith(".")] == ["4-bpe"]


def test_near_dedup_by_row():
    """Rows that share an id with a copy stay if their texts are their own; rows that repeat an id or have none go if they are copies."""
    spark = session()
    long = " ".join(f"w{i}" for i in range(20_000))
    near = long.replace("w777 ", "other ")
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "its own words under the same id", 1), (2, "A b c d e f", 1), (None, "a b c d e f", 1), (None, "nobody has this text but one", 1), (3, long, 1), (4, near, 1), (5, None, 1), (6, "", 1)]
    docs = spark.createDataFrame([(d, t, "en", "s", n, "x") for d, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    got = p.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    expected = Counter((r.doc_id, (r.text or "").lower()) for r in brute_survivors(docs.collect()))
    assert Counter((r.doc_id, (r.text or "").lower()) for r in got.collect()) == expected and sum(expected.values()) == 5


def test_stages_keep_columns():
    spark = session()
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a text", "en", "s", 6), (1, "a text", "en", "s", 6), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(p.STAGES):
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert k == len(p.STAGES) - 1 or out.columns == docs.columns
            assert out.count() <= d.count()
    assert p.drop_near_duplicates(spark, docs, SF).filter("doc_id is null").count() == 1

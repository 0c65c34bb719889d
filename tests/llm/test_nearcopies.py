"""The pipeline's near-duplicate stage against brute force, and its recall on planted copies."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline as p
from tests.harness import TESTDATA, session
from timbral.llm import nearcopies as nc


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def near(t, u):
    return nc.jaccard(nc.shingles(nc.words(t)), nc.shingles(nc.words(u))) >= 0.8


def brute(rows):
    """(doc_id, text) rows -> those that stay."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                root[top(i)] = top(j)
    of = defaultdict(list)
    for i, r in enumerate(rows):
        of[top(i)].append((r[0] is not None, r[0] or 0, signed(nc.node(nc.words(r[1]))), r[1] or "", r))
    return sorted((min(g, key=lambda x: x[:4])[-1] for g in of.values()), key=repr)


def planted(edits, r):
    own = ["".join(r.choice("abdehinorstu") for _ in range(6)) for _ in range(400)]
    copy = list(own)
    for k in r.sample(range(5, 395), edits):
        copy[k] = "changed"
    return " ".join(own), " ".join(copy)


def test_planted_copies_go():
    """Single-word edits of 400 words: similarity 0.8 to 0.95."""
    spark, r = session(), random.Random(5)
    rows, copies = [], 0
    for i in range(300):
        a, b = planted(r.randint(2, 9), r)
        s = nc.jaccard(nc.shingles(nc.words(a)), nc.shingles(nc.words(b)))
        if 0.8 <= s <= 0.95:
            copies += 1
            rows += [(2 * i, a), (2 * i + 1, b)]
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert copies > 200
    left = len(got.collect()) - copies
    print(f"recall {1 - left / copies:.4f} of {copies}")
    assert left <= 1


def test_against_brute_force():
    spark, r = session(), random.Random(6)
    rows = []
    for i in range(12):
        a, b = planted(r.choice([1, 4, 12, 30]), r)
        rows += [(i, a), (i + 100, b), (i, b)]
    a, chain = rows[0][1], rows[0][1].split()
    for k in range(6):  # a chain whose ends differ by more than its links
        chain[40 * k : 40 * k + 30] = [f"c{k}{j}" for j in range(30)]
        rows.append((200 + k, " ".join(chain)))
    rows += [(7, "same"), (7, "same"), (None, "no id"), (None, "no id"), (None, "No  ID"), (3, "no id"), (5, None), (6, ""), (8, " "), (9, "a b c d e f"), (10, "a b c d e g")]
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_documents():
    spark = session()
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    got = p.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == brute(rows)


def test_columns_of_any_name_and_the_texts_that_are_shuffled():
    """Columns named like the stage's own come through; only rows whose node repeats or goes are grouped."""
    spark = session()
    names = ["doc_id", "text", "node", "row", "bit", "cell", "bits", "survives", "__node", "size", "root"]
    texts = ["a b c d e f", "alone in here", None, "a b c d e f", "", "other words that stand alone here"]
    rows = [(i, t, *[f"{c}{i}" for c in names[2:]]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = nc.drop(docs)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == [rows[0], rows[1], rows[2], rows[5]]
    prints = nc._printed(docs)
    marked = nc._may_be(prints.select("node", "row.text"), prints.groupBy("node").count().filter("count > 1").select("node"))
    assert sorted(r.text or "" for r in marked.filter("survives").collect()) == ["", "", "a b c d e f", "a b c d e f"]
    assert nc.drop(docs.filter("doc_id < 0")).collect() == []


def test_hot_bucket_is_linear_and_whole():
    pairs = list(nc.with_first([1, 2, 3, 4], [9, 9, 9, 9]))
    assert pairs == [(1, 2), (1, 3), (1, 4)]
    same = [bytes(nc.SKETCH)] * 4
    assert not list(nc.of_unlike_roots([1, 2, 3, 4], [9] * 4, [1] * 4, same))
    assert sorted(nc.of_unlike_roots([1, 2, 3, 4], [9, 9, 9, 5], [1, 1, 3, 4], same)) == [(2, 3)]


def test_sketches_keep_pairs():
    """Pairs of similarity 0.8 and little more agree in enough places; pairs of 0.6 do not."""
    r = random.Random(6)
    for _ in range(60):
        own = [str(r.random()) for _ in range(300)]
        for kept, goes_on in ((270, True), (225, False)):  # 270 / 330 and 225 / 375
            a, b = ({x.encode() for x in own}, {x.encode() for x in own[:kept] + [str(r.random()) for _ in range(300 - kept)]})
            assert bool(list(nc.of_unlike_roots([0, 1, 2], [1, 300, 300], [0, 1, 2], [bytes(nc.SKETCH), nc.sketch(a), nc.sketch(b)]))) == goes_on


def test_simhash_links_the_closest_and_is_verified(monkeypatch):
    """Without any pair of the minima, SimHash's links alone take away close copies, and none whose shingles differ too much."""
    spark, r = session(), random.Random(9)
    a, b = planted(1, r)
    phrase, others = "one two three four five six seven", [" ".join(f"{k}{i}" for i in range(12)) for k in "xy"]
    c, d = (" ".join([phrase] * 400 + [o]) for o in others)  # repeats decide the bits, but the shingles are 7 and 15 or 16 of one's own
    rows = [(1, a), (2, b), (3, c), (4, d)]
    bits = lambda t, u: (nc.simhash.fingerprint(t, 5) ^ nc.simhash.fingerprint(u, 5)).bit_count()
    assert bits(a, b) <= nc.simhash.RADIUS and near(a, b) and bits(c, d) <= nc.simhash.RADIUS and not near(c, d)
    monkeypatch.setattr(nc, "_pairs", lambda rows, again: rows.sparkSession.createDataFrame([], "u long, v long"))
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in got.collect()) == [1, 3, 4]

"""Operators 11 to 13: SQL is held against them in test_operators; here brute force, libraries, round trips and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.harness import TESTDATA, session
from tests.llm.test_operators import DOCS, EDGES, sha
from timbral.llm import align, exact, fim
from timbral.llm import queries as q

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def edges(spark):
    clashing = ("n", "row", "full", "key", "a", "b", "output", "form", "best", "size", "bits", "norm")
    return spark.createDataFrame(EDGES, DOCS).withColumns({c: F.lit(1) for c in clashing})


# --- 11: exact dedup ----------------------------------------------------------------------------


def brute_groups(rows):
    """[(doc_id, text)] -> multiset of (doc_id, keep_id, group_size, kept, text_sha256)."""
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = Counter()
    for norm, members in by.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for place, (i, _) in enumerate(members):
            out[i, members[0][0], len(members), place == 0, sha(norm)] += 1
    return out


def found_groups(df):
    return Counter(map(tuple, exact.groups(df, digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_exact_edges(spark, edges):
    rows = [(i, t) for i, t, *_ in EDGES]
    assert found_groups(edges) == brute_groups(rows)
    assert exact.groups(edges).columns == ["doc_id", "text_hash", "keep_id", "group_size", "kept"]
    assert exact.groups(edges.limit(0)).count() == 0
    kept = exact.drop(edges)
    assert kept.columns == edges.columns and exact.drop(edges.limit(0)).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, *_, stays, _), n in brute_groups(rows).items() if stays for _ in range(n))


@pytest.mark.parametrize("hot", [exact.HOT, 4])
def test_exact_ties_and_hot_groups(spark, monkeypatch, hot):
    """Groups of thousands by both ways of joining, equal lengths and equal prefixes with different ends, repeated rows and ids."""
    monkeypatch.setattr(exact, "HOT", hot)
    r = random.Random(11)
    long = "p" * exact.PREFIX
    texts = ["a b", "ab ", " ab", "a\tb", "ba", long + "x", long + "y", long + " x", "", None, "é ", "é", *["".join(r.choices("ab ", k=r.randint(0, 5))) for _ in range(300)]]
    rows = [(r.choice([None, *range(40)]), r.choice(texts)) for _ in range(1500)] + [(7, "hot copy")] * 900 + [(i, " hot copy") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_groups(df) == brute_groups(rows)
    kept = exact.drop(df).collect()
    by = Counter(re.sub(r"[\x20\x09-\x0D]", "", x.text or "") for x in kept)
    assert set(by.values()) == {1} and len(by) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def test_exact_full_hashes_of_survivors_only(spark):
    """Only rows whose length and prefix hash another row shares are hashed in full."""
    rows = [(1, "unique length"), (2, "one two"), (3, "two one"), (4, "same text"), (5, "sametext")]
    own = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", exact.normal().alias("norm"))
    sized = exact._sized(own)
    by_length = exact._marked(sized, exact._shared(sized, exact.LENGTH), exact.LENGTH)
    assert {x.doc_id for x in by_length.filter("survives").collect()} == {2, 3, 4, 5}
    by_pair = exact._marked(sized, exact._shared(by_length.filter("survives").drop("survives"), exact.PAIR), exact.PAIR)
    assert {x.doc_id for x in by_pair.filter("survives").collect()} == {4, 5}


def test_exact_with_crowded_bitmaps(spark, monkeypatch):
    """With all keys on two bits every row is hashed in full; the groups stay the same."""
    monkeypatch.setattr(exact, "BITS", 2)
    rows = [(i, f"text {i % 13}") for i in range(60)]
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


# --- 12: fill in the middle ---------------------------------------------------------------------


def brute_cut(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n, t = len(units), text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", t, None, None, t
    if h[3] % 100 < spm:
        return doc_id, n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid), t
    return doc_id, n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid), t


def fim_rows(df, **options):
    return Counter(map(tuple, fim.transform(df, **options).withColumn("again", fim.restored()).collect()))


def test_fim_brute_force(spark, edges):
    assert fim_rows(edges) == Counter(brute_cut(i, t) for i, t, *_ in EDGES)
    assert fim.transform(edges.limit(0)).count() == 0
    r = random.Random(12)
    parts = ["\n", "\n\n", "a", "é😀", "\r\n", "<", "<S", "S>", ">", "<P", " ", "\x00", " ", "line\n"]
    rows = [(i, "".join(r.choices([*parts, *(["<M>"] if i % 9 == 0 else [])], k=r.randint(0, 30)))) for i in range(600)] + [(-5, "x\ny"), (1 << 62, "x\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fim_rows(df) == Counter(brute_cut(i, t) for i, t in rows)
    forms = Counter(x[2] for x in fim_rows(df, rate=60, spm=20))
    assert fim_rows(df, rate=60, spm=20) == Counter(brute_cut(i, t, 60, 20) for i, t in rows) and forms["plain"] > forms["psm"] / 2 > forms["spm"] / 2 > 20


def test_fim_other_units(spark):
    """Words as units: cuts lie between words, and every text comes back."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40)) + " " * (i % 3)) for i in range(200)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=fim.WORDS).withColumn("again", fim.restored()).collect()
    text = dict(rows)
    assert all(x.again == text[x.doc_id] for x in got)
    for x in got:
        if x.form != "plain" and 0 < x.prefix_chars < len(text[x.doc_id].rstrip()):
            assert text[x.doc_id][x.prefix_chars] == " "


def test_fim_never_holds_the_units():
    """Over a million lines the matcher's memory stays far below what a list of them takes."""
    import tracemalloc

    text = "line\n" * 1_000_000
    tracemalloc.start()
    n, form, output, prefix, middle = fim.arrange(text, re.compile(fim.LINES), (400_000, 700_000, 0, 99))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, form, prefix, middle) == (1_000_000, "psm", 2_000_000, 1_500_000) and peak < 4 * len(text)


# --- 13: alignment ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    return Path(q.BYTES).read_text(encoding="utf-8"), Path(q.PIECES).read_bytes()


def brute_align(files, rows):
    """Token by token and byte by byte, with the libraries' own encoders and no packing."""
    a_tok = Tokenizer.from_str(files[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    symbol = {c: i for i, c in enumerate(align.byte_symbols())}
    a_raw = lambda i: bytes(symbol[c] for c in a_tok.id_to_token(i))

    def b_raw(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    each, count = [], Counter()
    for doc_id, text in rows:
        a, b, owner_a, owner_b = [], [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            for ids, raw, owner in ((a, a_raw, owner_a), (b, b_raw, owner_b)):
                whole = b""
                for place, i in enumerate(ids):
                    owner += [place] * len(raw(i))
                    whole += raw(i)
                if whole != (" " + text).encode():
                    a, b, owner_a, owner_b = [], [], [], []
                    break
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        count.update((b[y], a[x]) for x, y in links)
        cuts = [p for p in range(1, len(owner_a) + 1) if p == len(owner_a) or owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1]]
        groups, start = [], 0
        for p in cuts:
            groups.append(",".join(str(a[x]) for x in dict.fromkeys(owner_a[start:p])) + "|" + ",".join(str(b[y]) for y in dict.fromkeys(owner_b[start:p])))
            start = p
        each.append((doc_id, a, b, links, groups))
    best = {}
    for (y, _), n in count.items():
        best[y] = max(n, best.get(y, 0))
    out = Counter()
    for doc_id, a, b, links, groups in each:
        n = [count[b[y], a[x]] for x, y in links]
        out[doc_id, len(a), len(b), len(groups), len(links), sum(c == best[b[y]] for c, (_, y) in zip(n, links, strict=True)), sum(n), ";".join(groups)] += 1
    return out, count


ODD = [
    "<|endoftext|> <s> </s> <unk>", "two  blanks\n\n\ttabs\r\n", "▁ already a mark", "\x00\x01", "ñandú é é \U0001f600\U0001f468‍\U0001f469", " leading", "trailing ", "x" * 700 + " ", " " * 700, "1234567890" * 60,
    "中文字", "a" * 513 + "b", "﻿bom", " nbsp", "word " * 3000,
]


def test_align_brute_force(spark, edges, files, monkeypatch):
    rows = [(i, t) for i, t, *_ in EDGES]
    assert Counter(map(tuple, align.align(edges, q.BYTES, q.PIECES).collect())) == brute_align(files, rows)[0]
    r = random.Random(13)
    rows = list(enumerate(ODD)) + [(i % 60, " ".join(r.choices(["the", "Straße", "é", "x1", "\n", "<s>", "don't", "中", "", "token", "ization"], k=r.randint(0, 30)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected, count = brute_align(files, rows)
    monkeypatch.setattr(align, "PENDING", 40)
    monkeypatch.setattr(align, "HELD", 60)  # keys of a partition come in several parts
    assert Counter(map(tuple, align.align(df, q.BYTES, q.PIECES).collect())) == expected
    digests = Counter((x.doc_id, x.groups_sha256) for x in align.align(df, q.BYTES, q.PIECES, digest=True).collect())
    assert digests == Counter((k[0], sha(k[-1]) if k[-1] else "") for k, n in expected.items() for _ in range(n))
    own = align.pair(files)
    lengths = [np.array(list(map(len, x)), np.int64) for x in (own.a_bytes, own.b_bytes)]
    counts = align.count_shards(align.partial_counts(align.tokens(df, files), *lengths), len(lengths[1]))
    assert {(x.b_id, x.a_id): x.n for x in counts.table(spark).collect()} == dict(count)
    keys = np.array(sorted({b << 32 | a for b, a in count} | {5, (7 << 32) + 9, 1 << 60}))
    assert counts(keys).tolist() == [count.get((k >> 32, k & 0xFFFFFFFF), 0) for k in keys.tolist()]
    assert [(a[2] < b[1]) for a, b in zip(counts.shards, counts.shards[1:], strict=False)] == [True] * (len(counts.shards) - 1)


def test_align_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a▁b")], "doc_id long, text string")
    assert {tuple(x) for x in align.align(df, q.BYTES, q.PIECES, digest=True).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 2)}
    assert align.align(df.limit(0), q.BYTES, q.PIECES).count() == 0


def test_align_whole_table(spark, files):
    """The query's rows on sf0.001 against brute force."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = Counter((*k[:-1], sha(k[-1]) if k[-1] else "") for k, n in brute_align(files, rows)[0].items() for _ in range(n))
    assert Counter(map(tuple, q.op13_token_alignment(spark, SF).collect())) == expected


def test_quick_and_exact_routes_agree(files):
    own = align.pair(files)
    r = random.Random(3)
    for _ in range(3000):
        t = " " + "".join(r.choices(["a", "the", " ", "  ", "\n", "'s", "é", "9", "…", " ", "\t", "X", "　", "n't"], k=r.randint(1, 25)))
        assert own.quick.encode_ordinary(t) == own.exact.encode(t, add_special_tokens=False).ids, repr(t)

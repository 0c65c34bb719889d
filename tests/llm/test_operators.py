"""The operators against brute force, SQL, exact round trips and held-out accuracy, on whole small tables and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.harness import TESTDATA, same, session
from timbral.llm import bpe, chat, components, decontaminate, licenses, pii, quality, rules, simhash, substrings, toxicity
from timbral.llm import queries as q
from timbral.llm.oracles import oracle_sql

SF = f"{TESTDATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "null id text", "en", None, 1), (4, "   \n\t ", "en", "s", 1), (5, LONG, "en", "s", 1), (5, LONG, "en", "s", 1), (6, "Ärger É é   ß \x00 😀", None, "s", 1),
    (7, "one", "en", "s", 1), (7, "another text with the same id", "en", "s", 1), (8, "+1 (487) 555-7209 a@b.co 1.2.3.4, 4111111111111111 under the MIT license", "en", "s", 1),
]


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls anywhere, empty and very long texts, repeated rows and ids, and columns with names that operators use."""
    return spark.createDataFrame(EDGES, DOCS).withColumns({"words": F.lit(1), "count": F.lit(2), "g": F.lit(3), "print": F.lit(4)})


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    assert same(q.queries()[name](spark, SF), oracle_sql()[name], "sf0.001") > 0


# --- 1: chat ------------------------------------------------------------------------------------


def conversation_digests(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    r = random.Random(5)
    marks = [*chat.OPEN.values(), *chat.CLOSE.values(), chat.OTHER_OPEN, chat.OTHER_MID, chat.OTHER_CLOSE, "~", "~t", "~a", "é", "\n", "\\", "x" * 900, " "]
    data = [(c, t, r.choice(["user", "assistant", "system", "tool[:]~", None, ""]), r.choice([None, "", *["".join(r.choices(marks, k=r.randint(0, 9))) for _ in range(6)]])) for c in [*range(40), None] for t in [*range(r.randint(1, 30)), None, 3]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("extra"))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digests(df).collect()}
    assert got == conversation_digests(data)
    assert chat.digests(df.limit(0)).count() == 0
    w = chat.windows(df)
    assert w.filter("n_context > 5").count() == 0  # a system turn and HISTORY turns
    assert w.count() > 41


def test_chat_budget(spark):
    """Whole windows fit the budget, with system turns short or long, but where one turn and the system turn alone pass it."""
    r = random.Random(8)
    data = []
    for c in range(60):
        if c % 3:
            data.append((c, 0, "system", "s" * r.choice([10, 800, 2400, 3000])))
        data += [(c, t, r.choice(["user", "assistant"]), "x" * r.choice([5, 100, 400, 1200, 5000])) for t in range(1, 40)]
    data.append((99, 0, "assistant", "long " * 200_000))
    w = chat.windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    tokens = lambda x: -(-len(x) // chat.CHARS_A_TOKEN) + chat.TURN_TOKENS
    system = {c: tokens(x) for c, t, role, x in data if role == "system"}
    longest = {c: max(tokens(x) for d, _, role, x in data if d == c and role != "system") for c in {d[0] for d in data}}
    rows = w.select("conv_id", "n_context", "tokens", F.size(F.expr("regexp_extract_all(formatted, '(</s>|\\\\[/INST\\\\]|<</SYS>>)', 1)")).alias("turns")).collect()
    for x in rows:
        alone = x.turns - x.n_context == 1 and x.n_context <= 1
        assert x.tokens <= chat.BUDGET or alone and x.tokens <= system.get(x.conv_id, 0) + longest[x.conv_id], x
    assert sum(x.tokens <= chat.BUDGET for x in rows) > len(rows) / 2 and any(x.n_context > 1 for x in rows)


# --- 2: SimHash ---------------------------------------------------------------------------------


def brute_print(t):
    w = words(low(t))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    """prints: [(doc_id, print)] -> component_id of each."""
    distinct = sorted({p for _, p in prints})
    top = {p: p for p in distinct}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                top[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [least.get(find(p)) for _, p in prints]


def check_simhash(df):
    rows = df.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    expected = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == expected


def test_simhash(spark, edges):
    check_simhash(docs(spark))
    check_simhash(edges)
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [512, 4])
def test_links_lose_none(spark, monkeypatch, rows):
    """Crowded shards, dealt again or not, link what brute force links."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    r = random.Random(rows)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {0, *centres}
    for c in centres:
        for _ in range(60):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    df = spark.createDataFrame(signed, "print long")
    nodes = {x.node: x.root for x in components.components(simhash.links(df)).collect()}
    found, expected = {}, {}
    for (p,), c in zip(signed, brute_components([(i, s[0] % (1 << 64)) for i, s in enumerate(signed)]), strict=True):
        found.setdefault(nodes.get(p, p), set()).add(p)
        expected.setdefault(c, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_bk_tree():
    r = random.Random(1)
    tree, keys = simhash.BKTree(), []
    for _ in range(400):
        k = r.getrandbits(12)
        if k not in keys:
            assert sorted(tree.add_and_find(k, 3)) == [i for i, x in enumerate(keys) if (x ^ k).bit_count() <= 3]
            keys.append(k)


def test_components_of_a_chain(spark):
    chain = spark.range(60).select((F.col("id") * 7 % 61).alias("u"), ((F.col("id") + 1) * 7 % 61).alias("v"))
    assert {x.root for x in components.components(chain).collect()} == {0}
    assert components.components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("links", [1 << 16, 20])
def test_components_rounds_have_partitions_by_their_links(spark, monkeypatch, links):
    """However many partitions shuffles have, a round of few links has few tasks and files; the components stay the same."""
    r, seen, cut = random.Random(4), [], components.cut
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(0, x) for x in range(1000, 1100)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a

    def counted(df):
        out = cut(df)
        seen.append((out.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(components, "cut", counted)
    monkeypatch.setattr(components, "LINKS", links, raising=False)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {x.node: x.root for x in got} == {x: top(x) for p in pairs if p[0] != p[1] for x in p} and len(got) == len({x.node for x in got})
    assert len(seen) > 2 and all(n <= max(8, -(-before // links)) for (_, before), (n, _) in zip(seen, seen[1:]))



# --- 3: personal data ---------------------------------------------------------------------------


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base():
    r = random.Random(3)
    parts = [*"0123456789@.+- a_%()", "255", "256", "00001", "4111111111111111", "é"]
    for _ in range(15_000):
        t = "".join(r.choices(parts, k=r.randint(0, 30)))
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_query(spark, edges):
    for df in (docs(spark), edges):
        texts = Counter((x.doc_id, x.text) for x in df.collect())
        got = Counter()
        for (d, t), n in texts.items():
            base = brute_base(t or "")
            got[d, *[sum(k == x[0] for x in base) for k in pii.KINDS], sha(pii.coded(base))] += n
        rows = pii.detect(df).collect()
        assert Counter(tuple(x)[:6] for x in rows) == got
    assert pii.detect(edges.limit(0)).count() == 0
    assert {len(set(re.findall("email|ip|card|phone", x.spans))) for x in rows if x.doc_id == 8} == {4}


def test_pii_field():
    """Segments that the patterns don't know: held-out invented lines, and a dynamic program equal to enumeration."""
    hit = total = false = 0
    for text, gold in pii.invented_lines(seed=99):
        found = pii.find(text)[1]
        total += len(gold)
        hit += sum(g in found for g in gold)
        false += sum(f not in gold for f in found)
    assert hit / total > 0.9 and false / total < 0.15, (hit, total, false)
    spans = [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    y = np.random.default_rng(0).normal(size=(5, 4))

    def options(at):
        if at == 3:
            return [0.0]
        return [v for v in options(at + 1)] + [y[s, t] + v for s, (i, k) in enumerate(spans) if i == at for t in range(4) for v in options(at + k)]

    assert np.isclose(pii.forward(3, spans, y, False)[0][3], np.logaddexp.reduce(options(0)))
    assert np.isclose(pii.forward(3, spans, y, True)[0][3], max(options(0)))
    pii.find("a" * 100_000 + "@"), pii.find("1." * 50_000), pii.find("+1 " * 20_000)  # linear, or this wouldn't end


PLANTED = (
    ("phone", "(487) 555-7209"), ("phone", "487-555-7209"), ("phone", "487.555.7209"), ("phone", "487 555 7209"), ("phone", "06 12 34 56 78"), ("email", "joe at example dot com"), ("email", "joe [at] example [dot] com"),
    ("email", "joe (at) example (dot) com"), ("email", "joe(at)example.net"), ("card", "4111.1111.1111.1111"), ("card", "4111 - 1111 - 1111 - 1111"), ("ip", "10 . 0 . 0 . 1"), ("ip", "192 . 168 . 20 . 7"),
    ("card", "4111111111111111 5500005555555559"),
    # these are forms that the invented lines don't have
    ("phone", "0171/2345678"), ("phone", "(020) 7946 0958"), ("phone", "030 12345678"), ("phone", "030-1234567"), ("phone", "0711/123-4567"), ("phone", "01632 960 983"), ("card", "3056.930902.5904"), ("card", "3714 . 496353 . 98431"),
    ("card", "3782.822463.10005"), ("ip", "10[.]0[.]0[.]1"), ("ip", "172(.)16(.)254(.)3"), ("email", "jane {at} example {dot} com"), ("email", "jane.doe(at)example(dot)org"),
)
#: What looks like personal data and isn't.
PLAIN = ("on 12/10/2020 we", "from 0.123456 to 0.987654", "the 2020/2021 season", "order 0815/4711", "08:30:15 to 09:45:00", "pages 100/200 and 30 40")


def test_pii_planted(spark):
    """Forms that the patterns don't know, put into real texts: at least nine of ten of each are found, and few spans appear in texts as they are."""
    texts = [t for (t,) in docs(spark, f"{TESTDATA}/sf0.01").select("text").orderBy("doc_id", "text").collect() if t and len(t) > 200]
    r, w = random.Random(4), pii.trained()
    for kind, form in PLANTED:
        found = 0
        for t in r.sample(texts, 40):
            ws = t.split(" ")
            at = r.randint(1, len(ws) - 1)
            lead = " ".join(ws[:at]) + " "
            got = pii.find(f"{lead}{form} {' '.join(ws[at:])}", w)[1]
            gold = [(kind, m.start(), m.end()) for m in re.finditer(r"[0-9]{16}", form)] if re.fullmatch("[0-9]{16} [0-9]{16}", form) else [(kind, 0, len(form))]
            found += all((k, len(lead) + a, len(lead) + b) in got for k, a, b in gold)
        assert found >= 36, (form, found)
    assert [t for t in PLAIN if pii.find(t, w)[1]] == []
    more = sum(len(every) - len(base) for base, every in (pii.find(t, w) for t in texts))
    assert more <= 0.01 * len(texts), more


def test_redact(edges):
    got = {x.doc_id: x for x in pii.redact(edges).collect() if x.doc_id in (1, 8)}
    assert got[1].text is None and got[8].text == "[PHONE] [EMAIL] [IP], [CARD] under the MIT license" and got[8].words == 1


# --- 4: repeated passages -----------------------------------------------------------------------


def brute_removed(texts, k=35, history=()):
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in all_words for i in range(len(w) - k + 1))
    for t in history:
        w = words(t)
        seen.update({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(spark, edges):
    for df in (docs(spark), edges):
        rows = df.select("doc_id", "text").collect()
        expected = Counter((r.doc_id, *x) for r, x in zip(rows, brute_removed([r.text for r in rows]), strict=True))
        assert Counter(map(tuple, substrings.without_repeats(df).collect())) == expected
    assert substrings.without_repeats(edges.limit(0)).count() == 0


def test_suspects_are_verified(spark):
    """With 12 bits of the first fingerprint nearly all windows collide; words that don't repeat stay all the same."""
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(200)) for _ in range(60)]
    texts += [texts[0], " ".join(texts[1].split()[:80]) + " other end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = Counter((i, *x) for i, x in enumerate(brute_removed(texts)))
    for bits in (12, substrings.KEY_BITS):
        assert Counter(map(tuple, substrings.without_repeats(df, bits=bits).collect())) == expected


def test_common_passage(spark):
    """A passage that all documents have is two entries a run, and is found in each."""
    texts = [f"{i} " + "x y " * 3 + " ".join(f"w{j}" for j in range(40)) + f" {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    entries = substrings.runs(df).filter("g is null").agg(F.sum("n")).first()[0]
    assert entries < 300 * 14 + 2 * 2 * 12 * 2
    assert Counter(map(tuple, substrings.without_repeats(df).collect())) == Counter((i, *x) for i, x in enumerate(brute_removed(texts)))


def test_run_index(spark, tmp_path):
    """Two batches appended, one of them twice, an empty one and one of nulls; the third is judged before and after the runs are merged."""
    rows = docs(spark).select("doc_id", "text").orderBy("doc_id").collect()
    a, b, c = rows[:60], rows[60:120], rows[120:]
    frame = lambda r: spark.createDataFrame([tuple(x) for x in r], "doc_id long, text string")
    index = substrings.RunIndex(spark, str(tmp_path / "runs"), 5)
    assert index.history() is None
    for batch, name in ((a, "1"), (b, "2"), (b, "2"), ([], "3"), ([(None, None)], "4")):
        index.append(frame(batch), name)
    expected = Counter((r.doc_id, *x) for r, x in zip(c, brute_removed([r.text for r in c], history=[r.text for r in a + b]), strict=True))
    assert Counter(map(tuple, index.dedup(frame(c)).collect())) == expected
    index.compact("level-1", 2)
    index.compact("level-2")
    assert [n for n, _ in index.runs()] == ["level-2"] and len(list((tmp_path / "runs/runs").iterdir())) == 1
    assert Counter(map(tuple, index.dedup(frame(c)).collect())) == expected
    assert index.dedup(frame([])).count() == 0


# --- 5 and 6: fitted scores ---------------------------------------------------------------------


def held_out(spark, query, label, cut, sf="sf0.01"):
    df = query(spark, f"{TESTDATA}/{sf}").join(spark.read.parquet(f"{TESTDATA}/{sf}/labels.parquet"), "doc_id")
    rows = df.filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    return Counter((r[label], r.predicted) for r in rows)


def test_quality(spark, edges):
    c = held_out(spark, q.op5_quality, "quality", 0.3)
    assert c[1, 1] / (c[1, 1] + c[1, 0]) > 0.95 and c[0, 0] / (c[0, 0] + c[0, 1]) > 0.8, c
    labels = spark.createDataFrame([(2, None), (5, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        assert quality.score(edges, quality.learn(edges, lab)).count() == len(EDGES)
    assert quality.score(edges.limit(0), quality.learn(edges.limit(0), labels)).count() == 0


def test_forest_is_flat():
    """Vectorised traversal equals one node at a time."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    f = quality.fit(x, (x[:, 3] + x[:, 5] ** 2 > 1).astype(float))
    assert np.mean((f.scores(x) > 0.5) == (x[:, 3] + x[:, 5] ** 2 > 1)) > 0.95
    for row in x[:20]:
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.cut[t, node])
            total += f.value[t, node - (2**quality.DEPTH - 1)]
        assert np.isclose(f.scores(row[None])[0], 1 / (1 + np.exp(-total)))


@pytest.mark.xfail(reason="sf0.01 has six held-out toxic documents, two of them in words that no other labelled one has: 4 are found", strict=False)
def test_toxicity_of_few_examples(spark):
    c = held_out(spark, q.op6_toxicity, "toxic", 0.5)
    assert c[0, 0] / (c[0, 0] + c[0, 1]) > 0.97 and c[1, 1] / (c[1, 1] + c[1, 0]) > 0.8, c


def test_toxicity(spark, edges):
    c = held_out(spark, q.op6_toxicity, "toxic", 0.5, "sf0.1")
    assert c[0, 0] / (c[0, 0] + c[0, 1]) > 0.99 and c[1, 1] / (c[1, 1] + c[1, 0]) > 0.9, c
    labels = spark.createDataFrame([(2, None), (5, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        assert toxicity.score(edges, toxicity.learn(edges, lab)).count() == len(EDGES)
    assert toxicity.score(edges.limit(0), toxicity.learn(edges.limit(0), labels)).count() == 0


def brute_toxicity(rows, labels, k=toxicity.NEIGHBOURS):
    """rows: [(doc_id, text)], unique ids -> {doc_id: (score, evidence)}, every cosine computed."""
    bags = {d: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for d, t in rows}
    texts = dict(rows)
    best = {}
    for d, y in labels:
        if d in bags and y is not None and zlib.crc32(str(d).encode()) % 5:
            best[d] = max(int(y), best.get(d, 0))
    df = Counter(w for x in bags.values() for w in x)
    once = {texts[d] or "": max(y for e, y in best.items() if texts[e] == texts[d]) for d in best}
    n, toxic = Counter(), Counter()
    for t, y in once.items():
        own = set(re.findall(r"[^\W\d_]+", t.lower()))
        n.update(own)
        toxic.update(own if y else ())
    rate = sum(once.values()) / len(once)
    weight = {}
    for t in n:
        if 2 <= df[t] <= max(2, 0.1 * len(rows)):
            e, other = n[t] * rate, n[t] - toxic[t]
            g = 2 * ((toxic[t] * math.log(toxic[t] / e) if toxic[t] else 0) + (other * math.log(other / (n[t] - e)) if other else 0))
            weight[t] = (math.log((1 + len(rows)) / (1 + df[t])) + 1) * (1 + 0.1 * (max(0, g - 3.84) if toxic[t] > e else 0))

    def unit(bag):
        v = {t: (1 + math.log(m)) * weight[t] for t, m in bag.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {d: unit(bags[d]) for d in sorted(best)}
    prior = (sum(best.values()) + 0.5) / (len(best) + 1)
    out = {}
    for d, bag in bags.items():
        own = unit(bag)
        near = sorted((-round(sum(x * own.get(t, 0) for t, x in v.items()), 12), e) for e, v in examples.items())[:k]
        votes = [(1 / (1.02 - min(-c, 1)), best[e], e) for c, e in near if c < 0]
        out[d] = ((sum(v * y for v, y, _ in votes) + prior) / (sum(v for v, _, _ in votes) + 1), [e for _, _, e in votes][:5])
    return out


def test_toxicity_of_the_whole_query(spark):
    """Scores and evidence of every row against cosines with every example; few documents have no neighbour."""
    rows = [tuple(r) for r in docs(spark).select("doc_id", "text").collect()]
    expected = brute_toxicity(rows, [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()])
    got = q.op6_toxicity(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - expected[r.doc_id][0]) < 1e-9 and list(r.evidence) == expected[r.doc_id][1]
    assert sum(not r.evidence for r in got) < 0.02 * len(got)


@pytest.mark.parametrize("block", [toxicity.BLOCK, 16])
def test_nearest_is_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(4)

    def make():
        ids = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        return ids, rng.integers(1, 4, len(ids))

    vectors = [make() for _ in range(700)]
    index = toxicity.Index({f"t{i}": i for i in range(40)}, rng.uniform(1, 5, 40), vectors, rng.integers(0, 2, 700), list(range(700)))
    for query in [make() for _ in range(60)] + vectors[:10]:
        dense = np.zeros((701, 40))
        for i, v in enumerate([*vectors, query]):
            ids, w = index.unit(*v)
            dense[i, ids] = w
        cosines = np.round(dense[:700] @ dense[700], 12)
        expected = np.lexsort((np.arange(700), -cosines))[: toxicity.NEIGHBOURS]
        expected = expected[cosines[expected] > 0]
        assert index.names[index.nearest(*query)[0]].tolist() == expected.tolist()
    assert len(index.nearest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


# --- 7: BPE -------------------------------------------------------------------------------------


def test_bpe(spark, edges):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(q.VOCABULARY)

    def expect(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))

    for df in (docs(spark), edges):
        assert Counter(map(tuple, bpe.digests(df, q.VOCABULARY).collect())) == Counter(expect(r.doc_id, r.text) for r in df.collect())
    assert bpe.digests(edges.limit(0), q.VOCABULARY).count() == 0
    coder = bpe.coder(open(q.VOCABULARY, encoding="utf-8").read())
    r = random.Random(11)
    parts = [*"aabcdeeinorstIJ'’éÉßΣİ1² \t\n　中😀-_.!?<|>\x00", "the", "ing", "<|endoftext|>", "<|startoftext|>", "é", "don't", "ΑΣ"]
    for _ in range(4000):
        t = "".join(r.choices(parts, k=r.randint(0, 40)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    v = coder.vocabulary
    made = ["".join(r.choices("abcdeghinorst", k=r.randint(1, 20))) for _ in range(3000)]
    got, failing = v.encode_words(made)
    assert got == [v.merge(w) for w in made] and 0 < failing < len(made)


# --- 8: licences --------------------------------------------------------------------------------


def test_licenses(spark, edges):
    for df in (docs(spark), edges):
        expected = Counter()
        for r in df.collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text))
            at = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            expected[r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
        rows = licenses.scan(df).collect()
        assert Counter(tuple(x)[:6] for x in rows) == expected
        assert all(set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in rows)
    assert licenses.scan(edges.limit(0)).count() == 0


def test_automata():
    a = licenses.compile_template("x", "licensed|made {all <2>} under <2> the {old} licence")

    def accepts(t):
        return a.run(t.encode().split(), 0)[0]

    for t in ("licensed under the licence", "made all under the old licence", "licensed all of it under a b the licence", "licensed under x the licence"):
        assert accepts(t) == len(t.split()), t
    for t in ("licensed under licence", "licensed all of the many under the licence", "under the licence", "licensed under a b c the licence", "licensed under the older licence"):
        assert accepts(t) is None, t


def template_parts(text):
    """[(word choices, None) | (None, parts) for an optional region | (None, n) for a replaceable one]"""
    marks = re.findall(r"[{}]|<\d+>|[^\s{}<>]+", text)

    def read(i):
        out = []
        while i < len(marks) and marks[i] != "}":
            if marks[i] == "{":
                inner, i = read(i + 1)
                out.append((None, inner))
            elif marks[i][0] == "<":
                out.append((None, int(marks[i][1:-1])))
            else:
                out.append((marks[i].split("|"), None))
            i += 1
        return out, i

    return read(0)[0]


def reached(parts, ws, at):
    """By trying every way: (whether the parts match from at on, the most mandatory words met in order)."""

    def walk(todo, i, met):
        if not todo:
            return {(i, met, True)}
        (choice, inner), rest = todo[0], todo[1:]
        if choice is not None:
            return walk(rest, i + 1, met + 1) | {(i + 1, met + 1, False)} if i < len(ws) and ws[i] in choice else {(i, met, False)}
        out = set(walk(rest, i, met))
        if isinstance(inner, int):
            return out.union(*(walk(rest, i + k, met) for k in range(1, min(inner, len(ws) - i) + 1)))
        return out.union(*(walk(rest, j, met) for j, _, ok in walk(inner, i, 0) if ok))

    got = walk(parts, at, 0)
    return any(ok for _, _, ok in got), max(m for _, m, _ in got)


def brute_license(text, templates):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    labels, score = set(), 0.0
    for label, t in templates:
        parts = template_parts(t)
        total = sum(c is not None for c, _ in parts)
        for at, w in enumerate(ws):
            if w in parts[0][0]:
                ok, met = reached(parts, ws, at)
                labels.update({label} if ok else ())
                score = max(score, 1.0 if ok else met / total)
    base = {label for label, p in licenses.PHRASES.items() if f" {p} " in f" {' '.join(ws)} "}
    return ",".join(sorted(labels | base)), 1.0 if base else score


def test_license_labels_and_scores(spark, edges):
    r = random.Random(6)
    toy = (("x", "licensed|made {all <2>} under <2> the {old {very}} licence"), ("y", "the {a|b} licence of|by it"), ("mpl", "mozilla public license"))
    parts = "licensed made all of under x the old very licence a b by it mozilla public license".split()
    texts = [" ".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)] + ["Made all, UNDER the old licence.", "the Mozilla Public License"]
    scanner = licenses.Scanner(templates=toy)
    for t in texts:
        _, base, labels, score = scanner.scan(t)
        assert (",".join(sorted(labels | {b for _, b in base})), score) == brute_license(t, toy), t
    for df in (docs(spark), edges):
        got = licenses.scan(df).select("doc_id", "labels", "score").collect()
        assert Counter(map(tuple, got)) == Counter((x.doc_id, *brute_license(x.text, licenses.TEMPLATES)) for x in df.collect())
    with pytest.raises(ValueError, match="mandatory"):
        licenses.compile_template("z", "{maybe} this")


def test_whole_license_texts():
    """Each template's own wording, its regions filled or left out, has its label; with one mandatory word changed it is not accepted."""
    r = random.Random(1)

    def worded(parts):
        out = []
        for choice, inner in parts:
            if choice:
                out.append(r.choice(choice))
            elif isinstance(inner, int):
                out += ["word"] * r.randint(0, inner)
            elif r.random() < 0.5:
                out += worded(inner)
        return out

    for label, t in licenses.TEMPLATES:
        ws = worded(template_parts(t))
        assert label in licenses.Scanner().scan("Lead, " + " ".join(ws).upper() + " tail")[2], t
        a = licenses.compile_template(label, t)
        own = [w.encode() for w in ws]
        at = max(i for i in range(len(ws)) if own[i] != b"word" and not re.search(r"[{|]", t)) if not re.search(r"[{|<]", t) else 0
        assert a.run([*own[:at], b"wrong", *own[at + 1 :]], 0)[0] is None


# --- 9: rules -----------------------------------------------------------------------------------


def test_rules(spark, edges):
    expected = Counter()
    for r in edges.collect():
        w, lines = words(r.text), [x for x in (r.text or "").split("\n") if words(x)]
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        expected[r.doc_id, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    rows = rules.judge(edges).collect()
    assert Counter(tuple(x)[:7] for x in rows) == expected
    assert not any(x.kept and x.base_failed for x in rows)
    assert rules.judge(edges.limit(0)).count() == 0


def test_sketches_merge(spark):
    """Sketches of parts add up to that of the whole, however rows are dealt: by a measure, by a hash of the id, or twice."""
    m = rules.measures(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet"))
    whole = Counter(map(tuple, rules.sketch(m).collect()))
    add = lambda a, b: Counter(map(tuple, rules.sketch(a).unionByName(rules.sketch(b)).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n")).collect()))
    for key in ("n_words % 2", "pmod(xxhash64(doc_id), 2)"):
        assert add(m.filter(f"{key} = 0"), m.filter(f"{key} = 1")) == whole
    doubled = {r[:4]: r[4] for r in map(tuple, rules.sketch(m.unionByName(m)).collect())}
    assert doubled == {r[:4]: 2 * r[4] for r in whole}
    assert sum(r[4] for r in whole if r[2] == "n_words") == m.filter("not base_failed").count()


def test_thresholds_adapt(spark):
    """Fences differ between groups, follow a group's own words, and decide: what is ordinary in one language is dropped in another."""
    r = random.Random(2)
    text = lambda k, n: " ".join("x" * max(1, round(r.gauss(k, 1))) + r.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(k, 120), lang, source, 1) for i, (k, lang, source) in enumerate([(4, "en", "a"), (4, "en", "b"), (9, "de", "a"), (10, "de", "b")] * 80)]
    odd = [(1001, text(9, 120), "en", "a", 1), (1002, text(4, 120), "de", "a", 1), (1004, text(4, 120), "en", "thin", 1)]
    df = spark.createDataFrame(rows + odd, DOCS)
    kept = {x.doc_id: x.kept for x in rules.judge(df).collect()}
    assert [kept[i] for i, *_ in odd] == [False, False, True]
    assert sum(not kept[i] for i, *_ in rows) <= 3
    fences = {(x.lang, x.source): (x.low_mean_word, x.high_mean_word) for x in rules.thresholds(rules.sketch(rules.measures(df))).collect()}
    assert len(set(fences.values())) >= 4 and fences["de", "b"] > fences["de", "a"] > fences["en", "a"]


def test_rules_by_labels(spark):
    """On the fold that no figure was chosen on: nearly all good documents stay, most bad ones that pass the base go."""
    judged = q.op9_quality_rules(spark, f"{TESTDATA}/sf0.1").filter("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    c = Counter((x.quality, x.kept) for x in judged.join(spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet"), "doc_id").collect())
    assert c[1, True] / (c[1, True] + c[1, False]) > 0.99 and c[0, False] / (c[0, True] + c[0, False]) > 0.75, c


# --- 10: decontamination ------------------------------------------------------------------------


def brute_hits(text, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = split(text), set(), set()
    for item_id, t in items:
        iw = split(t)
        wins = {tuple(iw[i : i + k]) for i in range(max(1, len(iw) - k + 1))} if iw else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_decontaminate(spark, monkeypatch, limit):
    """With and without a broadcast; short items, null items, repeated ones, letters that fold beyond A-Z."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    r = random.Random(8)
    items = [(1, "a B c d e f g h i j k l"), (2, "one two"), (3, "É"), (4, None), (5, "..."), (6, "a b c d e f g h i j"), (6, "x y z x y z"), (7, "the the the the the the the the the the the")]
    texts = [None, "", "a b C d e f g h i j k", "one TWO one two", "é É", "z a b c d e f g h i", "the " * 40, *[" ".join(r.choices(["a", "b", "one", "two", "the", "x", "y", "z", "É", "é"], k=60)) for _ in range(20)]]
    texts += ["lead " + "A b c d e f g h i j k l" + " tail"] * 2
    d = spark.createDataFrame([(i % 25, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("h", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((i % 25, *brute_hits(t, items)) for i, t in enumerate(texts))
    assert Counter(map(tuple, decontaminate.report(d, b).collect())) == expected
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(n for k, n in expected.items() if not k[-1])
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).filter("contaminated").count() == 0


def test_word_hashes_in_pieces(monkeypatch):
    """A text's words hash alike however it is dealt in pieces; words end as bytes.split ends them; equal words are equal, others are not."""
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "ba", "é", "\0", "a" * 40, " ", "\n", "\t\x0b", "  "]) for _ in range(3000))
    windows = substrings.Windows()
    whole, words = windows.hashes(text), windows.words(text)
    assert len(whole) == len(words)
    of: dict[bytes, int] = {}
    for w, h in zip(words, whole.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    monkeypatch.setattr(substrings, "PIECE", 7)
    assert windows.hashes(text).tolist() == whole.tolist()
    assert windows.hashes(None).tolist() == windows.hashes(" \n").tolist() == []


def test_toxicity_words_and_counts():
    """ASCII texts are split without the pattern, with the same words; counts are those of a plain count, of terms alone."""
    r = random.Random(11)
    terms = {w: i for i, w in enumerate(["der", "ab", "the", "idiot", "straße"])}
    index = toxicity.Index(terms, np.ones(len(terms)), [], np.zeros(0), [])
    texts = ["", None, "The the THE, idiot_ab 7der", "Straße der ab İ", "\x00a\x1cb\x7f", "".join(map(chr, range(128)))]
    texts += ["".join(r.choice("aAbBeh t_\n09-\x0b\x1f" + extra) for _ in range(200)) for extra in ("", "ßé") for _ in range(50)]
    for t in texts:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        assert toxicity.words_of(t) == words
        ids, n = index.counts(t)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == Counter(terms[w] for w in words if w in terms) and (np.diff(ids) > 0).all()
    assert toxicity.LETTERS.isascii()

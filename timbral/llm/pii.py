"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments: a segment of up to MAX_TOKENS tokens and a type
has the weighted sum of features of the whole span (digits, groups, separators, check
digit, edges, the word before it). A dynamic program over a region's tokens chooses
boundaries and types together. Weights are fitted here, by gradient ascent on the exact
log-likelihood (forward and backward sums over all segmentations), on a fixed, seeded set of
TRAIN_LINES invented lines; they depend on no corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
TRAIN_LINES, EPOCHS, RATE, RIDGE = 1200, 10, 0.25, 1e-3
#: Tokens whose segments are scored at a time; the dynamic program runs over the whole region.
SCORED_TOKENS = 256
#: Log-odds against no entity that a span needs to be added.
MARGIN = 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9]{3}|[0-9]{1,2}(?: ?[.-] ?| )[0-9]{1,3}(?: ?[.-] ?| )[0-9]{1,3}|[0-9][(\[]\.[)\]][0-9]|@|[(\[{](?:at|dot)[)\]}]|(?<= )at [A-Za-z0-9-]+ dot ", re.I)
#: Chunks that a region goes on over: of digits and separators, or a mark and the chunk beyond it.
NUMERIC = re.compile(r"[0-9().+/,;:-]+")
MARK = re.compile(r"@|dot|[(\[{](?:at|dot)[)\]}]", re.I)
MARK_BEFORE = re.compile(MARK.pattern + "|at", re.I)
CHUNK_AFTER = re.compile(r"[ \t]{1,3}([^\s]{1,64})(?!\S)")
CHUNK_BEFORE = re.compile(r"(?<!\S)([^\s]{1,64})[ \t]{1,3}\Z")
#: Characters around a trigger that its region takes in, up to white space.
REACH = 48
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
CUES = {"email": 0, "mail": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's patterns, leftmost and non-overlapping per kind, in order of kind and start; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m[0])
        if len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


# --- features of whole spans -------------------------------------------------------------

FEATURES = (
    "bias", "tokens", "digits<4", "digits4-8", "digits9-12", "digits13-19", "digits>19", "at", "dot after at", "letters", "luhn", "plus first", "paren", "groups1",
    "groups2-3", "groups4", "groups>4", "dots only", "dash or blank only", "octets", "blank edge", "mark edge", "alnum before", "alnum after", "digit unit cut", "cue", "odd mark", "shape 3-3-4", "shape of twos", "shape of fours", "trunk zero",
)
AT = re.compile(r"@|[(\[{]at[)\]}]| at ", re.I)
DOT_ON = re.compile(r" (?:dot|[(\[{]dot[)\]}]) ", re.I)
DOT_LAST = re.compile(r" (?:dot|[(\[{]dot[)\]}])\Z", re.I)
DOT = re.compile(r"\.|[(\[{]dot[)\]}]| dot ", re.I)
#: A national number: an area code that begins with 0, bracketed or not, and the rest.
TRUNK = re.compile(r"(?:0[0-9]{2,4}|\(0[0-9]{2,4}\))[ /.-][0-9][0-9 /.-]*[0-9]")


def span_features(text: str, start: int, end: int, cue: int) -> np.ndarray:
    """One row of FEATURES; the cue feature is left to the type (see scores)."""
    s = text[start:end]
    digits = DIGITS.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    at = AT.search(s)
    marks = set(re.sub(r"[0-9A-Za-z]", "", s))
    n, g = len(digits), len(groups)
    before, after = text[start - 1 : start], text[end : end + 1]
    x = np.zeros(len(FEATURES))
    x[0], x[1] = 1, len(s) / 20
    x[2 if n < 4 else 3 if n < 9 else 4 if n < 13 else 5 if n < 20 else 6] = 1
    x[7], x[8] = bool(at), bool(at and DOT.search(s, at.end()))
    x[9] = bool(re.search(r"[A-Za-z]", s))
    x[10] = 13 <= n <= 19 and luhn(digits)
    x[11], x[12] = s[0] == "+", s.count("(") == 1 == s.count(")")
    x[13 if g < 2 else 14 if g < 4 else 15 if g == 4 else 16] = 1
    x[17], x[18] = marks == {"."}, bool(marks) and marks <= {" ", "-"}
    x[19] = g == 4 and marks <= set(". []()") and s.count(".") == 3 and all(int(q) <= 255 for q in groups if len(q) < 4) and max(map(len, groups)) < 4
    x[20], x[21] = s[0].isspace() or s[-1].isspace(), (not s[0].isalnum() and s[0] != "+" and not (s[0] == "(" and s[1:2].isdigit())) or not s[-1].isalnum()
    x[22], x[23] = before.isalnum(), after.isalnum()
    x[24] = (before in {".", "-", "+", "@"} and before != "") or (after in {"@", "-"} and after != "") or bool(DOT_ON.match(text, end) or DOT_LAST.search(s))
    x[25], x[26] = cue >= 0, bool(marks - set(" .-+()@[]{}_%/"))
    sizes = [len(q) for q in groups]
    x[27], x[28], x[29] = sizes[-3:] == [3, 3, 4] and g < 5, g > 3 and set(sizes) == {2}, g > 3 and set(sizes) == {4}
    x[30] = 8 < n < 13 and g < 5 and bool(TRUNK.fullmatch(s))
    return x


def all_spans(text: str, tokens: list[tuple[int, int]], cue: int, first: int = 0, stop: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first token, tokens) of each candidate segment that starts in first to stop, and their features. Candidates have three digits or an at sign."""
    spans, rows = [], []
    for i in range(first, len(tokens) if stop is None else min(stop, len(tokens))):
        for k in range(1, min(MAX_TOKENS, len(tokens) - i) + 1):
            a, b = tokens[i][0], tokens[i + k - 1][1]
            if text[a].isspace() or text[b - 1].isspace():
                continue
            s = text[a:b]
            if sum(c.isdigit() for c in s) >= 3 or AT.search(s):
                spans.append((i, k))
                rows.append(span_features(text, a, b, cue))
    return spans, np.array(rows).reshape(-1, len(FEATURES))


def scores(weights: np.ndarray, x: np.ndarray, cue: int) -> np.ndarray:
    """spans x kinds; the cue counts for the type that it names only."""
    y = x @ weights.T
    if cue >= 0 and len(x):
        y -= np.outer(x[:, 25], weights[:, 25])
        y[:, cue] += weights[cue, 25]
    return y


def region_cue(before: str) -> int:
    words = re.findall(r"[A-Za-z]+", before[-24:])
    return CUES.get(words[-1].lower(), -1) if words else -1


def forward(n: int, spans: list[tuple[int, int]], y: np.ndarray, best: bool) -> tuple[np.ndarray, list]:
    """Sums (or maxima) over the segmentations of the first j tokens; outside tokens score 0."""
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, k) in enumerate(spans):
        by_end[i + k].append(s)
    a, back = np.zeros(n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        a[j] = a[j - 1]
        for s in by_end[j]:
            v = a[spans[s][0]] + y[s]
            if best:
                t = int(v.argmax())
                if v[t] > a[j]:
                    a[j], back[j] = v[t], (s, t)
            else:
                a[j] = np.logaddexp(a[j], np.logaddexp.reduce(v))
    return a, back


def invented_lines(seed: int = 7) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    r = random.Random(seed)

    def num(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(r.choice("abdehinorstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        sizes = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)])
        d = r.choice("3456") + num(sum(sizes) - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-", ".", " - "])
        ends = [0, *accumulate(sizes)]
        return sep.join(d[a:b] for a, b in pairwise(ends))

    def octets() -> str:
        return r.choice([".", ".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))

    made = {
        "email": lambda: r.choice(["{0}@{1}.com", "{0}.{2}@{1}.example.org", "{0} at {1} dot com", "{0}(at){1}.net", "{0} [at] {1} [dot] com", "{0} (at) {1} (dot) org", "{0}.{2} [at] {1}.net", "{0} at {1} dot {2} dot org", "{0}{3}@{1}.de", "{0} {{at}} {1}.net"]).format(word(), word(), word(), num(2)),
        "ip": octets,
        "card": card,
        "phone": lambda: r.choice(["+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+44 {0} {1} {2}", "{0}.{1}.{2}", "{0} {1} {2}", "+1{0}{1}{2}", "06 {3} {4} {5} {6}", "{3}-{4}-{5}-{6}-{7}", "0{3}/{0}{2}", "(0{3}) {1} {2}", "0{3} {0}{1}", "0{3}-{2}{4}"]).format(num(3), num(3), num(4), *(num(2) for _ in range(5))),
        None: lambda: r.choice([num(4), num(3), num(8), num(6) + "." + num(2), f"{num(4)}-{num(2)}-{num(2)}", num(12), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 20, 32, 40]))), "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{num(1)}.{num(3)}.{num(2)}", f"{num(3)} {num(4)}", f"{num(5)}-{num(4)}-{num(6)}", num(16), num(22), f"v{num(1)}.{num(3)}", f"{num(3)},{num(3)},{num(3)}", f"{num(4)} {num(4)} {num(4)}", "@" + word(), f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}/{num(4)}", f"0.{num(8)}", f"0{num(5)}", f"0{num(9)}"]),
    }
    cue = {"email": ["mail", "email"], "ip": ["ip", "host"], "card": ["card", "visa"], "phone": ["tel", "phone", "call"]}
    for _ in range(TRAIN_LINES):
        text, spans = word(), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*KINDS, None, None, None])
            lead = r.choice(cue[kind]) if kind and r.random() < 0.3 else word()
            text += f" {lead}{r.choice([' ', ': '])}"
            s = made[kind]()
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            if kind == "card" and r.random() < 0.3:  # another one beside it
                text, s = text + s + " ", made[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice([" ", ". ", ", ", "\n"]) + word()
        yield text, spans


def grown(text: str, s: int, e: int, mail: bool) -> tuple[int, int]:
    """A region taken on over the chunks beside it that its entity may go on in, MAX_TOKENS tokens each way at most."""
    last = text[max(text.rfind(" ", s, e) + 1, s) : e]
    beyond, left = mail and bool(MARK.fullmatch(last)), MAX_TOKENS
    while (m := CHUNK_AFTER.match(text, e)) and (beyond or (MARK if mail else NUMERIC).fullmatch(m[1])):
        left -= len(TOKEN.findall(m[0]))
        if left < 0:
            break
        e, beyond = m.end(), mail and bool(MARK.fullmatch(m[1]))
    first = text[s : e if (at := text.find(" ", s, e)) < 0 else at]
    beyond, left = mail and bool(MARK_BEFORE.fullmatch(first)), MAX_TOKENS
    while (m := CHUNK_BEFORE.search(text[max(0, s - 68) : s])) and (beyond or (MARK_BEFORE if mail else NUMERIC).fullmatch(m[1])):
        left -= len(TOKEN.findall(m[0]))
        if left < 0:
            break
        s, beyond = s - len(m[0]), mail and bool(MARK_BEFORE.fullmatch(m[1]))
    return s, e


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may hold an entity: what surrounds a trigger up to white space and what it goes on in, those a few characters apart together."""
    a = b = None
    for m in TRIGGER.finditer(text):
        s, e = m.span()
        if b is not None and e <= b:
            continue
        low, high = max(0, s - REACH, b or 0), min(len(text), e + REACH)
        while s > low and not text[s - 1].isspace():
            s -= 1
        if m[0][-1] == " " or m[0][0] in "([{" or text[s : m.start()] == "":  # a name may stand before "at"
            s = max(low, text.rfind(" ", max(0, s - REACH), max(0, s - 1)) + 1) if m[0][:2].lower() in ("at", "(a", "[a", "{a") else s
        while e < high and not text[e].isspace():
            e += 1
        s, e = grown(text, s, e, not m[0][0].isdigit())
        if b is not None and s - b <= 2:
            b = max(b, e)
            continue
        if b is not None:
            yield a, b
        a, b = s, e
    if b is not None:
        yield a, b


def region_tokens(text: str, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
    """A region's cue, and its tokens, with one chunk before it when in reach."""
    lead = text.rfind(" ", max(0, a - 8), max(0, a - 1))  # for what a prefix such as "(487)" opens
    begin = lead + 1 if lead >= 0 else a
    return region_cue(text[max(0, a - 24) : a]), [m.span() for m in TOKEN.finditer(text, begin, b)]


def decoded(text: str, tokens: list[tuple[int, int]], cue: int, w: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation of all tokens, last first: forward's recurrence, with the spans of SCORED_TOKENS starts in memory at a time."""
    n = len(tokens)
    a, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for first in range(0, n, SCORED_TOKENS):
        stop = min(first + SCORED_TOKENS, n)
        spans, x = all_spans(text, tokens, cue, first, stop)
        y = scores(w, x, cue) - MARGIN
        kinds = y.argmax(axis=1).tolist() if spans else []
        at = 0
        for i in range(first, stop):
            if i and a[i - 1] >= a[i]:
                a[i], back[i] = a[i - 1], None
            while at < len(spans) and spans[at][0] == i:
                k, t = spans[at][1], kinds[at]
                v = a[i] + float(y[at, t])
                if v > a[i + k]:
                    a[i + k], back[i + k] = v, (i, t)
                at += 1
    if n and a[n - 1] >= a[n]:
        back[n] = None
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, t = back[j]
            out.append((KINDS[t], tokens[i][0], tokens[j - 1][1]))
            j = i
    return out


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """kinds x features, by stochastic gradient ascent with AdaGrad steps; fitted once, on the driver, which sends them along."""
    w, seen = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-6)
    data = []
    for text, gold in invented_lines():
        for a, b in regions(text):
            cue, tokens = region_tokens(text, a, b)
            spans, x = all_spans(text, tokens, cue)
            if not spans:
                continue
            where = {(tokens[i][0], tokens[i + k - 1][1]): s for s, (i, k) in enumerate(spans)}
            truth = np.zeros((len(spans), len(KINDS)))
            for kind, s, e in gold:
                if (s, e) in where:
                    truth[where[s, e], KINDS.index(kind)] = 1
            data.append((len(tokens), spans, x, cue, truth))
    order = random.Random(3)
    for _ in range(EPOCHS):
        order.shuffle(data)
        for n, spans, x, cue, truth in data:
            y = scores(w, x, cue)
            fore, _ = forward(n, spans, y, False)
            back, _ = forward(n, [(n - i - k, k) for i, k in spans], y, False)
            inside = np.array([fore[i] + back[n - i - k] for i, k in spans])[:, None] + y - fore[n]
            push = truth - np.exp(np.minimum(inside, 0))
            grad = push.T @ x
            grad[:, 25] = push[:, cue] @ x[:, 25] * (np.arange(len(KINDS)) == cue) if cue >= 0 else 0
            grad -= RIDGE * w
            seen += grad**2
            w = w + RATE * grad / np.sqrt(seen)
    return w


def field_spans(text: str, w: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """What the field finds, best segmentation of each region."""
    w, out = trained() if w is None else w, []
    for a, b in regions(text):
        cue, tokens = region_tokens(text, a, b)
        out += decoded(text, tokens, cue, w)
    return out


def find(text: str | None, w: np.ndarray | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): base ones stay, the field's are added where they touch none of those. In order of kind and start."""
    base = base_spans(text) if text else []
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    far = np.maximum.accumulate([e for _, e in taken]) if taken else starts
    more = []
    for kind, s, e in field_spans(text, w) if text else []:
        i = int(np.searchsorted(starts, e)) - 1 if taken else -1
        if i < 0 or far[i] <= s:
            more.append((kind, s, e))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def coded(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, w: np.ndarray | None = None) -> str | None:
    """Each span, overlapping ones as one, replaced by its kind in brackets; null stays null."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(find(text, w)[1], key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row.

    The counts and the digest are those of the base; spans holds all, as kind:start:end in
    code points, end exclusive. A null text counts as empty: no spans, the digest of the empty
    string. Repeated rows and null ids stay; an empty table gives no rows; other columns are dropped.
    """

    w = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [find(t, w) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in g[0]) for g in got], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(coded(g[0]).encode()).hexdigest() for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([coded(g[1]) for g in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of detect replaced in the named column; every other column and every row stays."""
    at, w = docs.columns.index(text), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.names[at], pa.array([redacted(t, w) for t in b.column(at).to_pylist()], pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select([F.col(f"`{c}`") for c in docs.columns]).schema)
    return map_arrow(docs, run, schema)

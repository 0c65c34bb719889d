"""Fill-in-the-middle: a text is cut at two ranks of units, and its middle is asked for last.

Two passes of a lazy matcher in constant memory: the first counts the units, the second
goes on from match to match to both ranks. No list of units is ever made. Ranks and form
are drawn from a hash of (seed, doc_id), so they don't depend on partitions or retries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import map_arrow

LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"\s*\S+|\s+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits; a null id is drawn for as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def ends(unit: re.Pattern[str], text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units number low and high end, 0 for none; low <= high."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def arrange(text: str, unit: re.Pattern[str], drawn: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, characters of the prefix, of the middle) of a text."""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = drawn
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    a, b = ends(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return n, "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", a, b - a
    return n, "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", a, b - a


def transform(docs: DataFrame, unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, n, form, output, prefix_chars, middle_chars), one row per row of docs.

    unit is a pattern whose matches, left to right, make up the text; rate and spm are
    percentages (of texts that are cut, of those whose suffix comes first). Texts that are
    null (empty output), empty or hold a marker stay plain, with null lengths. A null doc_id has
    draws of its own; repeated rows have equal results; an empty table gives no rows; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for b in batches:
            got = [arrange(t or "", pattern, draws(seed, i), rate, spm) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            n, form, output, prefix, middle = zip(*got, strict=True) if got else ((),) * 5
            long = pa.int64()
            columns = [b.column(0), pa.array(n, long), pa.array(form, pa.string()), pa.array(output, pa.string()), pa.array(prefix, long), pa.array(middle, long)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def restored() -> F.Column:
    """The text again, from `output` and `form`: a cut text holds no marker, so the markers part it unmistakably."""
    part = lambda i: F.element_at(F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), i)
    return F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))

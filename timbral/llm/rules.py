"""Quality rules with thresholds from the data, with DataFrame functions only.

Every measure's distribution per language and source is a mergeable quantile sketch:
counts by log-linear bucket (values keep their BITS leading bits), summed by key before and after
the shuffle. Every row feeds it but those that fail the base, copies as often as they come, so the
sketch of two tables together is the sum of theirs. A group's quantiles are drawn to its language's as if PRIOR more documents of the language
were in it, so thin groups follow the language. From them come, for each group,
- fences on both sides of the mean length of words and of words without symbols,
  SPREAD times the spread between the quartiles beyond these (the group's or the language's spread,
  whichever is wider), and wider for texts shorter than the group's median, as a mean varies
  with one over the square root of the length;
- upper fences on the shares of repeated words and lines, SPREAD times the distance of the 90th and
  99th percentile beyond the latter.
Documents are then joined with their group's fences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.llm.common import cut

SPACE = r"[\\x20\\t-\\r]"
SPREAD, PRIOR, BITS = 3, 50, 8
WORDS, SHARES = ("mean_word", "plain_word"), ("repeat_share", "dup_line_share")
MEASURES = (*WORDS, *SHARES, "n_words")
#: The quantiles that the fences need, in hundredths.
QUANTILES = (25, 50, 75, 90, 99)


def measures(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, lang, source, ...) -> (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, MEASURES), written once: a filter pushed below it would split each text anew for each of its words."""
    fives = ", ".join(f"words[i + {j}]" if j else "words[i]" for j in range(5))
    # equal neighbours among the sorted (hash, place) pairs are windows found twice; each covers five words from its place
    places = """array_sort(transform(
        filter(sequence(0, size(pairs) - 1), i -> (i > 0 AND pairs[i].h = pairs[greatest(i - 1, 0)].h) OR (i < size(pairs) - 1 AND pairs[i].h = pairs[least(i + 1, size(pairs) - 1)].h)),
        i -> pairs[i].at))"""
    covered = f"aggregate(transform(array(array_sort(transform(hashes, (h, i) -> struct(h AS h, i AS at)))), pairs -> {places})[0], named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.end), 'end', p + 5), a -> a.n)"
    return cut(
        docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("words", F.expr(f"filter(split(text, '{SPACE}+'), w -> w <> '')"))
        .withColumn("lines", F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\t-\\\\r]')"))
        .withColumn("hashes", F.expr(f"CASE WHEN size(words) >= 5 THEN transform(sequence(0, size(words) - 5), i -> xxhash64({fives})) ELSE array() END"))
        .select(
            "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr(f"CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN {covered} ELSE 0L END").alias("n_repeat_words"),
        )
        .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .withColumn("repeat_share", F.expr("1000 * n_repeat_words div greatest(n_words, 1)"))
        .withColumn("mean_word", F.expr("100 * word_chars div greatest(n_words, 1)"))
        .withColumn("plain_word", F.expr("100 * (word_chars - n_symbols) div greatest(n_words, 1)"))
        .withColumn("dup_line_share", F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"))
        .drop("n_lines")
    )


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): sketches of two tables are merged by adding n of equal keys."""
    shift = f"greatest(length(bin(v)) - {BITS}, 0)"
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")
    return measured.filter("not base_failed").select("lang", "source", values).select("lang", "source", "x.measure", F.col("x.v").alias("v")).groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketched: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, q25, ...): the least bucket that as many hundredths of the values reach."""
    group = Window.partitionBy(*keys, "measure")
    at = sketched.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    return at.groupBy(*keys, "measure").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q}") for q in QUANTILES])


def thresholds(sketched: DataFrame) -> DataFrame:
    """(lang, source, n, median_words) and for each of WORDS low_, high_ and spread_, for each of SHARES most_."""
    own = _quantiles(sketched, "lang", "source")
    wide = _quantiles(sketched.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), "lang")
    wide = wide.select(F.col("lang").alias("l"), F.col("measure").alias("m"), *[F.col(f"q{q}").alias(f"l{q}") for q in QUANTILES])
    drawn = own.join(wide, F.expr("lang <=> l and measure = m")).select("lang", "source", "measure", "n", "l25", "l75", *[F.expr(f"(n * q{q} + {PRIOR} * l{q}) div (n + {PRIOR})").alias(f"q{q}") for q in QUANTILES])
    of = lambda m, what: F.max(F.when(F.col("measure") == m, F.expr(what)))
    return drawn.groupBy("lang", "source").agg(
        F.max("n").alias("n"), of("n_words", "q50").alias("median_words"),
        *[of(m, what).alias(f"{name}_{m}") for m in WORDS for name, what in (("low", "q25"), ("high", "q75"), ("spread", "greatest(q75 - q25, l75 - l25)"))],
        *[of(m, f"q99 + {SPREAD} * (q99 - q90)").alias(f"most_{m}") for m in SHARES],
    )


def _far(m: str) -> str:
    """How far beyond the quartiles, squared, by the number of words a mean is of."""
    return f"cast(greatest({m} - high_{m}, low_{m} - {m}, 0) as double) * greatest({m} - high_{m}, low_{m} - {m}, 0) * n_words <= cast({SPREAD} * spread_{m} as double) * ({SPREAD} * spread_{m}) * greatest(n_words, median_words)"


#: What a document must meet besides the base.
WITHIN = " and ".join([*map(_far, WORDS), *(f"{m} <= most_{m}" for m in SHARES)])


def judge(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, lang, source, ...) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, source).

    One row per row of docs. A null text counts as empty: no words, so it fails the base.
    Null languages and sources are groups like others. Repeated rows and null ids stay; an
    empty table gives no rows; other columns are dropped.
    """
    measured = measures(docs)
    fences = thresholds(sketch(measured)).drop("n").withColumnsRenamed({"lang": "l", "source": "s"})
    return measured.join(fences, F.expr("lang <=> l and source <=> s"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not base_failed and coalesce({WITHIN}, true)").alias("kept"), "lang", "source"
    )

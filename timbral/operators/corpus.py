"""Corpus operators: counting, splitting, fanning out, numbering, checking and sub-sampling clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions import factors, labels
from timbral.functions.draws import draw, shuffle_key
from timbral.functions.strategy import Mixes
from timbral.operators.numbering import numbered

# The chance of each raw-waveform operation, in order; the codec's chances and ranges.
STAGES = [("linear_filter", 0.5), ("nonlinear_distortion", 0.3), ("additive_noise", 0.6), ("gain_variation", 0.4), ("clipping", 0.2)]
CODEC = {"rates": (8000, 16000), "loss": 0.5, "loss_range": (0.01, 0.05), "bandpass": 0.7, "quantise": 0.3, "bits": (8, 12)}


def class_counts(clips: DataFrame, *by: str) -> DataFrame:
    n, b = F.count("*"), F.count_if(F.col("file_type") == "bonafide")
    pct = lambda x: F.round(F.lit(100.0) * x / F.nullif(n, F.lit(0)), 6)
    return clips.groupBy(*by).agg(n.alias("total"), b.alias("n_bonafide"), (n - b).alias("n_spoof"), pct(b).alias("bonafide_pct"), pct(n - b).alias("spoof_pct"))


def balanced_factors(clips: DataFrame, ratio: float, times: int) -> DataFrame:
    return factors.balanced(class_counts(clips).select("n_bonafide", "n_spoof"), ratio, times)


def ranked(df: DataFrame, key: str, name: str = "rank", buckets: int = 3) -> DataFrame:
    """df with the row's place, from 0, in the order of a hexadecimal key such as a hash.

    Rows are numbered within buckets of equal first digits, and offsets come from the
    buckets' counts, so no task sorts the whole table.
    """
    bucketed = df.withColumn("_bucket", F.substring(key, 1, buckets))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1 + F.col("_offset")
    return bucketed.join(F.broadcast(offsets.select("_bucket", "_offset")), "_bucket").withColumn(name, place.cast("long")).drop("_bucket", "_offset")


def cut_by_rank(rank: Column, n: Column) -> Column:
    """First int(.8 n) train, next int(.1 n) val, the rest test."""
    a, b = (n * F.lit(0.8)).cast("int"), (n * F.lit(0.1)).cast("int")
    return F.when(rank < a, "train").when(rank < a + b, "val").otherwise("test")


def split_speakers(clips: DataFrame, seed: int = 42) -> DataFrame:
    """(speaker_id, split): disjoint by construction."""
    speakers = clips.select("speaker_id").distinct().withColumn("key", shuffle_key("speaker_id", seed=seed))
    n = speakers.agg(F.count("*").alias("n"))
    return ranked(speakers, "key").join(F.broadcast(n)).select("speaker_id", cut_by_rank(F.col("rank"), F.col("n")).alias("split"))


def split_files(clips: DataFrame, seed: int = 42) -> DataFrame:
    """Each speaker's own files cut by rank."""
    placed = numbered(clips.select("clip_id", "speaker_id", shuffle_key("clip_id", seed=seed).alias("key")), ["key"], ("speaker_id",), "rank", total="n")
    return placed.select("clip_id", "speaker_id", cut_by_rank(F.col("rank"), F.col("n")).alias("split"))


def file_names(clips: DataFrame) -> DataFrame:
    """clips with `filename`: numbered from 0 within speaker and technique, in order of the source."""
    placed = numbered(clips, ["clip_id"], ("speaker_id", "file_type", "technique"), "_ix")
    ix = F.lpad(F.col("_ix").cast("string"), 4, "0")
    name = F.when(F.col("file_type") == "bonafide", F.concat_ws("_", F.lit("bonafide"), "speaker_id", ix)).otherwise(F.concat_ws("_", F.lit("spoof"), "technique", "speaker_id", ix))
    return placed.withColumn("filename", F.concat(name, F.lit(".wav"))).drop("_ix")


def with_factor(clips: DataFrame, by_class: DataFrame, only: Column | None = None) -> DataFrame:
    """clips with `factor`. by_class: (file_type, factor), and strategy where clips have one: a row a class and strategy, which is small."""
    on = [c for c in ("strategy", "file_type") if c in by_class.columns]
    out = clips.join(F.broadcast(by_class.select(*on, "factor")), on)
    return out if only is None else out.withColumn("factor", F.when(only, F.col("factor")).otherwise(1))


def fan_out(clips: DataFrame, by_class: DataFrame, seed: int = 42, only: Column | None = None, mixes: Mixes | None = None) -> DataFrame:
    """One clean row and factor - 1 augmented rows a clip, with the augmentation's type. Ids fan out, waveforms are joined later.

    Clips for which `only` doesn't hold keep their clean row alone: they are never fanned out. With a
    table of strategies, clips have a `strategy`, and factors may differ by it.
    """
    return typed(with_factor(clips, by_class, only), seed, mixes)


def typed(clips: DataFrame, seed: int = 42, mixes: Mixes | None = None) -> DataFrame:
    """clips with `factor` -> factor rows a clip, with `copy` and `aug`."""
    mixes = mixes or Mixes()
    out = mixes.attach(clips).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("factor") - 1)))
    u = draw("type", "clip_id", "copy", seed=seed)
    return out.withColumn("aug", F.when(F.col("copy") == 0, "-").otherwise(mixes.choose(u, "types"))).drop("_mix")


def parameters(rows: DataFrame, seed: int = 42, mixes: Mixes | None = None) -> DataFrame:
    """The choices of an augmented row's own type, null for others: room, noise and SNR; rate, loss, band and bits; operations."""
    mixes = mixes or Mixes()
    d = lambda p: draw(p, "clip_id", "copy", seed=seed)
    own = lambda kind, c: F.when(F.col("aug") == kind, c)
    bits = F.when(d("q") < CODEC["quantise"], F.when(d("bits") < 0.5, CODEC["bits"][0]).otherwise(CODEC["bits"][1])).otherwise(0)
    low, high = CODEC["loss_range"]
    loss = F.when(d("l") < CODEC["loss"], F.lit(low) + d("loss") * F.lit(round(high - low, 9))).otherwise(F.lit(0.0))
    ops = F.filter(F.array(*[F.when(d(o) < p, F.lit(o)) for o, p in STAGES]), lambda o: o.isNotNull())
    rate = F.when(d("rate") < 0.5, CODEC["rates"][0]).otherwise(CODEC["rates"][1])
    return mixes.attach(rows).withColumns({
        "room": own("rir", mixes.choose(d("room"), "rooms")), "noise": own("rir", mixes.choose(d("noise"), "noises")), "snr_db": own("rir", mixes.snr(d("snr"), d("snr_in"))),
        "rate": own("codec", rate), "loss": own("codec", loss), "bandpass": own("codec", d("band") < CODEC["bandpass"]), "bits": own("codec", bits),
        "operations": own("rawboost", ops),
    }).drop("_mix")


def system_ids(rows: DataFrame) -> DataFrame:
    """rows with `system_id`; an unknown type is an error, not a clean row."""
    aug = F.col("aug")
    label = (
        F.when(aug == "-", "-").when(aug == "rir", labels.rir_label(F.col("room"), F.col("noise"), F.col("snr_db")))
        .when(aug == "codec", labels.codec_label(F.col("rate"), F.col("loss"), F.col("bandpass"), F.col("bits"))).when(aug == "rawboost", labels.rawboost_label(F.col("operations")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown augmentation "), aug)))
    )
    return rows.withColumn("system_id", label)


def first_ids(clips: DataFrame) -> DataFrame:
    """clips with split and factor -> with `first`: how many rows of the split (and strategy) come before the clip's own.

    Bonafide comes before spoof, then speaker and clip. All clips of a class of a split have one factor, so it is
    clips that are numbered, before they fan out, and a row's number is first + copy + 1.
    """
    group = tuple(c for c in ("strategy", "split") if c in clips.columns)
    placed = numbered(clips, ["speaker_id", "clip_id"], (*group, "file_type", "factor"), "_rank", total="_n")
    classes = placed.groupBy(*group, "file_type", "factor").agg((F.first("_n") * F.col("factor")).alias("_rows"))  # a few rows a strategy
    before = Window.partitionBy(*group).orderBy("file_type", "factor").rowsBetween(Window.unboundedPreceding, -1)
    offsets = classes.select(*group, "file_type", "factor", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    met = placed.join(F.broadcast(offsets), [*group, "file_type", "factor"])
    return met.withColumn("first", F.col("_offset") + F.col("_rank") * F.col("factor")).drop("_offset", "_rank", "_n")


def protocol(clips: DataFrame, seed: int = 42, mixes: Mixes | None = None) -> DataFrame:
    """clips: (clip_id, speaker_id, file_type, split, factor, and strategy with a table of them) -> (split, speaker_id, audio_id, system_id, key, and strategy)."""
    names = [c for c in ("strategy",) if c in clips.columns]
    rows = typed(first_ids(clips.select("clip_id", "speaker_id", "file_type", "split", "factor", *names)), seed, mixes)
    prefix = labels.lookup(labels.SPLIT_PREFIX, F.col("split"), "LA_U")
    audio = labels.audio_id(prefix, F.col("first") + F.col("copy") + 1)
    return system_ids(parameters(rows, seed, mixes)).select("split", "speaker_id", audio.alias("audio_id"), "system_id", F.col("file_type").alias("key"), *names)


def protocol_statistics(p: DataFrame) -> DataFrame:
    n, clean = F.count("*"), F.count_if(F.col("system_id") == "-")
    return p.groupBy("split").agg(
        n.alias("total"), F.count_if(F.col("key") == "bonafide").alias("n_bonafide"), F.count_if(F.col("key") == "spoof").alias("n_spoof"), clean.alias("n_clean"), (n - clean).alias("n_augmented"),
        F.round(F.lit(100.0) * clean / n, 6).alias("clean_pct"),
    )


def planned_statistics(clips: DataFrame) -> DataFrame:
    """clips with split and factor -> protocol_statistics of what they fan out to, without fanning out."""
    n, clean, of = F.sum("factor"), F.count("*"), lambda k: F.coalesce(F.sum(F.when(F.col("file_type") == k, F.col("factor"))), F.lit(0))
    return clips.groupBy("split").agg(
        n.alias("total"), of("bonafide").alias("n_bonafide"), of("spoof").alias("n_spoof"), clean.alias("n_clean"), (n - clean).alias("n_augmented"), F.round(F.lit(100.0) * clean / n, 6).alias("clean_pct")
    )


def split_overlap(members: DataFrame) -> DataFrame:
    """members: (speaker_id, split) -> pairs of splits and the speakers that they share; one pass, no self-join of rows."""
    sets = members.groupBy("speaker_id").agg(F.array_sort(F.collect_set("split")).alias("s")).filter("size(s) > 1")
    pair = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a AS left_split, b AS right_split))))")
    return sets.select(F.explode(pair).alias("p")).groupBy("p.left_split", "p.right_split").agg(F.count("*").alias("shared"))


def multiplicity(members: DataFrame) -> DataFrame:
    """For each number and list of splits, the speakers that are in exactly those."""
    sets = members.groupBy("speaker_id").agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"), F.countDistinct("split").alias("n_splits"))
    n = F.count("*")
    return sets.groupBy("n_splits", "splits").agg(n.alias("speakers")).withColumn("pct", F.round(F.lit(100.0) * F.col("speakers") / F.sum("speakers").over(Window.partitionBy()), 6))


def speaker_counts(p: DataFrame) -> DataFrame:
    """Per speaker: rows of each key, and the first id, which stands for its place in the protocol."""
    return p.groupBy("speaker_id").agg(F.count("*").alias("total"), F.count_if(F.col("key") == "bonafide").alias("n_bonafide"), F.count_if(F.col("key") == "spoof").alias("n_spoof"), F.min("audio_id").alias("first_id"))


def top_speakers(p: DataFrame, n: int, require_both: bool) -> DataFrame:
    """Most rows first. With both classes asked for, ties keep protocol order; without, they are in reverse order of id."""
    c = speaker_counts(p)
    return (c.filter("n_bonafide > 0 and n_spoof > 0").orderBy(F.desc("total"), "first_id") if require_both else c.orderBy(F.desc("total"), F.desc("speaker_id"))).limit(n)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")

"""Signal functions on toy waveforms, all as expressions, held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbral.functions import signals
from timbral.functions.draws import draw
from timbral.plans.registry import query, u
from timbral.sources.adapters import WAVES_SQL, waves


def summed(df: DataFrame, x: Column, *more: str | Column) -> DataFrame:
    """Per wave: rows of the result are its energy, peak and a checksum that heeds order."""
    y = df.select("wave_id", *more, x.alias("y"))
    order = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return y.select("wave_id", *[c if isinstance(c, str) else c for c in more], F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"), F.round(signals.peak(F.col("y")), 6).alias("peak"), F.round(order, 5).alias("order_sum"))


SUMMED = "round(list_sum(list_transform(y, lambda v: v * v)), 6) as energy, round(list_max(list_transform(y, lambda v: abs(v))), 6) as peak, round(list_sum(list_transform(y, lambda v, i: v * i)), 5) as order_sum"


def _one(y: str, ctes: str = "") -> str:
    return f"with {WAVES_SQL}{ctes}, out as (select *, {y} as y from {'paired' if 'paired' in ctes else 'waves'}) select wave_id, {SUMMED} from out"


RMS = "sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"


@query(f"with {WAVES_SQL} select wave_id, round({RMS.format(x='x')}, 6) as rms from waves")
def wave_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("wave_id", F.round(signals.rms(F.col("x")), 6).alias("rms"))


@query(_one("list_transform(x, lambda v: greatest(-0.1::double, least(0.1::double, v)))"))
def wave_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(waves(spark, sf_dir), signals.clip(F.col("x"), 0.1))


@query(_one(f"list_transform(x, lambda v: v * (0.1::double / {RMS.format(x='x')}))"))
def wave_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(waves(spark, sf_dir), signals.normalise(F.col("x"), -20.0))


@query(_one("list_transform(x, lambda v: greatest(-1.0::double, least(1.0::double, round_even(v * 128.0::double, 0) / 128.0::double)))"))
def wave_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(waves(spark, sf_dir), signals.quantise(F.col("x"), 8))


GAIN = f"(0.7::double + {u('gain', 'wave_id')} * 0.6::double)"


@query(_one(f"list_transform(x, lambda v: v * {GAIN})"))
def wave_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(waves(spark, sf_dir), signals.scale(F.col("x"), F.lit(0.7) + draw("gain", "wave_id") * 0.6))


@query(f"with {WAVES_SQL}, t as (select wave_id, list_transform(x, lambda v: tanh(v * (0.1::double + {u('alpha', 'wave_id')} * 0.4::double))) as t from waves), out as (select wave_id, list_transform(t, lambda v: v * 0.99::double / list_max(list_transform(t, lambda q: abs(q)))) as y from t) select wave_id, {SUMMED} from out")
def wave_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(waves(spark, sf_dir), signals.saturate(F.col("x"), F.lit(0.1) + draw("alpha", "wave_id") * 0.4))


LOST = f"list_transform(range(0, 8), lambda p: {u('packet', 'wave_id', 'p')} < 0.3)"


@query(_one(f"list_transform(x, lambda v, i: case when ({LOST})[(i - 1) // 8 + 1] then 0.0::double else v end)"))
def wave_packet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: draw("packet", "wave_id", p) < 0.3)
    return summed(waves(spark, sf_dir), signals.drop_packets(F.col("x"), lost, 8))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wave with the next one of its label, the last with the first, as noise."""
    w = Window.partitionBy("label").orderBy("wave_id")
    whole = Window.partitionBy("label")
    d = waves(spark, sf_dir)
    return d.withColumn("noise", F.coalesce(F.lead("x").over(w), F.min_by("x", "wave_id").over(whole)))


PAIRED = ", paired as (select *, coalesce(lead(x) over (partition by label order by wave_id), first(x) over (partition by label order by wave_id)) as noise from waves)"


@query(f"with {WAVES_SQL}{PAIRED} select wave_id, round(10 * log10((list_sum(list_transform(x, lambda v: v * v)) / 64) / (list_sum(list_transform(noise, lambda v: v * v)) / 64)), 6) + 0.0 as snr_db from paired")
def wave_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("wave_id", (F.round(signals.snr_db(F.col("x"), F.col("noise")), 6) + F.lit(0.0)).alias("snr_db"))


MIXED = f"list_transform(x, lambda v, i: v + laid[i] * ({RMS.format(x='x')} / ({RMS.format(x='laid')} * pow(10.0::double, 10.0::double / 20.0::double))))"


@query(f"""with {WAVES_SQL}{PAIRED}, laid as (select *, list_transform(x, lambda v, i: noise[(i - 1 + wave_id % 64) % 64 + 1]) as laid from paired), mixed as (select wave_id, {MIXED} as m from laid),
 out as (select wave_id, case when list_max(list_transform(m, lambda q: abs(q))) > 1 then list_transform(m, lambda v: v * 0.99::double / list_max(list_transform(m, lambda q: abs(q)))) else m end as y from mixed) select wave_id, {SUMMED} from out""")
def wave_mix_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(paired(spark, sf_dir), signals.mix(F.col("x"), F.col("noise"), F.lit(10.0), F.col("wave_id") % 64))


@query(f"""with {WAVES_SQL}{PAIRED}, c as (select wave_id, list_transform(x, lambda v, i: list_sum(list_transform(range(0, 8), lambda k: noise[k + 1] * case when i + 3 - k between 1 and 64 then x[i + 3 - k] else 0.0::double end))) as c from paired),
 out as (select wave_id, list_transform(c, lambda v: v * 0.99::double / list_max(list_transform(c, lambda q: abs(q)))) as y from c) select wave_id, {SUMMED} from out""")
def wave_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(paired(spark, sf_dir), signals.convolve_same(F.col("x"), F.slice("noise", 1, 8)))


@query(f"""with {WAVES_SQL}{PAIRED}, out as (select wave_id, list_transform(x, lambda v, i: list_sum(list_transform(range(0, 6), lambda k: noise[k + 1] / list_sum(list_transform(noise[1:6], lambda q: abs(q))) * case when i - k >= 1 then x[i - k] else 0.0::double end))) as y from paired) select wave_id, {SUMMED} from out""")
def wave_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(paired(spark, sf_dir), signals.fir(F.col("x"), F.slice("noise", 1, 6)))


@query(f"""with {WAVES_SQL}, flat as (select wave_id, unnest(x) as v, generate_subscripts(x, 1) - 1 as i from waves), e as (select wave_id, i, sum(v * v) over (partition by wave_id order by i desc rows unbounded preceding) as e from flat)
 select wave_id, i, round(10 * log10(e + 1e-10) - max(10 * log10(e + 1e-10)) over (partition by wave_id), 6) + 0.0 as db from e""")
def wave_energy_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = waves(spark, sf_dir).select("wave_id", F.posexplode("x").alias("i", "v"))
    e = F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("wave_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    db = flat.withColumn("db", F.lit(10.0) * F.log10(e + F.lit(1e-10)))
    return db.select("wave_id", F.col("i").cast("long").alias("i"), (F.round(F.col("db") - F.max("db").over(Window.partitionBy("wave_id")), 6) + F.lit(0.0)).alias("db"))


@query(_one("list_concat(x[1:40 + wave_id % 24], list_transform(range(0, greatest(50 - (40 + wave_id % 24), 0)), lambda k: 0.0::double))[1:50]"))
def wave_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut or padded to a batch's even length, here 50."""
    own = F.slice("x", F.lit(1), (F.lit(40) + F.col("wave_id") % 24).cast("int"))
    return summed(waves(spark, sf_dir).withColumn("own", own), signals.pad_to(F.col("own"), F.lit(50)))


@query(f"with {WAVES_SQL} select wave_id, round(len(list_filter(x, lambda v: v <> 0)) / 64.0::double, 6) as nonzero, round(list_stddev_pop(x), 6) as std, len(list_filter(x, lambda v: v <> 0)) < 6.4 or list_stddev_pop(x) < 0.001 as silent from waves")
def wave_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    nonzero = F.size(F.filter(x, lambda v: v != 0)) / F.size(x).cast("double")
    mean = signals.total(x) / F.size(x)
    std = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x) - mean * mean)
    return waves(spark, sf_dir).select("wave_id", F.round(nonzero, 6).alias("nonzero"), F.round(std, 6).alias("std"), ((nonzero < 0.1) | (std < 0.001)).alias("silent"))

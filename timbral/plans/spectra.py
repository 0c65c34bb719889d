"""Filters, resampling and spectra through the numpy kernels, held against SQL that runs the recursions and sums sample by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import filters, kernels, spectra
from timbral.plans.registry import query
from timbral.plans.signals import SUMMED, summed
from timbral.sources.adapters import WAVES_SQL, waves

RATE = 16000

#: Rates that waves are said to have, in turn.
RATES = (8000, 16000, 44100)

#: A frame, its hop, mel bands and cepstra: for waves of 64 samples.
SIZE, HOP, BANDS, CEPSTRA = 32, 16, 6, 4


def _sections_sql(name: str, source: str, n: int) -> str:
    """Rows (wave_id, i, y) of a recursion over source's v, n samples long, all sections in turn at each sample."""
    sections = list(enumerate(filters.butterworth(RATE, *kernels.BAND), 1))
    one = sections[0][1][0]
    start = ", ".join(f"{f'-{one}::double * v[1]' if k == 1 else '0.0::double'} as s{k}, {f'-{one}::double * v[1]' if k == 1 else '0.0::double'} as r{k}" for k, _ in sections)
    inner = f"(select *, v[i + 1] as y0 from {name} where i < {n})"
    for k, (g, _, _) in sections:
        inner = f"(select *, {g}::double * y{k - 1} + s{k} as y{k} from {inner})"
    step = ", ".join(f"-({a1}::double) * y{k} + r{k}, -({g}::double) * y{k - 1} - ({a2}::double) * y{k}" for k, (g, a1, a2) in sections)
    return f"{name} as (select wave_id, v, 0 as i, 0.0::double as y, {start} from {source} union all select wave_id, v, i + 1, y{len(sections)}, {step} from {inner})"


PAD = 3 * (2 * kernels.ORDER + 1)


@query(f"""with recursive {WAVES_SQL}, ext as (select wave_id, list_concat(list_transform(range({PAD}, 0, -1), lambda k: 2 * x[1] - x[k + 1]), x, list_transform(range(1, {PAD + 1}), lambda k: 2 * x[64] - x[64 - k])) as v from waves),
 {_sections_sql('forth', 'ext', 64 + 2 * PAD)}, turned as (select wave_id, list(y order by i desc) as v from forth where i > 0 group by wave_id),
 {_sections_sql('back', 'turned', 64 + 2 * PAD)}, out as (select wave_id, list(y order by i desc)[{PAD + 1}:{PAD + 64}] as y from back where i > 0 group by wave_id) select wave_id, {SUMMED} from out""")
def wave_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(kernels.mapped(waves(spark, sf_dir), lambda r: kernels.bandpass(r.x, RATE), "wave_id"), F.col("y"))


def _resampled_sql(name: str, source: str, up: str, down: str) -> str:
    """(wave_id, rate, i, y) of source's x, as sums over taps around each output."""
    cut = f"least(1.0::double, {up}::double / {down})"
    n = filters.CROSSINGS
    tap = f"case when abs(u) >= {n} then 0.0::double else (case when u = 0 then 1.0::double else sin(pi() * u) / (pi() * u) end) * pow(cos(pi() * u / {2 * n}), 2) end"
    return f"""{name}_at as (select wave_id, rate, x, {up} as up, {down} as down, {cut} as cut, unnest(range(0, (len(x) * {up} + {down} - 1) // {down})) as i from {source}),
 {name}_near as (select *, (i * down) // up as base, ceil({n} / cut)::bigint as reach from {name}_at), {name}_taps as (select *, unnest(range(1 - reach, reach + 1)) as j from {name}_near),
 {name}_u as (select wave_id, rate, i, cut * (((i * down) % up)::double / up - j) as u, case when base + j between 0 and len(x) - 1 then x[base + j + 1] else 0.0::double end as v from {name}_taps),
 {name} as (select wave_id, rate, list(y order by i) as x from (select wave_id, rate, i, sum(v * {tap}) / sum({tap}) as y from {name}_u group by wave_id, rate, i) group by wave_id, rate)"""


@query(f"""with {WAVES_SQL}, rated as (select *, [{', '.join(map(str, RATES))}][wave_id % 3 + 1]::bigint as rate from waves), others as (select * from rated where rate <> {RATE}),
 {_resampled_sql('made', 'others', f'({RATE} // gcd(rate, {RATE}))', f'(rate // gcd(rate, {RATE}))')}, out as (select wave_id, rate, x as y from made union all select wave_id, rate, x from rated where rate = {RATE})
 select wave_id, rate, len(y) as samples, {SUMMED} from out""")
def wave_ensure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of several rates brought to one."""
    own = F.element_at(F.array(*[F.lit(r).cast("long") for r in RATES]), (F.col("wave_id") % 3 + 1).cast("int"))
    even = kernels.mapped(waves(spark, sf_dir).withColumn("rate", own), lambda r: filters.polyphase(r.x, int(r.rate), RATE), "wave_id", "rate")
    return summed(even, F.col("y"), "rate", F.size("y").cast("long").alias("samples"))


@query(f"""with {WAVES_SQL}, rated as (select wave_id, x, {RATE} as rate from waves), {_resampled_sql('low', 'rated', '1', '2')}, {_resampled_sql('high', 'low', '2', '1')}, out as (select wave_id, x as y from high) select wave_id, {SUMMED} from out""")
def wave_telephone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down to half the rate and up again."""
    return summed(kernels.mapped(waves(spark, sf_dir), lambda r: filters.telephone(r.x, RATE, RATE // 2), "wave_id"), F.col("y"))


STFT = f"""terms as (select wave_id, x, f.frame, b.bin, n.n from waves, (select unnest(range(0, {64 // HOP + 1})) as frame) f, (select unnest(range(0, {SIZE // 2 + 1})) as bin) b, (select unnest(range(0, {SIZE})) as n) n),
 placed as (select wave_id, frame, bin, n, case when frame * {HOP} + n - {SIZE // 2} between 0 and 63 then x[frame * {HOP} + n - {SIZE // 2} + 1] else 0.0::double end * (0.5::double - 0.5::double * cos(2 * pi() * n / {SIZE})) as v from terms),
 stft as (select wave_id, frame, bin, sqrt(pow(sum(v * cos(2 * pi() * bin * n / {SIZE})), 2) + pow(sum(v * sin(2 * pi() * bin * n / {SIZE})), 2)) as a from placed group by wave_id, frame, bin)"""


@query(f"""with {WAVES_SQL}, {STFT}, loud as (select *, max(a) over (partition by wave_id) as most from stft)
 select wave_id, frame, bin, round(greatest(20 * log10(greatest(a, 1e-5) / greatest(most, 1e-5)), -80.0::double), 6) + 0.0 as db from loud""")
def wave_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra.spectrogram(waves(spark, sf_dir), "wave_id", RATE, SIZE, HOP)
    return s.withColumn("db", F.round("db", 6) + F.lit(0.0))


TOP = f"(15.0::double + ln({RATE / 2 / 1000}::double) / (ln(6.4::double) / 27))"


def _unmel(m: str) -> str:
    return f"case when {m} < 15 then {m} * 200.0::double / 3 else 1000.0::double * exp(ln(6.4::double) / 27 * ({m} - 15)) end"


@query(f"""with {WAVES_SQL}, {STFT}, bands as (select b, {_unmel(f'({TOP} * b / {BANDS + 1})')} as lo, {_unmel(f'({TOP} * (b + 1) / {BANDS + 1})')} as mid, {_unmel(f'({TOP} * (b + 2) / {BANDS + 1})')} as hi from (select unnest(range(0, {BANDS})) as b)),
 mels as (select wave_id, frame, b, sum(a * a * greatest(0.0::double, least((bin * {RATE / SIZE}::double - lo) / (mid - lo), (hi - bin * {RATE / SIZE}::double) / (hi - mid))) * 2 / (hi - lo)) as p from stft, bands group by wave_id, frame, b),
 dbs as (select wave_id, frame, b, 10 * log10(greatest(1e-10, p)) as db from mels), cut as (select wave_id, frame, b, greatest(db, max(db) over (partition by wave_id) - 80) as db from dbs),
 means as (select wave_id, k, sum(db * sqrt(case when k = 0 then 1.0::double else 2.0::double end / {BANDS}) * cos(pi() * k * (2 * b + 1) / {2 * BANDS})) / {64 // HOP + 1} as c from cut, (select unnest(range(0, {CEPSTRA})) as k) group by wave_id, k),
 ids as (select wave_id, least(1.0::double, sqrt(sum(c * c)) / 100) as identity from means group by wave_id),
 flat as (select wave_id, avg(f) * 10 as flatness from (select wave_id, frame, exp(avg(ln(greatest(1e-10, a * a)))) / avg(greatest(1e-10, a * a)) as f from stft group by wave_id, frame) group by wave_id)
 select wave_id, round(flatness, 6) as flatness, round(identity, 6) as identity from ids join flat using (wave_id)""")
def wave_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality proxies of a waveform: spectral flatness and the norm of the mean cepstrum."""
    r: dict[str, Column] = {c: F.round(c, 6) for c in ("flatness", "identity")}
    return spectra.proxies(waves(spark, sf_dir), "wave_id", RATE, SIZE, HOP, BANDS, CEPSTRA).withColumns(r)

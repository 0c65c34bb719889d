"""Queries that profile corpora and collections of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbral.functions import labels, signals
from timbral.operators import checks, corpus, profile, speech
from timbral.operators.numbering import numbered
from timbral.operators.quantiles import quantiles
from timbral.plans.augmentation import FILE_SPLIT, NAMES
from timbral.plans.registry import query
from timbral.sources import audio
from timbral.sources.adapters import CLIPS_SQL, WAVES_SQL, clips, table, waves

COUNTRY_SQL = "case substr(speaker_id, 1, 2) when 'ar' then 'Argentina' when 'cl' then 'Chile' when 'co' then 'Colombia' when 'pe' then 'Peru' when 've' then 'Venezuela' else 'unknown' end"
GENDER_SQL = "case substr(speaker_id, 3, 1) when 'f' then 'Female' when 'm' then 'Male' else 'Unknown' end"
PEOPLE_SQL = f"{CLIPS_SQL}, people as (select *, {COUNTRY_SQL} as country, {GENDER_SQL} as gender from clips)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).withColumn("country", labels.country(F.col("speaker_id"))).withColumn("gender", labels.gender(F.col("speaker_id")))


@query(f"with {PEOPLE_SQL} select country, count(*) filter (gender = 'Female') as \"Female\", count(*) filter (gender = 'Male') as \"Male\" from people group by country")
def crosstab_country_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(people(spark, sf_dir), "country", "gender", ["Female", "Male"])


@query("select lang, count(*) filter (l.toxic = 0) as clean, count(*) filter (l.toxic = 1) as toxic, count(*) filter (l.toxic is null) as unlabelled from documents d left join labels l using (doc_id) group by lang")
def crosstab_lang_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return profile.crosstab(d.withColumn("kind", kind), "lang", "kind", ["clean", "toxic", "unlabelled"])


@query(f"with {PEOPLE_SQL} select country, count(distinct case when file_type = 'bonafide' then speaker_id end) as bonafide, count(distinct case when file_type = 'spoof' then speaker_id end) as spoof from people group by country")
def nunique_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(people(spark, sf_dir), "country", "file_type", ["bonafide", "spoof"], "speaker_id")


@query(f"with {PEOPLE_SQL}, n as (select country, speaker_id, count(*) as n from people group by all) select country, round(avg(n), 6) as mean_clips from n group by country")
def mean_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).groupBy("country", "speaker_id").agg(F.count("*").alias("n")).groupBy("country").agg(F.round(F.avg("n"), 6).alias("mean_clips"))


@query("select event_type, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as pct from events group by event_type")
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


DESCRIBE = "count({v}) as n, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, min({v}) as min, round(quantile_cont({v}, 0.25), 6) as q25, round(quantile_cont({v}, 0.5), 6) as q50, round(quantile_cont({v}, 0.75), 6) as q75, max({v}) as max"


@query(f"with {PEOPLE_SQL} select country, file_type, {DESCRIBE.format(v='duration')} from people group by all")
def describe_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(people(spark, sf_dir), ["country", "file_type"], "duration")


@query(f"with {CLIPS_SQL}, per as (select file_type, speaker_id, round(sum(duration), 6) as total from clips group by all) select file_type, {DESCRIBE.format(v='total')} from per group by all")
def describe_speaker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = clips(spark, sf_dir).groupBy("file_type", "speaker_id").agg(F.round(F.sum("duration"), 6).alias("total"))
    return profile.describe(per, ["file_type"], "total")


@query(f"with {PEOPLE_SQL} select country, gender, file_type, round(sum(duration) / 60, 6) as minutes from people group by all")
def minutes_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).groupBy("country", "gender", "file_type").agg(F.round(F.sum("duration") / 60, 6).alias("minutes"))


@query(f"with {CLIPS_SQL} select speaker_id, round(quantile_cont(duration, 0.5), 6) as median, rank() over (order by round(quantile_cont(duration, 0.5), 6) desc, speaker_id) as place from clips group by speaker_id")
def median_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quantiles(clips(spark, sf_dir), ["speaker_id"], "duration", [0.5], ["median"]).withColumn("median", F.round("median", 6))
    return numbered(m, [F.desc("median"), "speaker_id"]).select("speaker_id", "median", (F.col("place") + 1).alias("place"))


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by md5(concat_ws('|', '42', event_id::varchar)), event_id) as r from events) where r <= 200")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stratified(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 200)


@query("select p_type as category, p_brand as subcategory, round(min(p_retailprice), 4) as min_price, round(max(p_retailprice), 4) as max_price, round(avg(p_retailprice), 4) as mean_price, count(*) as n from part group by all")
def minmax_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda f, n: F.round(f("p_retailprice"), 4).alias(n)
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory")).agg(r(F.min, "min_price"), r(F.max, "max_price"), r(F.avg, "mean_price"), F.count("*").alias("n"))


# names as corpora have them: an attack, a source and a target speaker
SYNTHETIC_SQL = f"""{CLIPS_SQL}, built as (select clip_id, case when file_type = 'bonafide' then speaker_id || '_' || clip_id || '.wav'
 when clip_id % 3 = 0 then 'TTS-' || speaker_id || '_' || clip_id || '.wav' else ['CycleGAN','StarGAN','Diff'][clip_id % 3 + 1] || '-' || speaker_id || '-' || 'clm_' || lpad((clip_id % 50)::varchar, 5, '0') || '_x.wav' end as filename from clips)"""


def built_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    n = F.col("clip_id").cast("string")
    attack = F.element_at(F.array(*map(F.lit, ("CycleGAN", "StarGAN", "Diff"))), (F.col("clip_id") % 3 + 1).cast("int"))
    name = (
        F.when(F.col("file_type") == "bonafide", F.concat("speaker_id", F.lit("_"), n, F.lit(".wav"))).when(F.col("clip_id") % 3 == 0, F.concat(F.lit("TTS-"), "speaker_id", F.lit("_"), n, F.lit(".wav")))
        .otherwise(F.concat(attack, F.lit("-"), "speaker_id", F.lit("-clm_"), F.lpad((F.col("clip_id") % 50).cast("string"), 5, "0"), F.lit("_x.wav")))
    )
    return c.select("clip_id", name.alias("filename"))


PARSED_SQL = f"""{SYNTHETIC_SQL}, parsed as (select clip_id, filename, regexp_extract(filename, '^(CycleGAN|StarGAN|Diff|TTS)-', 1) as attack,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(filename, '\\.wav$', ''), '^(CycleGAN|StarGAN|Diff|TTS)-', ''), '-'), lambda s: array_to_string(string_split(s, '_')[1:2], '_')), lambda s: regexp_matches(s, '^(ar|cl|co|pe|ve)[^_]+_')) as ids from built)"""


@query(f"with {PARSED_SQL} select clip_id, attack <> '' as is_synthetic, nullif(attack, '') as attack_type, array_to_string(ids, '+') as voice_ids, len(ids)::int as num_speakers from parsed")
def parse_corpus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = built_names(spark, sf_dir).select("clip_id", labels.parse_filename(F.col("filename")).alias("p"))
    return p.select("clip_id", "p.is_synthetic", "p.attack_type", F.array_join("p.voice_ids", "+").alias("voice_ids"), "p.num_speakers")


@query(f"with {PARSED_SQL} select voice_id, count(*) as files from (select unnest(ids) as voice_id from parsed) group by 1")
def voice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = built_names(spark, sf_dir).select(F.explode(labels.parse_filename(F.col("filename"))["voice_ids"]).alias("voice_id"))
    return p.groupBy("voice_id").agg(F.count("*").alias("files"))


@query(f"""with {SYNTHETIC_SQL}, parts as (select clip_id, list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(filename, '\\.wav$', ''), '(CycleGAN|StarGAN|Diff|TTS)-', '|', 'g'), '|'), lambda s: array_to_string(string_split(s, '_')[1:2], '_')),
 lambda s: regexp_matches(s, '^(ar|cl|co|pe|ve)[^_]+_'))) as ids from built) select clip_id, array_to_string(ids, '+') as ids from parts""")
def list_line_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_names(spark, sf_dir).select("clip_id", F.array_join(labels.list_line_ids(F.col("filename")), "+").alias("ids"))


@query("select page_id, string_split(url, '/')[3] as host, string_split(url, '/')[4] as section, string_split(url, '/')[-1] as leaf, len(string_split(url, '/'))::int as depth from pages")
def path_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    return table(spark, sf_dir, "pages").select("page_id", F.get(parts, F.lit(2)).alias("host"), F.get(parts, F.lit(3)).alias("section"), F.element_at(parts, -1).alias("leaf"), F.size(parts).alias("depth"))


@query(f"with {PEOPLE_SQL}, s as (select distinct country, gender, speaker_id from people) select country || ' ' || gender as grp, count(*) as n, string_agg(speaker_id, ',' order by speaker_id) as ids from s group by 1")
def speakers_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = people(spark, sf_dir).select("country", "gender", "speaker_id").distinct()
    return s.groupBy(F.concat_ws(" ", "country", "gender").alias("grp")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("speaker_id")), ",").alias("ids"))


@query(f"with {PEOPLE_SQL}, s as (select distinct country, speaker_id from people), r as (select *, row_number() over (partition by country order by speaker_id) as r, count(*) over (partition by country) as n from s) select country, speaker_id, n - 5 as more from r where r <= 5")
def first_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("country")
    s = people(spark, sf_dir).select("country", "speaker_id").distinct()
    return s.withColumn("r", F.row_number().over(w.orderBy("speaker_id"))).withColumn("more", F.count("*").over(w) - 5).filter("r <= 5").select("country", "speaker_id", "more")


@query("select event_type, max_by(event_id, ts) as latest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as at from events group by event_type")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", "ts").alias("latest"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"))


WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\f]+'))"


@query(f"select doc_id, n_words, n_words > 0 and (ratio > 3.5::double or ratio < 0.15::double) as failed from (select doc_id, {WORDS}::bigint as n_words, n_chars / 16.0::double / (0.4::double * greatest({WORDS}, 1)) as ratio from documents)")
def duration_ratio_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed if over 3.5 or under 0.15 times the expected seconds, 0.4 a word; sixteen characters stand in for a second. No words: not failed."""
    n = F.size(F.filter(F.split("text", "[ \\t\\n\\r\\x0B\\f]+"), lambda w: w != "")).cast("long")
    ratio = F.col("n_chars") / F.lit(16.0) / (F.lit(0.4) * F.greatest(n, F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), ((n > 0) & ((ratio > 3.5) | (ratio < 0.15))).alias("failed"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 4) as discount from lineitem group by rollup(l_returnflag, l_linestatus)")
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"))


@query("select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by o_custkey order by orders desc, o_custkey limit 10")
def top_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("orders"), "o_custkey").limit(10)


@query(f"with {CLIPS_SQL}, {NAMES}, {FILE_SPLIT} select fs.split, fs.speaker_id, n.filename, n.file_type from names n join file_splits fs using (clip_id) where fs.split = 'train' and n.file_type = 'bonafide'")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    return corpus.file_names(c).join(corpus.split_files(c).select("clip_id", "split"), "clip_id").filter("split = 'train' and file_type = 'bonafide'").select("split", "speaker_id", "filename", "file_type")


# --- vectors ------------------------------------------------------------------------------------

CENTROIDS_SQL = f"""{WAVES_SQL}, flat as (select label, unnest(x) as v, generate_subscripts(x, 1) as i from waves), means as (select label, i, avg(v) as v from flat group by all),
 norms as (select label, sqrt(sum(v * v)) as n from means group by label), unit as (select label, i, case when n > 0 then v / n else v end as v from means join norms using (label))"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.centroids(waves(spark, sf_dir), "label", "x")


@query(f"with {CENTROIDS_SQL} select label, i - 1 as i, round(v, 6) as v from unit")
def embedding_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select("label", F.posexplode("centroid").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(f"with {CENTROIDS_SQL} select a.label as a, b.label as b, round(sum(a.v * b.v), 6) as cosine from unit a join unit b on a.i = b.i and a.label < b.label group by all")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pairwise(bank(spark, sf_dir), "label", "centroid").withColumn("cosine", F.round("cosine", 6))


@query(f"with {CENTROIDS_SQL}, p as (select a.label as a, b.label as b, sum(a.v * b.v) as cosine from unit a join unit b on a.i = b.i and a.label < b.label group by all) select count(*) as pairs, round(avg(cosine), 6) as mean_cosine, avg(cosine) > 0.8 as poor from p")
def off_diag_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all pairs without the diagonal: (|sum of v|^2 - sum of |v|^2) / (n (n - 1)), so no pair is made."""
    return profile.off_diagonal(bank(spark, sf_dir), "centroid").select("pairs", F.round("mean_cosine", 6).alias("mean_cosine"), (F.col("mean_cosine") > 0.8).alias("poor"))


@query(f"with {CENTROIDS_SQL}, c as (select label, list(v order by i) as v from unit group by label) select doc_id, round(coalesce(list_sum(list_transform(c.v, lambda x: x * x)), 0), 6) as norm2, c.label is null as is_default from documents d left join c on c.label = d.doc_id % 14")
def embedding_attach_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers without a vector get zeros. The bank grows with the speakers: whether it is broadcast is told by its size as the plan finds it."""
    b = bank(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 14).alias("label"))
    j = d.join(b.withColumn("known", F.lit(True)), "label", "left").withColumn("v", F.coalesce("centroid", F.array_repeat(F.lit(0.0), 64)))
    return j.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.col("known").isNull().alias("is_default"))


@query(f"""with {WAVES_SQL}, n as (select wave_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) as norm from waves), f as (select unnest(x) as v from waves)
 select (select count(*) from waves) as n, (select count(*) from waves where len(x) <> 64) as bad_size, (select round(min(norm), 6) from n) as min_norm, (select round(max(norm), 6) from n) as max_norm,
 (select round(avg(v), 6) from f) as mean, (select round(stddev_pop(v), 6) from f) as std, (select count(*) from f where isnan(v)) as n_nan""")
def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves(spark, sf_dir).select("x", signals.norm(F.col("x")).alias("norm"))
    sizes = w.agg(F.count("*").alias("n"), F.count_if(F.size("x") != 64).alias("bad_size"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"))
    values = w.select(F.explode("x").alias("v")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.count_if(F.isnan("v")).alias("n_nan"))
    return sizes.join(F.broadcast(values))


# --- checks, splits and evaluation --------------------------------------------------------------


@query("""with n as (select user_id % 50 as segment, event_type, count(*) as n from events group by all), d as (select segment, (((200 * n + whole) // (2 * whole)) * 0.01::decimal(3, 2)) as p from (select *, sum(n) over (partition by segment)::bigint as whole from n))
 select 'segment ' || segment as dist, round(sum(p), 6)::double as total, abs(sum(p) - 1) < 0.01 as valid from d group by 1""")
def share_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed mixes of events as a strategy would hold them, to two places: those whose rounded shares are off by a hundredth or more aren't valid."""
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("segment"), "event_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("segment").agg(F.sum("n").alias("whole"))
    p = n.join(whole, "segment").select(F.concat(F.lit("segment "), F.col("segment").cast("string")).alias("dist"), F.expr("((200 * n + whole) div (2 * whole)) * 0.01BD").alias("p"))
    return checks.shares(p).withColumn("total", F.col("total").cast("double"))


@query("""with r as (select doc_id, row_number() over (order by md5(concat_ws('|', '42', doc_id::varchar))) - 1 as rank, count(*) over () as n from documents), c as (select *, trunc(n * 0.1::double)::bigint as n_test from r)
 select doc_id, case when rank < n_test then 'test' when rank < n_test + trunc((n - n_test) * (0.1::double / (1 - 0.1::double)))::bigint then 'val' else 'train' end as split from c""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.random_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"with {PEOPLE_SQL} select gender, count(distinct speaker_id) as speakers from people group by gender")
def gender_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("gender", "speaker_id").distinct().groupBy("gender").agg(F.count("*").alias("speakers"))


@query(f"with {PEOPLE_SQL}, {NAMES} select country, min(filename) as first_file from (select n.filename, p.country from names n join people p using (clip_id)) group by country")
def first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.file_names(people(spark, sf_dir)).groupBy("country").agg(F.min("filename").alias("first_file"))


@query("select lang, round(avg(case when n_chars between 500 and 5000 then n_chars end), 6) as mean_quality, count(*) filter (n_chars not between 500 and 5000) as failed from documents group by lang")
def evaluation_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean without failures; null where all failed."""
    ok = F.col("n_chars").between(500, 5000)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.when(ok, F.col("n_chars"))), 6).alias("mean_quality"), F.count_if(~ok).alias("failed"))


@query("select 'event_type' as name, count(event_type) as n, count(*) - count(event_type) as nulls, count(distinct event_type) as distinct_values from events union all select 'user_id', count(user_id), count(*) - count(user_id), count(distinct user_id) from events union all select 'value', count(value), count(*) - count(value), count(distinct value) from events")
def auto_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = ("event_type", "user_id", "value")
    row = e.agg(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), (F.count("*") - F.count(c)).alias("nulls"), F.countDistinct(c).alias("distinct_values")).alias(c) for c in names])
    return row.select(F.explode(F.array(*names)).alias("p")).select("p.*")


@query(f"""with {CLIPS_SQL}, {NAMES}, {FILE_SPLIT}, f as (select n.speaker_id, fs.split, n.filename, n.file_type from names n join file_splits fs using (clip_id)), m as (select speaker_id, count(distinct split) as k from f group by 1),
 pairs as (select sum(k * (k - 1) / 2)::bigint as n from m) select 'independence' as "check", coalesce(n, 0) = 0 as passed, coalesce(n, 0)::bigint as detail from pairs
 union all select 'classes', count(*) filter (k < 2) = 0, count(*) filter (k < 2)::bigint from (select split, count(distinct file_type) as k from f group by 1)
 union all select 'names', count(*) filter (not ok) = 0, count(*) filter (not ok)::bigint from (select len(string_split(replace(filename, '.wav', ''), '_')) >= case when file_type = 'bonafide' then 3 else 4 end as ok from f)""")
def verify_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    return checks.verify(corpus.file_names(c).join(corpus.split_files(c).select("clip_id", "split"), "clip_id"))


@query(None)
def bank_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no eigenvectors; tests hold the components to numpy's."""
    p = speech.project(waves(spark, sf_dir), "wave_id", "x")
    return p.select("wave_id", *[F.round(F.col("projection")[i], 6).alias(f"axis{i}") for i in (0, 1)])


PATHS_SQL = "paths as (select page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://', ''), '/') as rel from pages)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.split(bare, "/").alias("rel"))


@query(f"""with {PATHS_SQL}, f as (select rel[1:len(rel) - 1] as parts, count(*) as direct, bool_or(rel[-1] like '%7') as holds from paths group by 1),
 laid as (select parts, direct, unnest(range(0, len(parts) + 1)) as k from f where holds)
 select coalesce(array_to_string(parts[1:k], '/'), '') as folder, sum(direct)::bigint as files, sum(case when k = len(parts) then direct else 0 end)::bigint as direct from laid group by 1""")
def tree_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders that directly hold a wanted leaf, here one that ends in 7, rolled up to all folders above."""
    return profile.tree_counts(paths(spark, sf_dir), F.element_at("rel", -1).endswith("7"))


@query(f"with {PATHS_SQL} select case when len(rel) > 1 then rel[1] else 'generic' end as category, case when len(rel) >= 3 then rel[2] else 'generic' end as subcategory, count(*) as files from paths group by 1, 2")
def category_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.category_counts(audio.inventory(paths(spark, sf_dir).withColumn("path", F.array_join("rel", "/"))))


@query("""with s as (select vec_id, 40 + vec_id % 24 - (40 + vec_id % 24) % 2 as kept, embedding::double[] as x from embeddings), b as (select *, (row_number() over (order by kept, vec_id) - 1) // 16 as batch from s),
 p as (select *, max(kept) over (partition by batch) as padded from b)
 select batch, max(padded)::bigint as padded, count(*) as n, sum(kept)::bigint as attention, sum(padded - kept)::bigint as masked, round(sum(list_sum(x[1:kept])), 6) as total from p group by batch""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of 40 to 63 samples in batches of sixteen of like length: padded length, what counts, what is masked by -100, and the sum of what isn't."""
    rows = speech.collate(speech.batches(waves(spark, sf_dir).select("wave_id", "x"), "wave_id", F.lit(40) + F.col("wave_id") % 24, 16), "x")
    masked = F.size(F.filter("labels", lambda v: v == -100.0))
    return rows.groupBy("batch").agg(
        F.max("padded").alias("padded"), F.count("*").alias("n"), F.sum("attention").alias("attention"), F.sum(masked).cast("long").alias("masked"),
        F.round(F.sum(F.aggregate(F.filter("labels", lambda v: v != -100.0), F.lit(0.0), lambda a, v: a + v)), 6).alias("total"),
    )


@query(f"with {CENTROIDS_SQL} select a.label as a, b.label as b, round(sum(a.v * b.v), 6) as cosine from unit a join unit b on a.i = b.i and a.label < b.label group by all having sum(a.v * b.v) >= 0.0")
def similar_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs that point the same way; the others are dropped within the product of their blocks."""
    return profile.pairwise(bank(spark, sf_dir), "label", "centroid", least=0.0).withColumn("cosine", F.round("cosine", 6))


@query("select 'checkpoint-' || event_type || '-' || event_id as name, event_id as number from events where event_id = (select max(event_id) from events)")
def latest_numbered_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the number in the name, not by time; names without one don't count."""
    e = table(spark, sf_dir, "events")
    names = e.select(F.concat(F.lit("checkpoint-"), "event_type", F.lit("-"), "event_id").alias("name")).unionByName(e.select(F.concat(F.lit("runs-"), F.col("event_id") + 1_000_000).alias("name")))
    return profile.latest_numbered(names, "name")


@query(f"with {CLIPS_SQL} select speaker_id, coalesce(string_agg(clip_id::varchar, ',' order by clip_id) filter (file_type = 'bonafide'), '') as bonafide, coalesce(string_agg(clip_id::varchar, ',' order by clip_id) filter (file_type = 'spoof'), '') as spoof from clips group by 1")
def clips_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of each speaker by class, as lists."""
    lists = profile.lists_by(clips(spark, sf_dir), "speaker_id", "file_type", ["bonafide", "spoof"], "clip_id")
    return lists.select("speaker_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("bonafide", "spoof")])

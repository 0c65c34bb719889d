"""Queries that write trees of audio files and read them again by their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions.shared import new_folder
from timbral.operators import corpus
from timbral.plans import pipelines
from timbral.plans.augmentation import RANKS
from timbral.plans.registry import query
from timbral.sinks import files, tree
from timbral.sources import audio, headers
from timbral.sources.adapters import CLIPS_SQL, WAVES_SQL, clips, waves

# a wave is repeated, and has the rate and channels of its label; every tenth file is cut off within its header
SHAPE_SQL = f"""{WAVES_SQL}, shaped as (select wave_id, label, 64 * (1 + wave_id % 25) as samples, [8000, 16000, 22050, 44100][label % 4 + 1] as rate, 1 + label % 2 as channels, wave_id % 10 = 9 as bad from waves),
 heads as (select *, samples // channels as frames, round((samples // channels) / rate::double, 4) as duration, 'w' || lpad(wave_id::varchar, 6, '0') || '.wav' as filename from shaped)"""


def wave_tree(spark: SparkSession, sf_dir: str, target: F.Column) -> str:
    """A folder of WAV files, made of the waves."""
    root = new_folder(spark, "waves")
    rate = F.element_at(F.array(*map(F.lit, (8000, 16000, 22050, 44100))), (F.col("label") % 4 + 1).cast("int"))
    y = F.flatten(F.array_repeat("x", (F.col("wave_id") % 25 + 1).cast("int")))
    rows = files.wav_files(waves(spark, sf_dir).select(target.alias("target"), y.alias("y"), rate.alias("rate"), (F.col("label") % 2 + 1).cast("int").alias("channels")))
    bad = F.substring(F.col("target"), -5, 1) == "9"
    tree.write(rows.select("target", F.when(bad, F.substring("content", 1, 20)).otherwise(F.col("content")).alias("content")), root)
    return root


def _name() -> F.Column:
    return F.concat(F.lit("w"), F.lpad(F.col("wave_id").cast("string"), 6, "0"), F.lit(".wav"))


@query(f"""with {SHAPE_SQL} select case when wave_id % 3 = 2 then 'unknown' else 'c' || label end as category, case wave_id % 3 when 0 then 's' || wave_id % 7 when 1 then 'generic' else 'unknown' end as subcategory, filename, duration, 'wav' as format
 from heads where not bad""")
def noise_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master inventory of a tree of waves, by headers: three parts of a path, two or one."""
    folder = F.concat(F.lit("c"), "label")
    target = F.when(F.col("wave_id") % 3 == 0, F.concat_ws("/", folder, F.concat(F.lit("s"), F.col("wave_id") % 7), _name())).when(F.col("wave_id") % 3 == 1, F.concat_ws("/", folder, _name())).otherwise(_name())
    return audio.master_inventory(headers.read(spark, wave_tree(spark, sf_dir, target))).drop("path")


@query(f"""with {SHAPE_SQL} select 'c' || label as country, case when bad then null else rate end as rate, case when bad then null else channels end as channels, count(*) as files, count(*) filter (bad) as errors,
 sum(case when not bad then frames end)::bigint as frames, round(sum(case when not bad then duration end), 4) as seconds, max(case when bad then 20 else 44 end)::bigint as most_bytes from heads group by all""")
def header_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headers say of a tree, bad files counted too, and the most bytes that were read of a file."""
    found = headers.read(spark, wave_tree(spark, sf_dir, F.concat_ws("/", F.concat(F.lit("c"), "label"), F.concat(F.lit("p"), F.col("wave_id") % 9), _name())))
    return found.groupBy(F.get("rel", F.lit(0)).alias("country"), "rate", "channels").agg(
        F.count("*").alias("files"), F.count("error").alias("errors"), F.sum("frames").alias("frames"), F.round(F.sum("duration"), 4).alias("seconds"),
        F.max("bytes_read").alias("most_bytes"),
    )


@query(f"""with {SHAPE_SQL}, speakers as (select distinct 'arf_' || lpad(label::varchar, 5, '0') as speaker_id, label from heads),
 ranks as (select *, row_number() over (order by md5(concat_ws('|', '42', speaker_id))) - 1 as rank, count(*) over () as n from speakers),
 splits as (select speaker_id, label, case when rank < trunc(n * 0.8::double) then 'train' when rank < trunc(n * 0.8::double) + trunc(n * 0.1::double) then 'val' else 'test' end as split from ranks)
 select split, speaker_id, 'bonafide_' || speaker_id || '_' || lpad((row_number() over (partition by label order by wave_id) - 1)::varchar, 4, '0') || '.wav' as filename, duration
 from heads join splits using (label) where not bad and wave_id % 4 < 2""")
def copied_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree, renamed and copied to {split}/{speaker}/ by the committing sink, as the headers of the copies have them; every other pair of sources isn't there and is passed over."""
    root, out = wave_tree(spark, sf_dir, _name()), new_folder(spark, "partition")
    w = waves(spark, sf_dir).filter("wave_id % 10 <> 9").withColumn("there", F.col("wave_id") % 4 < 2)
    speaker = F.concat(F.lit("arf_"), F.lpad(F.col("label").cast("string"), 5, "0"))
    clips = w.select(F.col("wave_id").alias("clip_id"), speaker.alias("speaker_id"), F.lit("bonafide").alias("file_type"), F.lit(None).cast("string").alias("technique"), "there", F.concat(F.lit(f"{root}/"), _name()).alias("source"))
    # numbers are those among the files that are copied; a source that is missing has a number of its own, after them
    named = corpus.file_names(clips.filter("there")).unionByName(clips.filter("not there").withColumn("filename", F.concat(F.lit("none_"), "clip_id"))).withColumn("source", F.when(F.col("there"), F.col("source")).otherwise(F.concat("source", F.lit(".gone"))))
    tree.copy_partition(named.join(corpus.split_speakers(waves(spark, sf_dir).select(speaker.alias("speaker_id"))), "speaker_id"), out)
    parts = [F.get("rel", F.lit(i)) for i in range(3)]
    return headers.read(spark, out).select(parts[0].alias("split"), parts[1].alias("speaker_id"), parts[2].alias("filename"), "duration")


@query(f"""with {CLIPS_SQL}, {RANKS}, parted as (select * from clips join splits using (speaker_id)),
 names as (select unnest(['train', 'val', 'test']) as split), kinds as (select unnest(['bonafide', 'spoof/click', 'spoof/view', 'spoof/other']) as counter),
 found as (select split, case when file_type = 'bonafide' then 'bonafide' when technique in ('click', 'view') then 'spoof/' || technique else 'spoof/other' end as counter, count(*) as n from parted group by all),
 members as (select split, count(*) as n from splits group by split)
 select split, counter, coalesce(n, 0) as n from names cross join kinds left join found using (split, counter) union all select split, 'speakers', coalesce(n, 0) from names left join members using (split)""")
def partition_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition written in batches, as its counters have it that were observed meanwhile."""
    done = pipelines.partition_batches(clips(spark, sf_dir), new_folder(spark, "counted"), ["click", "view"], batches=4)
    return done.totals().filter(F.size("path") > 1).select(F.get("path", F.lit(0)).alias("split"), F.array_join(F.slice("path", 2, 9), "/").alias("counter"), "n")

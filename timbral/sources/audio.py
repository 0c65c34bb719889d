"""Audio trees as tables: scan, layout, decode and inventories."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions.labels import file_type
from timbral.operators.kernels import WAVE_ROWS, resample
from timbral.sources import headers

SPLITS = ("train", "val", "test")
TECHNIQUES = ("CycleGAN", "Diff", "StarGAN")


def scan(spark: SparkSession, root: str, ordered: bool = False) -> DataFrame:
    """(path, rel array<string>, length) of the .wav and .flac files below root, whatever the case of the suffix; contents aren't read. `ordered`: by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath()
    rel = F.split(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), f"^{base.rstrip('/')}/", ""), "/")
    audio = found.filter(F.lower("path").rlike(r"\.(wav|flac)$")).withColumn("rel", rel)
    return audio.orderBy("path") if ordered else audio


def split_tree(files: DataFrame) -> DataFrame:
    """(filepath, speaker_id, split, filename, file_type) from {split}/{speaker}/file or {speaker}/{split}/file."""
    first, second, name = F.get("rel", F.lit(0)), F.get("rel", F.lit(1)), F.element_at("rel", -1)
    split = F.when(first.isin(*SPLITS), first).when(second.isin(*SPLITS), second)
    speaker = F.when(first.isin(*SPLITS), second).otherwise(first)
    return files.filter(F.size("rel") >= 3).select(F.col("path").alias("filepath"), speaker.alias("speaker_id"), split.alias("split"), name.alias("filename"), file_type(name).alias("file_type")).filter("split is not null")


def source_tree(files: DataFrame, speakers: DataFrame) -> DataFrame:
    """(speaker_id, technique, path): genuine files by folder, converted ones by the folder's source, TTS by prefix, TTS-VC by a name that holds the speaker.

    The first three are equi-joins on a derived key; the last one looks ids up among the name's parts, so it is one too.
    """
    top, name = F.get("rel", F.lit(0)), F.element_at("rel", -1)
    folder = F.get("rel", F.size("rel") - 2)
    own = (
        F.when(top == "Real", F.array(folder)).when(top.isin(*TECHNIQUES), F.array(F.split(folder, "-")[0])).when(top == "TTS", F.array(F.regexp_extract(name, "^TTS-([^_]+_[^_]+)_", 1)))
        .when(top == "TTS-VC", F.array_distinct(F.regexp_extract_all(name, F.lit("([A-Za-z]{3}_[0-9]+)(?=_)"), F.lit(1))))
    )
    technique = F.when(top == "Real", "bonafide").otherwise(top)
    return files.select("path", technique.alias("technique"), F.explode(own).alias("speaker_id")).join(speakers.select("speaker_id").distinct(), "speaker_id", "left_semi")


def inventory(files: DataFrame, minimum: int = 3) -> DataFrame:
    """(category, subcategory, filename, format, path): a path of fewer than `minimum` parts has the subcategory generic."""
    name = F.element_at("rel", -1)
    return files.select(
        F.when(F.size("rel") > 1, F.get("rel", F.lit(0))).otherwise("generic").alias("category"), F.when(F.size("rel") >= minimum, F.get("rel", F.lit(1))).otherwise("generic").alias("subcategory"),
        name.alias("filename"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("format"), "path",
    )


def master_inventory(found: DataFrame) -> DataFrame:
    """found: as of headers.read -> (category, subcategory, filename, duration, format, path) of the files that can be read; files at the root are unknown."""
    parts = F.size("rel")
    return found.filter("error is null").select(
        F.when(parts >= 2, F.get("rel", F.lit(0))).otherwise("unknown").alias("category"), F.when(parts >= 3, F.get("rel", F.lit(1))).when(parts == 2, "generic").otherwise("unknown").alias("subcategory"),
        F.element_at("rel", -1).alias("filename"), "duration", "format", "path",
    )


def category_counts(files: DataFrame) -> DataFrame:
    """Files of each category and subcategory of an inventory."""
    return files.groupBy("category", "subcategory").agg(F.count("*").alias("files"))


def rir_inventory(files: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Categories by folder; only simulated rooms have a subcategory. With headers, their durations too, and files that can't be read are left out."""
    names = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])
    category = F.coalesce(names[F.get("rel", F.lit(0))], F.lit("unknown"))
    known = files.filter("error is null") if "error" in files.columns else files
    more = ["duration"] if "duration" in files.columns else []
    return known.select(category.alias("category"), F.when(category == "simulated", F.get("rel", F.lit(1))).otherwise("NA").alias("subcategory"), F.element_at("rel", -1).alias("filename"), *more, "path")


def simulated(rooms: DataFrame) -> DataFrame:
    """The simulated rooms of an inventory of impulse responses."""
    return rooms.filter("category = 'simulated'")


def properties(found: DataFrame) -> DataFrame:
    """(country, speaker_id, duration, rate, channels) from {country}/{speaker}/file, by headers alone."""
    return found.filter("error is null and size(rel) >= 3").select(F.get("rel", F.lit(0)).alias("country"), F.get("rel", F.lit(1)).alias("speaker_id"), "duration", "rate", "channels")


def missing_folders(spark: SparkSession, root: str, wanted: tuple[str, ...]) -> list[str]:
    """Those of the wanted folders that aren't below root: a warning for noise and rooms, an error for the root itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(root)):
        raise FileNotFoundError(root)
    return [w for w in wanted if not system.exists(path(f"{root}/{w}"))]


def read_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """(mono samples in [-1, 1), rate, channels) of 8, 16 or 32 bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
    x = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate, channels


def decode(spark: SparkSession, root: str, rate: int = 16000) -> DataFrame:
    """(path, x, rate, channels, seconds, error): a file that can't be decoded has an error and no samples. FLAC has no decoder here.

    Files are listed by headers.read and read one by one in the tasks, so a batch holds WAVE_ROWS of them whatever the session's settings.
    """
    uri = root if ":/" in root else f"file://{root}"
    none = (None,) * 4

    def one(system: fs.FileSystem, path: str) -> tuple:
        try:
            with system.open_input_file(path) as f:
                x, own, channels = read_wav(f.read())
            return (path, resample(x, own, rate), own, channels, round(len(x) / own, 4), None)
        except Exception as e:  # noqa: BLE001  what is wrong with a file is data
            return (path, *none, f"{type(e).__name__}: {e}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(uri)[0]
        names = ["path", "x", "rate", "channels", "seconds", "error"]
        for p in parts:
            for at in range(0, len(p), WAVE_ROWS):
                rows = [one(system, x) if e is None else (x, *none, e) for x, e in zip(p.path[at : at + WAVE_ROWS], p.error[at : at + WAVE_ROWS], strict=True)]
                yield pd.DataFrame(rows, columns=names).astype({"rate": "Int32", "channels": "Int32"})

    return headers.read(spark, root).select("path", "error").mapInPandas(run, "path string, x array<double>, rate int, channels int, seconds double, error string")


def path_speaker(path: Column) -> Column:
    """STRUCT<split, speaker_id>: the first part that names a split, and the part before it."""
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*SPLITS), i)), lambda i: i.isNotNull()))
    return F.struct(F.get(parts, at).alias("split"), F.when(at > 0, F.get(parts, at - 1)).alias("speaker_id"))

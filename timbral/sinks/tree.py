"""Files in a tree as a Spark sink: rows are copied or written by tasks, and published together.

    spark.dataSource.register(FileTree)
    rows.write.format("file_tree").mode("append").save(root)

rows: `target`, a path below root, and `source`, a file to be copied, or `content`, bytes.
A task writes below a staging folder of its own attempt and lists what it made; its commit
message has that folder and four counts, however many files there are. The job's commit renames
listed files to their targets; an abort, or a task that fails midway, leaves nothing but what was
there before. A target that is there with the same length isn't written again, so a rerun only
adds what is missing. Sources that don't exist are counted, or an error with the option strict.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, REPORT = "_staging", "_committed"
BLOCK = 8 << 20
#: Threads of the commit; renames are calls to the file system only.
RENAMES = 16


@dataclass
class Done(WriterCommitMessage):
    folder: str
    written: int
    present: int
    missing: int
    bytes: int


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, columns: list[str], strict: bool) -> None:
        if "target" not in columns or ("source" in columns) == ("content" in columns):
            raise ValueError("rows need a target and either a source or a content")
        self.root, self.strict, self.job = root, strict, uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Done:
        system, base = self._system()
        context = TaskContext.get()
        done = Done(f"{base}/{STAGING}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}", 0, 0, 0, 0)
        listed = None
        for r in rows:
            parts = r.target.split("/")
            if r.target.startswith("/") or not all(parts) or ".." in parts or parts[0] in (STAGING, REPORT):
                raise ValueError(f"not a path below the root: {r.target}")
            there = system.get_file_info(f"{base}/{r.target}")
            if "source" in r:
                origin, path = fs.FileSystem.from_uri(r.source if ":/" in r.source else f"file://{r.source}")
                info = origin.get_file_info(path)
                if info.type != fs.FileType.File:
                    if self.strict:
                        raise FileNotFoundError(r.source)
                    done.missing += 1
                    continue
                length = info.size
            else:
                length = len(r.content)
            if there.type == fs.FileType.File and there.size == length:
                done.present += 1
                continue
            if listed is None:
                system.create_dir(done.folder)
                listed = system.open_output_stream(f"{done.folder}/list")
            with system.open_output_stream(f"{done.folder}/{done.written}") as out:
                if "source" in r:
                    with origin.open_input_stream(path) as f:
                        while block := f.read(BLOCK):
                            out.write(block)
                else:
                    out.write(r.content)
            listed.write((json.dumps(r.target) + "\n").encode())
            done.written += 1
            done.bytes += length
        if listed is not None:
            listed.close()
        return done

    def _publish(self, done: Done) -> None:
        system, base = self._system()
        if not done.written:
            return
        made = set()
        with system.open_input_stream(f"{done.folder}/list") as f:
            for k, line in enumerate(io.BufferedReader(f)):
                target = f"{base}/{json.loads(line)}"
                if (folder := target.rpartition("/")[0]) not in made:
                    system.create_dir(folder)
                    made.add(folder)
                system.move(f"{done.folder}/{k}", target)

    def commit(self, messages: list[Done | None]) -> None:
        system, base = self._system()
        tasks = [m for m in messages if m is not None]
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(self._publish, tasks))
        self._clean(system, base)
        system.create_dir(f"{base}/{REPORT}")
        with system.open_output_stream(f"{base}/{REPORT}/{self.job}.json") as out:
            out.write(json.dumps({k: sum(getattr(m, k) for m in tasks) for k in ("written", "present", "missing", "bytes")}).encode())

    def abort(self, messages: list[Done | None]) -> None:
        self._clean(*self._system())

    def _clean(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{STAGING}/{self.job}")
        if system.get_file_info(f"{base}/{STAGING}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{base}/{STAGING}")):
            system.delete_dir(f"{base}/{STAGING}")


class FileTree(DataSource):
    """Options: path; strict (false)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a file tree is appended to")
        root = self.options["path"]
        return TreeWriter(root if ":/" in root else f"file://{root}", schema.fieldNames(), self.options.get("strict", "false").lower() == "true")


def write(rows: DataFrame, root: str, strict: bool = False) -> None:
    """rows: (target, source) or (target, content)."""
    rows.sparkSession.dataSource.register(FileTree)
    rows.write.format("file_tree").option("strict", str(strict)).mode("append").save(root)


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(written, present, missing, bytes) of each job that was committed below root."""
    return spark.read.schema("written long, present long, missing long, bytes long").json(f"{root.rstrip('/')}/{REPORT}")


def partition_target(split: str, speaker: str, filename: str) -> Column:
    return F.concat_ws("/", split, speaker, filename)


def copy_partition(files: DataFrame, root: str) -> None:
    """files: (split, speaker_id, filename, source) -> renamed copies in {split}/{speaker}/."""
    write(files.select(partition_target("split", "speaker_id", "filename").alias("target"), "source"), root)


def copy_subset(protocol: DataFrame, audio: DataFrame, root: str, suffix: str = "flac") -> None:
    """protocol: chosen rows; audio: (audio_id, source). The audio goes to {suffix}/{audio_id}.{suffix}, the protocol to protocol/ and a table of the speakers to README/."""
    found = protocol.select("audio_id").join(audio.select("audio_id", "source"), "audio_id")
    write(found.select(F.concat(F.lit(f"{suffix}/"), "audio_id", F.lit(f".{suffix}")).alias("target"), "source"), root)
    line = F.concat_ws(" ", "speaker_id", "audio_id", "system_id", "key")
    protocol.repartitionByRange("audio_id").sortWithinPartitions("audio_id").select(line.alias("value")).write.mode("overwrite").text(f"{root}/protocol")
    n = protocol.groupBy("speaker_id").agg(F.count_if(F.col("key") == "bonafide").alias("b"), F.count_if(F.col("key") == "spoof").alias("s"))
    n.orderBy(F.desc(F.col("b") + F.col("s")), "speaker_id").select(F.format_string("%s: %d bonafide, %d spoof", "speaker_id", "b", "s").alias("value")).write.mode("overwrite").text(f"{root}/README")

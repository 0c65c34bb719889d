"""Token alignment of two tokenizers, with corpus-wide counts of the pairs that overlap.

1. Both tokenizers run once over each text; token ids are kept in a table in the shared folder.
2. A link is an A token and a B token that share bytes. Between two neighbouring token ends of
   either kind lies one link, so links are made by merging the two rows of ends. A pair of ids is packed
   into one int64 (B above A); each partition counts its keys by np.unique.
3. Partial counts are dealt by range of key (bounds sampled by Spark) and sorted; runs of
   equal keys are summed as they stream by, into sorted shards in the shared folder.
4. A second pass maps the shards into memory and looks each batch's keys up by searchsorted;
   the pages are shared by a machine's workers and no shard is loaded whole. The highest
   count of each B id is a table of the vocabulary's size and goes with the tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.bpe import byte_symbols
from timbral.llm.common import cut, map_arrow, shared_folder

#: Keys that a partition holds before it merges them, and distinct ones before it gives them away.
PENDING, HELD = 1 << 20, 4 << 20
#: Characters of one piece that the quick route of A may meet; its merging is quadratic in a piece.
PIECE = 512
#: The split pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Tokenizers A (a byte-level BPE file of the tokenizers library) and B (a sentencepiece model), and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes) -> None:
        vocabulary = json.loads(a)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        of_symbol = {c: i for i, c in enumerate(byte_symbols())}
        ids = vocabulary["model"]["vocab"]
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = b"" if token in special else bytes(of_symbol[c] for c in token)
        self.exact = tokenizers.Tokenizer.from_str(a)
        self.exact.encode_special_tokens = True
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t}, special_tokens={})
        self.long_space = re.compile(r"\s{%d}" % PIECE).search
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids by A of a blank and the text, by B of the text; none where their bytes aren't those of a blank and the text."""
        if not text:
            return [], []
        spaced = " " + text
        if max(map(len, text.split()), default=0) > PIECE or self.long_space(text):
            a = self.exact.encode(spaced, add_special_tokens=False).ids
        else:
            a = self.quick.encode_ordinary(spaced)
        b, whole = self.b.encode(text), spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        return a, b


#: This worker's tokenizers, by their files.
_PAIRS: dict[str, Pair] = {}


def pair(files: tuple[str, bytes]) -> Pair:
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*files)
    return _PAIRS[key]


def id_type(n: int) -> str:
    """How ids of a vocabulary of n tokens are stored."""
    return "<u2" if n <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, a binary, b binary): ids as little-endian integers of id_type. The files are of fixed size and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(shared.value)
        kinds = [id_type(len(own.a_bytes)), id_type(len(own.b_bytes))]
        for rows in batches:
            got = [[np.array(ids, kind).tobytes() for ids, kind in zip(own.encode(t.as_py()), kinds, strict=True)] for t in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([g[k] for g in got], pa.binary()) for k in (0, 1))], ["doc_id", "a", "b"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, a binary, b binary")


@dataclass
class Links:
    """The links of a batch of documents, in order; of_doc has where each document's links, A and B tokens end."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    keys: np.ndarray
    doc_links: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    doc_groups: np.ndarray


def link(a_column: pa.Array, b_column: pa.Array, a_len: np.ndarray, b_len: np.ndarray) -> Links:
    """Tokens of all documents of a batch on one line of bytes: a document's A and B tokens cover the same bytes of it."""
    parts = [[np.frombuffer(x, id_type(len(n))) for x in c.to_pylist()] for c, n in ((a_column, a_len), (b_column, b_len))]
    a, b = (np.concatenate([np.empty(0, np.int64), *p]) for p in parts)
    doc_a, doc_b = (np.cumsum([0, *map(len, p)])[1:] for p in parts)
    a_ends, b_ends = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs
    ends = ends[np.diff(ends, prepend=0) > 0]
    a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = ends[(a_ends[a_at] == ends) & (b_ends[b_at] == ends)] if len(ends) else ends
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    a_last, b_last = (shared[g] == e if len(e) else np.empty(0, bool) for g, e in ((a_group, a_ends), (b_group, b_ends)))
    doc_ends = np.concatenate([[0], a_ends])[doc_a]
    return Links(
        a, b, a_group, b_group, a_last, b_last, b[b_at] << 32 | a[a_at],
        np.searchsorted(ends, doc_ends, "right"), doc_a, doc_b, np.searchsorted(shared, doc_ends, "right"),
    )


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(held: DataFrame, a_len: np.ndarray, b_len: np.ndarray) -> DataFrame:
    """held: as of tokens -> (key, n): counts of a partition's pairs, sorted; a key comes once, or once for every HELD distinct ones."""

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)], pa.int64()) for x in (keys, counts)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        keys, counts, waiting, size = none, none, [], 0
        for rows in batches:
            waiting.append(np.unique(link(rows.column(0), rows.column(1), a_len, b_len).keys, return_counts=True))
            size += len(waiting[-1][0])
            if size > PENDING:
                keys, counts = _merged(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True)))
                waiting, size = [], 0
                if len(keys) > HELD:
                    yield from out(keys, counts)
                    keys = counts = none
        yield from out(*_merged(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True))))

    return map_arrow(held.select("a", "b"), run, "key long, n long")


@dataclass
class Counts:
    """Sorted shards of (key, n) in a folder that all workers see, and the highest count of each B id."""

    folder: str
    #: (name, first key, last key, keys), in the order of keys
    shards: list[tuple[str, int, int, int]]
    best: np.ndarray
    _open: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _columns(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in self._open:
            both = []
            for kind in ("keys", "counts"):
                system, path = fs.FileSystem.from_uri(f"{self.folder}/{name}.{kind}")
                if not isinstance(system, fs.LocalFileSystem):  # no file to map: this shard is read, and not kept
                    both.append(np.frombuffer(system.open_input_file(path).read(), "<i8"))
                else:
                    both.append(np.memmap(path, "<i8", "r"))
            if not isinstance(both[0], np.memmap):
                return both[0], both[1]
            self._open[name] = (both[0], both[1])
        return self._open[name]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, which are sorted and distinct; 0 for those never seen."""
        out = np.zeros(len(keys), np.int64)
        for name, first, last, _ in self.shards:
            low, high = np.searchsorted(keys, (first, last + 1)).tolist()
            if low < high:
                own, counts = self._columns(name)
                at = np.searchsorted(own, keys[low:high])
                at[at == len(own)] = 0
                out[low:high] = np.where(own[at] == keys[low:high], counts[at], 0)
        return out

    def table(self, spark) -> DataFrame:
        """(b_id, a_id, n) of all pairs, by key."""
        shards = spark.createDataFrame(self.shards, "name string, low long, high long, n long").repartition(max(1, len(self.shards)), "name")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for name in rows.column(0).to_pylist():
                    keys, counts = self._columns(name)
                    for at in range(0, len(keys), 1 << 17):
                        k = np.asarray(keys[at : at + (1 << 17)])
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k >> 32, k & 0xFFFFFFFF, np.asarray(counts[at : at + (1 << 17)]))], ["b_id", "a_id", "n"])

        return shards.mapInArrow(run, "b_id long, a_id long, n long")


def count_shards(partial: DataFrame, n_b: int) -> Counts:
    """partial: (key, n), keys repeated -> their sums, in shards below the shared folder.

    A shard is one range partition: its rows stream by in order and runs of equal keys become
    one entry. A task writes under a name of its own attempt and renames at its end, so retried and
    speculative ones do no harm. The driver gets a row a shard and one for each B id of a shard.
    """
    spark = partial.sparkSession
    folder = f"{_uri(shared_folder(spark))}/pairs-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, attempt = f"{context.partitionId():06d}", context.taskAttemptId()
        system, path = fs.FileSystem.from_uri(folder)
        files = {kind: system.open_output_stream(f"{path}/{name}.{kind}-{attempt}") for kind in ("keys", "counts")}
        best = np.zeros(n_b, np.int64)
        first = last = None
        n, open_count = 0, 0  # the last key's run may go on in the next batch

        def put(keys: np.ndarray, counts: np.ndarray) -> int:
            files["keys"].write(keys.astype("<i8").tobytes())
            files["counts"].write(counts.astype("<i8").tobytes())
            np.maximum.at(best, keys >> 32, counts)
            return len(keys)

        for rows in batches:
            if not rows.num_rows:
                continue
            keys, counts = _merged(rows.column(0).to_numpy(), rows.column(1).to_numpy())
            if first is None:
                first = int(keys[0])
            elif keys[0] == last:
                counts[0] += open_count
            else:
                n += put(np.array([last]), np.array([open_count]))
            n += put(keys[:-1], counts[:-1])
            last, open_count = int(keys[-1]), int(counts[-1])
        if first is not None:
            n += put(np.array([last]), np.array([open_count]))
        for kind, f in files.items():
            f.close()
            system.move(f"{path}/{name}.{kind}-{attempt}", f"{path}/{name}.{kind}")
        if n:
            ids = np.flatnonzero(best)
            shard = [pa.array([name] * (len(ids) + 1), pa.string()), *(pa.array([x] * (len(ids) + 1), pa.int64()) for x in (first, last, n))]
            yield pa.RecordBatch.from_arrays([*shard, pa.array([-1, *ids], pa.int64()), pa.array([0, *best[ids]], pa.int64())], ["name", "first", "last", "n", "b", "best"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(partial).repartitionByRange(parts, "key").sortWithinPartitions("key")
    said = cut(ranged.mapInArrow(run, "name string, first long, last long, n long, b long, best long"))
    shards = [tuple(r) for r in said.filter("b < 0").select("name", "first", "last", "n").orderBy("first").collect()]
    best = np.zeros(n_b, np.int64)
    for r in said.filter("b >= 0").groupBy("b").agg(F.max("best").alias("best")).collect():
        best[r.b] = r.best
    return Counts(folder, shards, best)


def _uri(folder: str) -> str:
    return folder if re.match(r"\w+:/", folder) else f"file://{folder}"


class Words:
    """Text of groups: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.a = np.array([f"{i}{end}" for end in ",|" for i in range(n_a)], object)
        self.b = np.array([f"{i}{end}" for end in ",;" for i in range(n_b)], object)

    def __call__(self, x: Links) -> Iterator[str]:
        """One string for each document of the batch."""
        groups = int(x.doc_groups[-1]) if len(x.doc_groups) else 0
        b_before = np.searchsorted(x.b_group, np.arange(groups))
        a_until = np.searchsorted(x.a_group, np.arange(groups), "right")
        line = np.empty(len(x.a) + len(x.b), object)
        line[np.arange(len(x.a)) + b_before[x.a_group]] = self.a[x.a + len(self.a) // 2 * x.a_last]
        line[np.arange(len(x.b)) + a_until[x.b_group]] = self.b[x.b + len(self.b) // 2 * x.b_last]
        start = 0
        for end in (x.doc_a + x.doc_b).tolist():
            yield "".join(line[start:end].tolist())[:-1]
            start = end


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def align(docs: DataFrame, a_file: str, b_file: str, digest: bool = False) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per row of docs.

    n_links are pairs of tokens that share bytes, n_best those whose count over all documents is the
    highest of their B id (ties too), count_sum the sum of these counts. groups has the ids between common ends, or with `digest` their
    SHA-256 (groups_sha256). Texts that are null, empty or not kept byte for byte by a
    tokenizer have zeros and an empty string. Repeated rows count as often as they come; null ids
    stay; an empty table gives no rows; other columns are dropped. The tokens and shards stay in the shared folder, as the result reads them.
    """
    spark = docs.sparkSession
    files = (Path(a_file).read_text(encoding="utf-8"), Path(b_file).read_bytes())
    own = pair(files)
    a_len, b_len = (np.array(list(map(len, x)), np.int64) for x in (own.a_bytes, own.b_bytes))
    place = f"{_uri(shared_folder(spark))}/tokens-{uuid.uuid4().hex}"
    tokens(docs, files).write.parquet(place)
    held = spark.read.parquet(place)
    shared = spark.sparkContext.broadcast(count_shards(partial_counts(held, a_len, b_len), len(b_len)))
    last = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = shared.value, Words(len(a_len), len(b_len))
        for rows in batches:
            x = link(rows.column(1), rows.column(2), a_len, b_len)
            distinct, at = np.unique(x.keys, return_inverse=True)
            n = counts(distinct)[at]
            per_doc = [np.diff(e, prepend=0) for e in (x.doc_a, x.doc_b, x.doc_groups, x.doc_links)]
            per_doc += [_sums(n == counts.best[x.keys >> 32], x.doc_links), _sums(n, x.doc_links)]
            text = [hashlib.sha256(w.encode()).hexdigest() if digest and w else w for w in words(x)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(v, pa.int64()) for v in per_doc), pa.array(text, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last],
            )

    return map_arrow(held, run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string")

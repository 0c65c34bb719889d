"""Exact repeated passages through a log-structured index of window fingerprints, verified by a second one.

Every window of WINDOW consecutive words has a rolling fingerprint of KEY_BITS bits. A task's
fingerprints become sorted immutable runs, one per range (bucket) of fingerprints and
delta-coded, each fingerprint with the group of documents that asks for it. One that is met twice
within a run is known to repeat: the groups that have it are told directly, and the run keeps two
entries that ask nothing, so a very common passage is two entries a run, however many documents have
it. All runs of a bucket, those of the batch and of the history, meet in one task and are
merged; fingerprints met twice go back to the groups that asked. There each document's windows
are looked up: those found are suspects.

Suspects are verified: the same is done once more with the suspect windows alone, by a second fingerprint
of another base and another hash of the words, and only windows that repeat by both are dropped.
Two different windows would have to agree in 120 bits. A text is never cut; nothing is
broadcast or collected.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm.common import map_arrow

WINDOW = 35
#: Windows that a task gathers before it writes sorted runs.
RUN_WINDOWS = 2_000_000
#: Distinct words whose hashes a worker keeps.
MEMO_WORDS = 500_000
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
#: Bits of the first fingerprint: it only finds suspects. The second has 64.
KEY_BITS = 56
#: The second fingerprint's base and word hash seed.
BASE2, SEED2 = 0xD1342543DE82EF95, 1
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 22
IN_WORD = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], np.int8)
RUN_SCHEMA = "bucket int, g int, keys binary, groups binary, n long"


class Windows:
    """Fingerprints of all windows of a document, from its words' hashes."""

    def __init__(self, window: int = WINDOW, base: int = BASE, seed: int | None = None) -> None:
        """seed: of XXH64 as the words' hash; None hashes words by sums over their bytes, all of a text at once."""
        self.window, self.base, self.seed = window, base, seed
        self.memo: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.base, -1, 1 << 64)
            size = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, text: str | None) -> list[bytes]:
        return _bytes(text).split()

    def hashes(self, text: str | None) -> np.ndarray:
        """A hash of each word."""
        data = _bytes(text)
        if self.seed is None:
            parts = [self._sums(data[a:b]) for a, b in _pieces(data)]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        words = data.split()
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        for w in set(words).difference(self.memo):
            self.memo[w] = xxhash.xxh64_intdigest(w, self.seed)
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def _sums(self, data: bytes) -> np.ndarray:
        """For each word the sum of (byte + 1) * base ** (place in the word)."""
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        inside = np.zeros(n + 2, np.int8)
        np.take(IN_WORD, b, out=inside[1:-1])
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])

    def of(self, h: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of words with these hashes."""
        k, n = self.window, len(h)
        if n < k:
            return np.zeros(0, np.uint64)
        self._powers(n + k)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.down[:n], out=sums[1:])
        return _mixed((sums[k:] - sums[:-k]) * self.up[k - 1 : n])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a blank, so that no word is cut."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.rfind(b" ", at, at + PIECE)
        if end <= at:
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
        yield at, end
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the low bits' differences to the high ones, which choose the bucket."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: differences, bytes of equal place together, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes())


def unpack(data: bytes, n: int, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * width)), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel(), dtype=kind)


def _per_group(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Groups, and the sorted distinct fingerprints of each."""
    order = np.lexsort((h, g))
    h, g = h[order], g[order]
    ends = np.flatnonzero(np.diff(g)) + 1
    return g[np.concatenate([[0], ends])], [np.unique(x) for x in np.split(h, ends)]


def _runs(hashes, buckets: int):  # noqa: ANN001
    """(group, text, ...) -> sorted runs (bucket, -, keys, groups, n) and, for fingerprints met twice in a run, answers (any bucket, g, keys, -, n)."""

    def flush(keys: list[np.ndarray], groups: list[np.ndarray], at: int) -> Iterator[pa.RecordBatch]:
        h, g = np.concatenate(keys), np.concatenate(groups)
        order = np.argsort(h)
        h, g = h[order], g[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(first, len(h))) > 1
        again = np.repeat(many, np.diff(np.append(first, len(h))))
        if again.any():
            names, parts = _per_group(h[again], g[again])
            n = len(names)
            where = (at + np.arange(n)) % buckets
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(names, pa.int32()), pa.array([pack(p) for p in parts], pa.binary()), pa.nulls(n, pa.binary()), pa.array([len(p) for p in parts], pa.int64())], ["bucket", "g", "keys", "groups", "n"])
        repeats = 1 + many
        h, g = np.repeat(h[first], repeats), np.repeat(np.where(many, -1, g[first]).astype(np.int32), repeats)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        ends = np.flatnonzero(np.diff(bucket)) + 1
        starts = np.concatenate([[0], ends])
        ks, gs = np.split(h, ends), np.split(g, ends)
        for at in range(0, len(ks), 64):
            part = slice(at, at + 64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts[part]].astype(np.int32)), pa.nulls(len(ks[part]), pa.int32()), pa.array([pack(k) for k in ks[part]], pa.binary()),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in gs[part]], pa.binary()), pa.array([len(k) for k in ks[part]], pa.int64()),
                ],
                ["bucket", "g", "keys", "groups", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, groups, held, at = hashes(), [], [], 0, 0
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = of(*row)
                if len(h):
                    keys.append(h)
                    groups.append(np.full(len(h), g, np.int32))
                    held += len(h)
                    if held >= RUN_WINDOWS:
                        yield from flush(keys, groups, at)
                        keys, groups, held, at = [], [], 0, at + 7
        if held:
            yield from flush(keys, groups, at)

    return run


def _all_windows(window: int, bits: int):
    """(text) -> first fingerprints of all windows."""

    def make():
        windows = Windows(window)
        return lambda text: _high(windows.of(windows.hashes(text)), bits)

    return make


def _high(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)) << np.uint64(64 - bits) if bits < 64 else h


def _suspect_windows(window: int):
    """(text, starts, how many) -> second fingerprints of the suspect windows."""

    def make():
        windows = Windows(window, BASE2, SEED2)
        return lambda text, starts, n: windows.of(windows.hashes(text))[unpack(starts, n, np.uint32)] if n else np.zeros(0, np.uint64)

    return make


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows come sorted by bucket: (bucket, fingerprints, groups) of each; what asks nothing, such as a run of the history, has group -1."""
    now, keys, groups = None, [], []
    for b in batches:
        for bucket, _, k, g, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != now:
                if keys:
                    yield now, np.concatenate(keys), np.concatenate(groups)
                now, keys, groups = bucket, [], []
            keys.append(unpack(k, n))
            groups.append(np.full(n, -1, np.int32) if g is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(g, max_output_size=4 * n), np.int32))
    if keys:
        yield now, np.concatenate(keys), np.concatenate(groups)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a bucket -> for each group the sorted fingerprints that it asked for and that were met twice or more; answers pass."""
    passed: list[pa.RecordBatch] = []

    def runs_only() -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = b.filter(b.column(1).is_valid())
            if answers.num_rows:
                passed.append(answers.select(["g", "keys", "n"]))
            yield b.filter(b.column(1).is_null())

    for _, h, g in _by_bucket(runs_only()):
        yield from passed
        passed.clear()
        order = np.argsort(h, kind="stable")
        h, g = h[order], g[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        twice &= g >= 0
        if not twice.any():
            continue
        names, parts = _per_group(h[twice], g[twice])
        for at in range(0, len(parts), 64):
            part = parts[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 64], pa.int32()), pa.array([pack(p) for p in part], pa.binary()), pa.array([len(p) for p in part], pa.int64())], ["g", "keys", "n"])
    yield from passed


def covered(hits: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that hits marks at its start."""
    step = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(hits)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows come sorted by (g, kind): a group's repeated fingerprints, then its documents: each document's row with those fingerprints, and None between batches."""
    now, parts, known = None, [], None
    for b in batches:
        for g, kind, doc_id, text, keys, n, n_words, kept in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if g != now:
                now, parts, known = g, [], None
            if kind == 0:
                parts.append(unpack(keys, n))
                continue
            if known is None:
                known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            yield g, doc_id, text, keys, n, n_words, kept, known
        yield None


def _hits(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(h) or not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _finished(whole: bool, words: list[bytes], gone: np.ndarray | None) -> str:
    rest = b" ".join(words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])
    return rest.decode("utf-8", "surrogatepass") if whole else hashlib.sha256(rest).hexdigest()


def _suspect(window: int, whole: bool, bits: int):
    """-> (g, doc_id, n_words, kept, text, starts, n): of documents without suspects kept, of the others the text and where suspects start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, rows = Windows(window), []
        for row in _looked_up(batches):
            if row is None:
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["g", "doc_id", "n_words", "kept", "text", "starts", "n"])
                rows = []
                continue
            g, doc_id, text, *_, known = row
            h = windows.hashes(text)
            at = np.flatnonzero(_hits(_high(windows.of(h), bits), known)).astype(np.uint32)
            rows.append((g, doc_id, len(h), None, text, pack(at), len(at)) if len(at) else (g, doc_id, len(h), _finished(whole, windows.words(text), None), None, None, 0))

    return run


def _drop(window: int, whole: bool):
    """Suspect windows whose second fingerprint repeats too go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, rows = Windows(window, BASE2, SEED2), []
        for row in _looked_up(batches):
            if row is None:
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])
                rows = []
                continue
            _, doc_id, text, starts, n, n_words, kept, known = row
            if kept is not None:
                rows.append((doc_id, n_words, 0, kept))
                continue
            words = windows.words(text)
            at = unpack(starts, n, np.uint32)
            hits = np.zeros(len(words), bool)
            hits[at[_hits(windows.of(windows.hashes(text))[at], known)]] = True
            gone = covered(hits, len(words), window) if hits.any() else None
            rows.append((doc_id, len(words), 0 if gone is None else int(gone.sum()), _finished(whole, words, gone)))

    return run


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _group(n: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g")


def runs(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, bits: int = KEY_BITS) -> DataFrame:
    """The sorted runs of docs: (bucket, g, keys, groups, n)."""
    n = _width(docs.sparkSession)
    return map_arrow(docs.select(_group(n), "text"), _runs(_all_windows(window, bits), buckets or 2 * n), RUN_SCHEMA)


def _answers(made: DataFrame) -> DataFrame:
    """Runs -> (g, keys, n): the repeated fingerprints that each group asked for."""
    return map_arrow(made.repartitionById(_width(made.sparkSession), "bucket").sortWithinPartitions("bucket"), _merge, "g int, keys binary, n long")


def _told(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """docs: (g, doc_id, text, keys, n, n_words, kept), each group's answers before its documents."""
    n = _width(docs.sparkSession)
    null = {"doc_id": "long", "text": "string", "n_words": "long", "kept": "string"}
    columns = ["g", "kind", "doc_id", "text", "keys", "n", "n_words", "kept"]
    known = answers.withColumns({"kind": F.lit(0)} | {c: F.lit(None).cast(t) for c, t in null.items()}).select(*columns)
    return docs.withColumn("kind", F.lit(1)).select(*columns).unionByName(known).repartitionById(n, "g").sortWithinPartitions("g", "kind")


def _asking_nothing(history: DataFrame) -> DataFrame:
    return history.select("bucket", F.lit(None).cast("int").alias("g"), "keys", F.lit(None).cast("binary").alias("groups"), "n")


def without_repeats(docs: DataFrame, window: int = WINDOW, history: tuple[DataFrame, DataFrame] | None = None, buckets: int | None = None, whole: bool = True, bits: int = KEY_BITS) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, n_words, n_removed, kept), one row per row of docs.

    Words covered by a window whose words also start elsewhere in docs, or are in the history's
    runs (of first and second fingerprints), are removed; kept joins the others by a blank (whole=False: its SHA-256 in
    hexadecimal). Windows are judged on the input, not on what is left. A null text has no
    words. Repeated rows are repeats of one another; null ids stay; an empty table gives no
    rows; other columns are dropped. bits: of the first fingerprint.
    """
    n = _width(docs.sparkSession)
    own = docs.select("doc_id", "text")
    made = runs(own, window, buckets, bits)
    if history is not None:
        made = made.unionByName(_asking_nothing(history[0]))
    asked = own.select(_group(n), "doc_id", "text", F.lit(None).cast("binary").alias("keys"), *[F.lit(None).cast("long").alias(c) for c in ("n", "n_words")], F.lit(None).cast("string").alias("kept"))
    looked = map_arrow(_told(asked, _answers(made)), _suspect(window, whole, bits), "g int, doc_id long, n_words long, kept string, text string, starts binary, n long")
    second = map_arrow(looked.filter("n > 0").select("g", "text", "starts", "n"), _runs(_suspect_windows(window), buckets or 2 * n), RUN_SCHEMA)
    if history is not None:
        second = second.unionByName(_asking_nothing(history[1]))
    told = _told(looked.withColumnRenamed("starts", "keys"), _answers(second))  # documents without suspects pass: looking up once less is worth their digests' way
    return map_arrow(told, _drop(window, whole), "doc_id long, n_words long, n_removed long, kept string")


class RunIndex:
    """The history: sorted runs of first and of second fingerprints below one path that all executors see, and a log of which of them count.

    {path}/runs/{id}/first and /second hold one batch or merge; {path}/log/{number}.json is a list of the
    runs that count, oldest first, and the log's last entry holds. Both kinds of a run begin
    to count with one entry, so what is cut short before it counts for nothing. An entry's number can be taken once: of two writers one
    fails, and its runs don't count.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = WINDOW) -> None:
        self.spark, self.path, self.buckets, self.window = spark, path.rstrip("/"), buckets, window

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[str, str]]:
        """(name, id) of the runs that count, oldest first."""
        return self._log()[1]

    def _log(self) -> tuple[int, list[tuple[str, str]]]:
        top, system = self._file("log")
        names = sorted(n for f in system.listStatus(top) if (n := f.getPath().getName()).endswith(".json")) if system.exists(top) else []
        if not names:
            return 0, []
        return int(names[-1][:-5]), [tuple(r) for r in json.loads(self.spark.read.text(f"{self.path}/log/{names[-1]}", wholetext=True).first()[0])]

    def _publish(self, number: int, runs: list[tuple[str, str]]) -> None:
        aside, system = self._file(f"log/{uuid.uuid4().hex}.part")
        entry, _ = self._file(f"log/{number:010d}.json")
        out = system.create(aside, False)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        if system.exists(entry) or not system.rename(aside, entry):
            system.delete(aside, False)
            raise RuntimeError(f"entry {number} of the log was written by another")

    def _read(self, runs: list[tuple[str, str]], kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{i}/{kind}" for _, i in runs])

    def _delete(self, runs: list[tuple[str, str]]) -> None:
        for _, i in runs:
            gone, system = self._file(f"runs/{i}")
            system.delete(gone, True)

    def history(self) -> tuple[DataFrame, DataFrame] | None:
        runs = self.runs()
        return (self._read(runs, "first"), self._read(runs, "second")) if runs else None

    def dedup(self, batch: DataFrame, whole: bool = True) -> DataFrame:
        """What is left of a batch, against the history and itself."""
        return without_repeats(batch, self.window, self.history(), self.buckets, whole)

    def append(self, batch: DataFrame, name: str) -> None:
        """Adds the batch's runs. Those of a batch of the same name, where they weren't merged yet, make way for it. An empty batch adds empty runs; null texts have no windows."""
        own = uuid.uuid4().hex
        for kind, base, seed, bits in (("first", BASE, None, KEY_BITS), ("second", BASE2, SEED2, 64)):

            def make(window: int = self.window, base: int = base, seed: int | None = seed, bits: int = bits):
                windows = Windows(window, base, seed)
                return lambda text: np.unique(_high(windows.of(windows.hashes(text)), bits))

            made = map_arrow(batch.select(F.lit(-1).alias("g"), "text"), _runs(make, self.buckets), RUN_SCHEMA).filter("g is null")
            made.select("bucket", "keys", "n").write.parquet(f"{self.path}/runs/{own}/{kind}")
        number, runs = self._log()
        self._publish(number + 1, [r for r in runs if r[0] != name] + [(name, own)])
        self._delete([r for r in runs if r[0] == name])

    def compact(self, name: str, most: int | None = None) -> None:
        """Merges the `most` oldest runs (None: all) into one of that name, each fingerprint once, in their place.

        The name may be that of a run that is merged, not that of another. What is merged goes only after the log
        has the merged run, so one that is cut short loses nothing. Merged in batches of a level's size, each fingerprint is
        rewritten once a level.
        """
        number, runs = self._log()
        old, rest = (runs, []) if most is None else (runs[:most], runs[most:])
        if not old:
            return
        if name in [r[0] for r in rest]:
            raise ValueError(f"{name} is a run that isn't merged")
        own = uuid.uuid4().hex

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, h, _ in _by_bucket(batches):
                keys = np.unique(h)
                for at in range(0, len(keys), RUN_WINDOWS):  # a run's cell has a bounded size
                    part = keys[at : at + RUN_WINDOWS]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack(part)], pa.binary()), pa.array([len(part)], pa.int64())], ["bucket", "keys", "n"])

        for kind in ("first", "second"):
            rows = _asking_nothing(self._read(old, kind)).repartitionById(_width(self.spark), "bucket").sortWithinPartitions("bucket")
            map_arrow(rows, merge, "bucket int, keys binary, n long").write.parquet(f"{self.path}/runs/{own}/{kind}")
        self._publish(number + 1, [(name, own), *rest])
        self._delete(old)

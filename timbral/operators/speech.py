"""Tables around speech models. The models are given: a function from a batch of inputs to outputs; a row that fails has an error, and stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timbral.functions.draws import shuffle_key
from timbral.operators import corpus, profile
from timbral.operators.numbering import numbered


@dataclass(frozen=True)
class Batched:
    """A model that takes a list of inputs and gives as many outputs. load makes it, once a worker; name tells models apart there."""

    name: str
    load: Callable[[], Callable[[list], list]]
    size: int = 64

    def outputs(self, values: list) -> Iterator[tuple[object, str | None]]:
        """(output, error) of each value. A batch that fails is tried value by value, so that only bad ones have errors."""
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        model = _LOADED[self.name]
        for at in range(0, len(values), self.size):
            some = values[at : at + self.size]
            try:
                got = list(model(some))
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} outputs of {len(some)} inputs")
                yield from ((g, None) for g in got)
            except Exception:  # noqa: BLE001  which of them it was shows below
                yield from (_tried(lambda v=v: list(model([v]))[0]) for v in some)


#: The models that this worker has loaded; they outlast a task.
_LOADED: dict[str, Callable[[list], list]] = {}


def _tried(call: Callable[[], object]) -> tuple[object, str | None]:
    try:
        return call(), None
    except Exception as e:  # noqa: BLE001  one bad row must not end a corpus
        return None, f"{type(e).__name__}: {e}"


def apply_model(rows: DataFrame, column: str, model: Callable[[object], object] | Batched, out: str, kind: str) -> DataFrame:
    """rows with out, of the type named, and error. A Batched model is loaded once a worker and called with lists; a plain function is called with each value."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            values = p[column].tolist()
            results = list(model.outputs(values) if isinstance(model, Batched) else (_tried(lambda v=v: model(v)) for v in values))
            yield p.assign(**{out: pd.Series([r[0] for r in results], dtype=object, index=p.index), "error": [r[1] for r in results]})

    return rows.mapInPandas(run, StructType.fromDDL(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` {kind}, error string"))


def transcribe(audio: DataFrame, model: Callable[[object], str] | Batched, done: DataFrame | None = None) -> DataFrame:
    """(path, x, ...) -> text; paths already done are left out."""
    todo = audio if done is None else corpus.pending(audio, done, "path")
    return apply_model(todo, "x", model, "text", "string")


def speaker_bank(audio: DataFrame, model: Callable[[object], list[float]] | Batched, most: int = 50, done: DataFrame | None = None) -> DataFrame:
    """(speaker_id, path, x) -> (speaker_id, centroid): at most `most` clips a speaker, by keyed hash; done speakers are left out."""
    todo = audio if done is None else corpus.pending(audio, done, "speaker_id")
    vectors = apply_model(profile.stratified(todo, "speaker_id", "path", most), "x", model, "vector", "array<double>")
    return profile.centroids(vectors.filter("error is null"), "speaker_id", "vector")


def examples(transcripts: DataFrame, bank: DataFrame, tokenise: Callable[[str], list[int]] | Batched, size: int = 512) -> DataFrame:
    """Transcripts with token ids and the speaker's vector, zeros for a speaker without one; rows without text go."""
    rows = transcripts.dropna(subset=["text"]).join(bank.select("speaker_id", F.col("centroid").alias("embedding")), "speaker_id", "left")
    rows = rows.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), size)))
    return apply_model(rows, "text", tokenise, "input_ids", "array<int>")


def random_split(rows: DataFrame, key: str, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with `split` by global keyed rank: int(n * test) test, then int of val's share of the rest."""
    n = rows.agg(F.count("*").alias("n"))
    ranked = corpus.ranked(rows.withColumn("_key", shuffle_key(key, seed=seed)), "_key", "_rank").join(F.broadcast(n))
    n_test = (F.col("n") * F.lit(float(test))).cast("long")
    n_val = ((F.col("n") - n_test) * F.lit(val / (1 - test))).cast("long")
    split = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_key", "_rank", "n")


def project(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """Principal components in place of a stochastic embedding: (key, projection array of k), centred. No vectors, no rows."""
    if vectors.isEmpty():
        return vectors.select(key, F.lit(None).cast("array<double>").alias("projection"))
    rows = vectors.select(key, array_to_vector(vector).alias("_v"))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select(key, vector_to_array("_p").alias("_p"))
    means = out.agg(F.array(*[F.avg(F.col("_p")[i]) for i in range(k)]).alias("_m"))
    return out.join(F.broadcast(means)).select(key, F.zip_with("_p", "_m", lambda a, b: a - b).alias("projection"))


def batches(rows: DataFrame, key: str, length: Column, size: int, multiple: int = 2) -> DataFrame:
    """rows with `batch`, `kept` and `padded`: batches of `size` rows of like length, what is kept of a row (its length, cut to a multiple), and the batch's length, its longest row's.

    Rows are numbered by length over ranges of it; a batch is one task's bounded work.
    """
    kept = (length - length % multiple).cast("long")
    placed = numbered(rows.withColumn("kept", kept), ["kept", key], name="_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")
    return placed.withColumn("padded", F.max("kept").over(Window.partitionBy("batch")))


def collate(rows: DataFrame, values: str, mask: float = -100.0) -> DataFrame:
    """rows as of batches, with `labels`: the kept values, then the mask up to the batch's length, and `attention`, how many are kept."""
    own = F.slice(values, F.lit(1), F.col("kept").cast("int"))
    fill = F.array_repeat(F.lit(mask), (F.col("padded") - F.col("kept")).cast("int"))
    return rows.withColumn("labels", F.concat(own, fill)).withColumn("attention", F.col("kept"))

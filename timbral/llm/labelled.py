"""Bounded samples of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Characters of a labelled text that may serve as an example.
LONGEST = 200_000


def fold() -> F.Column:
    """crc32 of doc_id as text, mod 5; rows of fold 0 are held out. A null doc_id is in fold 1: its labels are never found."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(1))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled documents outside fold 0: those of least hash, so the same at every run.

    A document labelled more than once has its greatest label; null labels and null ids
    are passed over; of documents that share an id the least text is taken, so that rows are bounded too.
    Texts over LONGEST characters are no examples (they are scored like others). The
    sample of labels has a bounded size, so it is broadcast to the documents.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= LONGEST)
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))

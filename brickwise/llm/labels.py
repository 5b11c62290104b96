"""Labelled rows for the classifiers, in a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import text_or_empty


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: tuple[int, ...], most: int) -> DataFrame:
    """(pick, y, text) of at most `most` labelled documents outside the held folds: those whose ids have the
    smallest hashes. The sample is bounded by the parameter, so its ids may be broadcast. Rows with a null
    id or label teach nothing; of several labels of one document the largest counts, of several texts the smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("pick"), F.col(label).cast("int").alias("y")).dropna()
    known = known.where(~fold("pick", folds).isin(*held))
    known = known.groupBy("pick").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("pick"), "pick").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(sample), texts.doc_id == sample.pick)
    return found.groupBy("pick").agg(F.max("y").alias("y"), F.min("text").alias("text"))

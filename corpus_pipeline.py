"""The corpus pipeline: documents pass toxicity, near-duplicate, decontamination and secret stages and are encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.llm import decontaminate, secret_scan, sentencepiece_scan, simhash_dedup, toxicity
from brickwise.llm.common import columns_of, fresh, stage, table


def _mark():
    """With doc_id, what tells rows of a table apart; rows that agree in both are the same document."""
    return F.xxhash64("text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and mark stand in gone(doc_id, mark), a narrow table. Rows without an id stay."""
    mark, gone_id, gone_mark = (fresh(docs, n) for n in ("mark", "gone_id", "gone_mark"))
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    return docs.withColumn(mark, _mark()).join(gone, same, "left_anti").select(*columns_of(docs))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go. Null and empty texts are scored like any other."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxic")
    return toxicity.score(docs, model, name, with_text=True).where(F.col(name) < toxicity.THRESHOLD).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Rows without an id stay."""
    found = simhash_dedup.simhash_components(docs.select("doc_id", "text", _mark().alias("mark")), keep=("mark",))
    return _without(docs, found.where("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Rows without an id stay."""
    found = decontaminate.benchmark_leaks(docs.select("doc_id", "text", _mark().alias("mark")), table(spark, sf_dir, "benchmark"), keep=("mark",))
    return _without(docs, found)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced in the texts by a mark; widely copied examples stay, and so does every
    document. n_chars follows the text."""
    found = secret_scan.secret_scan(docs.select("doc_id", "text", "source", F.struct(*columns_of(docs)).alias("whole")), keep=("whole",))
    live = F.filter("found", lambda s: s["live"])
    own = F.col("whole")
    safe = secret_scan.redact(own["text"], live)
    new = {"text": F.when(F.col("n_live") > 0, safe).otherwise(own["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_live") > 0, F.length(safe).cast("long")).otherwise(own["n_chars"].cast("long"))
    return found.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every document that is left."""
    import public_tokenizers

    return sentencepiece_scan.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: Trees, fingerprints and piece encodings aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs

"""The training-data pipeline: named stages from raw documents to token ids.

Each stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns
of ``docs``, whatever these are besides ``doc_id``, ``text`` and ``source``. Stages work on all rows
that the one before kept. Null texts pass all stages but near-dedup, where texts without words
have the same (empty) shingle set and so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldstate.llm import bytebpe, linededup, mixing, simhash, toxicity
from worldstate.session import cut_lineage

ROWS_PER_FILE = 16_384
BATCH_ROWS = 1024


def _short_batches(spark: SparkSession) -> None:
    """Batches for Python are cut by rows; texts may be long, so a batch has fewer of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Learned from the labels of the folder."""
    _short_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a twentieth of a source's documents go; every document stays."""
    clean = linededup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the least key stays."""
    _short_batches(spark)
    return simhash.keep_unlike(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out file after file in the order of the mix."""
    return mixing.arranged(docs, ROWS_PER_FILE)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids, the character each token begins in, and the digest of the bytes decoded from the ids."""
    _short_batches(spark)
    coded = bytebpe.encode(docs, outputs=("ids", "starts", "decoded"))
    return coded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name)
    return docs

"""The corpus pipeline: documents are filtered, deduplicated, cleaned, mixed and packed.

Each stage reads what its predecessor kept, from Parquet. All but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import mixing, ngram_join, queries, secret_scan, shared, weak_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text, or one without words, is rejected; nulls elsewhere do not matter. Equal rows are judged alike and all stay or
    go. Columns keep their values whatever their names. An empty table stays empty.
    """
    shared.bounded_batches(spark)
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return weak_quality.classify(held).filter("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of the smallest id; ids that are null come last.

    Of equal rows one stays. Rows with different texts under one id are different documents. Documents without words are
    similar to nothing and stay. Columns keep their values whatever their names. An empty table stays empty.
    """
    shared.bounded_batches(spark)
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and ``n_chars`` is counted anew.

    A null text stays null, with a null count. Equal rows stay equal. All other columns are left as they are. An empty
    table stays empty.
    """
    shared.bounded_batches(spark)
    clean = secret_scan.redact(docs, *queries.rank_file())
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to twice.

    A null text has no words, a null source is a source of its own, null ids are documents of their own, and so are
    equal rows. Columns keep their values whatever their names. An empty table stays empty.
    """
    shared.bounded_batches(spark)
    return mixing.mixed_rows(docs, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null text is empty and one piece of the end id; a null id stays null; equal rows are pieces of their own. Further
    columns are ignored. An empty table gives no piece.
    """
    shared.bounded_batches(spark)
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]
#: Learned scores, links by similarity, random rounding and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage. Each reads whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import filter_audit, mixing, neighbours, ngram_join, packing, planes, prefix_trie, secret_scan, shared, token_counts, topk, url_rules, warc, weak_quality

Query = Callable[[SparkSession, str], DataFrame]


# Job parameters of the registered runs.
SEQUENCE = 2048
TOKEN_LIMIT = 512
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [5, 2, 1], 1.5, 2


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; every machine has the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20, scale=64)


def rank_file() -> tuple[str, str]:
    """A rank file and the pattern that goes with it."""
    import public_tokenizers

    return tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad if its label says poor quality or toxic."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad")
    )
    parts = url_rules.tokens(url_rules.host(F.col("url")), url_rules.path(F.col("url")))
    labelled = pages.select("page_id", parts.alias("tokens")).join(labels, "page_id")
    mined = url_rules.mine(labelled, min_support=0.01, min_confidence=0.6)
    return url_rules.judge(pages, mined, URL_RULES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), *rank_file())
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[secret_scan.count(spans, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.listed(spans, secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_quality.classify(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "votes", "posterior", "score", "keep")


def packed(docs: DataFrame) -> DataFrame:
    cut = packing.cut(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE)
    pieces = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, SEQUENCE)


def op5_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op6_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = shared.scratch(spark, "planes")
    manifest = planes.write(_table(spark, sf_dir, "documents"), directory, tokenizer_file("byte_bpe_50k.json"))
    return planes.read(manifest, directory).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = shared.scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), directory, least=1000, each_row=True)
    return warc.facts(warc.assemble(warc.read(spark, directory, payloads=False)))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_int8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.index(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def registered() -> dict[str, Query]:
    return {
        "op1_bit_sliced_topk": op1_bit_sliced_topk,
        "op2_url_rules": op2_url_rules,
        "op3_secret_scan": op3_secret_scan,
        "op4_weak_quality": op4_weak_quality,
        "op5_complement_packing": op5_complement_packing,
        "op6_plane_files": op6_plane_files,
        "op7_warc_transactions": op7_warc_transactions,
        "op8_ngram_join": op8_ngram_join,
        "op9_pivotal_mix": op9_pivotal_mix,
        "op10_int8_neighbours": op10_int8_neighbours,
        "op11_filter_shapley": op11_filter_shapley,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_prefix_counts": op13_prefix_counts,
    }

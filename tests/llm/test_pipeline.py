"""The registered queries and the pipeline on the smallest tables."""

import os
from collections import defaultdict

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from riffle.llm import mixing, ngram_join, oracle, queries, secret_scan, shared, weak_quality

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", oracle.sql())
def test_query_equals_its_sql(spark, name):
    assert compare(queries.registered()[name](spark, SF_DIR), connect(SF_DIR).sql(oracle.sql()[name])) == []


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op3_secret_scan", "op4_weak_quality", "op6_plane_files", "op8_ngram_join", "op9_pivotal_mix"):
        assert queries.registered()[name](spark, SF_DIR).select("doc_id").distinct().count() == docs, name


def test_stages_follow_each_other(spark):
    """Each stage against what its operator decides on the stage's own input, redone row by row."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(shared.stored(stage(spark, docs, SF_DIR), "stage"))
        docs = kept[-1]
    raw = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good, single, clean, mixed, packed = kept
    assert all(k.dtypes == raw.dtypes for k in kept[:-1])
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    texts = dict(rows(raw))
    labels = dict(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality").collect())
    stayed = {r["doc_id"] for r in good.collect()}
    assert all((d in stayed) == bool(q) for d, q in labels.items() if d in texts)
    sets = {d: set(ngram_join.grams(t.encode()).tolist()) for d, t in rows(good)}
    alone = {d for d, _ in rows(single)}
    for d, own in sets.items():
        others = [x for x in alone if x != d and own and 100 * len(own & sets[x]) >= 80 * len(own | sets[x])]
        assert not (d in alone and others)
        assert d in alone or ngram_join.join(good).filter(F.col("doc_id") == d).first()["component_id"] in alone
    encode = secret_scan.vocabulary(*queries.rank_file()).encode_ordinary
    assert dict(rows(clean)) == {d: secret_scan._redacted(t, encode, 1.9, "[SECRET]") for d, t in rows(single)}
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    times = defaultdict(int)
    for d, t in rows(mixed):
        times[d] += 1
        assert t == dict(rows(clean))[d]
    wanted = mixing.mix(clean, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST).collect()
    assert {r["doc_id"]: r["copies"] for r in wanted if r["copies"]} == times
    pieces = packed.collect()
    assert {(r["doc_id"]) for r in pieces} == set(times)
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= queries.SEQUENCE


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


SAID = "the river runs past the old mill and on to the sea where boats wait for the morning tide"


def test_nulls_repeats_and_clashing_names_pass_through_the_pipeline(spark):
    rows = [
        (1, None, None, None, None), (2, SAID, None, "a", 3), (None, SAID + " again", "en", None, None), (2, SAID, None, "a", 3),
        (2, "quite another text under the same id that nobody else has written down before today", "en", "a", None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, row int, mark string, copies int, _judged int"
    docs = spark.createDataFrame([(*r, -7.0, "mine", 1, "m", 5, 6) for r in rows], schema)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, SF_DIR), "stage")
        assert docs.schema.names == [c.split()[0] for c in schema.split(", ")]
        assert {tuple(r)[5:] for r in docs.collect()} <= {(-7.0, "mine", 1, "m", 5, 6)}
        kept.append(sorted((r["doc_id"] or -1, r["text"]) for r in docs.collect()))
    want = sorted((d or -1, t) for d, t, *_ in rows if t)
    assert kept[0] == want and kept[1] == kept[2] == sorted([want[1], want[2]] if want[1][1] != SAID + " again" else want[1:3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.count() == len(kept[3]) >= 2


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, SF_DIR), "stage")
        assert docs.count() == 0


def test_weak_labels_agree_with_the_scorer(spark):
    rows = weak_quality.classify(spark.read.parquet(f"{SF_DIR}/documents.parquet")).filter("posterior IS NOT NULL").collect()
    assert np.mean([(r["posterior"] >= 0.5) == r["keep"] for r in rows]) > 0.97

"""Stored prefix counts against the library's encoding of every prefix."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tokens import BYTE, TEXTS, odd_texts
from tokenizers import Tokenizer

from riffle.llm import queries, token_counts, token_ids

SCHEMA = "doc_id long, text string, n_tokens string, prefix_counts int"
LIBRARY = Tokenizer.from_file(BYTE)


def tokens(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def prefixes(text):
    return [tokens(text[:i]) for i in range(1, len(text) + 1)]


SPECIAL = [
    "", "a<|endoftext|>b <|endoftext|>  c", "  <|endoftext|>  x", "<|endoftext|", "<|endoftext|><|endoftext|>",
    "we've they'll 'restaurant  \n\n  don't ''s", " " * 40 + "x" + "\n" * 9 + "y", "日本語" * 10, "x" * 200, "a　　 b", "end   ",
]


def test_every_prefix_has_its_count():
    count = token_counts.Counter(BYTE)
    texts = SPECIAL + odd_texts(400, 30, 11)
    assert [list(token_counts.PrefixCounts(x)) for x in count.batch(texts)] == [prefixes(t) for t in texts]


def test_long_texts_go_part_by_part(monkeypatch):
    monkeypatch.setattr(token_ids, "LONG", 20)
    monkeypatch.setattr(token_counts, "GROUP", 100)
    monkeypatch.setattr(token_counts, "REMEMBERED", 200)
    monkeypatch.setattr(token_counts, "LONGEST", 5)
    count = token_counts.Counter(BYTE)
    texts = SPECIAL + odd_texts(60, 200, 12)
    assert [list(token_counts.PrefixCounts(x)) for x in count.batch(texts)] == [prefixes(t) for t in texts]


def test_a_token_counts_one():
    count = token_counts.Counter(BYTE)
    byte_of = {c: b for b, c in enumerate(token_ids.byte_alphabet())}
    words = [bytes(byte_of[c] for c in t) for t in LIBRARY.get_vocab() if t != "<|endoftext|>"]
    words = sorted(words, key=len, reverse=True)
    table = count._merges.table(words)
    assert all(table[len(w), i] == 1 for i, w in enumerate(words))


def test_questions_are_answered_from_the_stored_counts():
    count = token_counts.Counter(BYTE)
    for text in odd_texts(40, 60, 13):
        held, every = token_counts.PrefixCounts(count(text)), [0, *prefixes(text)]
        assert held.chars == len(text) and held.total == every[-1]
        assert [held.at(i) for i in range(-1, len(text) + 3)] == [0, *every, every[-1], every[-1]]
        for budget in range(-1, max(every) + 2):
            assert held.longest(budget) == max([i for i, c in enumerate(every) if c <= budget], default=0)


def test_counts_of_a_table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "a", "x", 1), (3, "a", "x", 1)]
    found = token_counts.index(spark.createDataFrame(rows, SCHEMA).repartition(3), BYTE).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(t or ""), tokens(t or "")) for i, t, *_ in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:4]) for r in found) == want
    assert all(r["n_tokens"] == token_counts.PrefixCounts(r["prefix_counts"]).total for r in found)
    assert token_counts.index(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_truncation(spark):
    rows = [(i, t, "keep", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, _id2 int")
    indexed = token_counts.index(docs, BYTE)
    cut = token_counts.truncated(docs, indexed, 7)
    assert cut.columns == docs.columns
    for r in cut.collect():
        text, kept = TEXTS[r["doc_id"]], r["text"]
        if text is None:
            assert kept is None
            continue
        assert text.startswith(kept) and tokens(kept) <= 7 and r["n_chars"] == "keep"
        assert all(tokens(text[:i]) > 7 for i in range(len(kept) + 1, min(len(text), len(kept) + 30) + 1))
    asked = indexed.select("doc_id", token_counts.prefix_tokens(F.col("prefix_counts"), F.lit(5)).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in asked} == {i: tokens((t or "")[:5]) for i, t in enumerate(TEXTS)}


def test_query_counts_like_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_prefix_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        text = d["text"] or ""
        n = tokens(text)
        assert got[d["doc_id"]] == (d["doc_id"], len(text.encode()), n, n > 512)
    assert len(got) == len(docs)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(queries.tokenizer_file("word_bpe_49k.json"))


def test_wide_differences_are_kept():
    steps = np.array([200, -150, 1], np.int32)
    held = token_counts.PrefixCounts(token_counts.pack([steps, np.array([1], np.int32)]))
    assert list(held) == [200, 50, 51, 52] and held.longest(51) == 3 and held.longest(10) == 0

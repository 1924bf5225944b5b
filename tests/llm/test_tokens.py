"""Token files and packing: round trips, exact packing, edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riffle.llm import packing, planes, queries, shared, token_ids

SCHEMA = "doc_id long, text string, ids string, size int, length int"
BYTE, WORD = (queries.tokenizer_file(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", None, " ", "a", "The the  end.\n\n It's 12 o'clock, WE'LL\tgo $$$ now", "naïve Ünïcode ß", "日本語 text 😀", "x" * 3000,
    "word " * 5000, "ends with space ", "<|endoftext|>", "a  <|endoftext|> b<|endoftext|", "<|startoftext|>X", "line\r\nline", "\x00\x01 control", "e\u0301 combining", "İ K ſ",
]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def encoded(path, text, end=0):
    tokenizer = Tokenizer.from_file(path)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


ALPHABET = [*"aBt's \n\t\r.,!19ÉßÀé日😀'd'llmvre$   ", "\u3000", "\u0301", "٠", "½", "ǅ", "\u200b", "\u180e", "\x85", "\x1c", "<|endoftext|>", "<|", "|>"]


def odd_texts(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    encode, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    every = ["a" + chr(i) + " 1" + chr(i) * 2 + " !" + chr(i) + "\n" + chr(i) for i in range(0, 0x3000, 11)]
    texts = [t or "" for t in TEXTS] + odd_texts(3000, 40, 3) + every
    assert [x.tolist() for x in encode.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_texts_are_encoded_whole(path, monkeypatch):
    monkeypatch.setattr(token_ids, "LONG", 50)
    monkeypatch.setattr(token_ids, "REMEMBERED", 20)
    encode, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    texts = odd_texts(100, 400, 4)
    assert [x.tolist() for x in encode.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(width, n):
    ids = np.random.default_rng(n).integers(0, 2**16, n).astype(np.uint32)
    made = planes.to_planes(ids, 16, width)
    assert (planes.from_planes([p.tobytes() for p in made], n, width) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50256), max_size=40), max_size=12), st.sampled_from([1, 8]), st.integers(1, 50))
def test_file_round_trip(documents, width, chunk):
    rows = [(i if i % 3 else None, np.array(d, "<u4").tobytes()) for i, d in enumerate(documents)]
    read = planes.PlaneFile(planes.encode_file(rows, 16, width, chunk, 3))
    assert [(d, ids) for d, _, ids in read] == rows
    assert [s for _, s, _ in read] == [sum(map(len, documents[:i])) for i in range(len(documents))]


@pytest.mark.parametrize("width", [1, 8])
def test_files_hold_all_ids_in_order(spark, width, monkeypatch):
    monkeypatch.setattr(planes, "PARTITION", 6000)
    directory = shared.scratch(spark, "planes")
    more = [(None, "no id", "x", 1, 2), (None, "no id", "x", 1, 2), (None, None, "x", 1, 2), (3, "same id", "x", 1, 2)]
    docs = documents(spark).unionByName(spark.createDataFrame(more, SCHEMA))
    manifest = planes.write(docs, directory, BYTE, width=width, chunk=100, file_ids=900)
    # What an attempt that did not count has left behind is not read.
    open(f"{directory.removeprefix('file:')}/ids-0000000-00000-9999.planes", "wb").close()
    rows = sorted(planes.read(manifest, directory).collect(), key=lambda r: r["start"])
    want = {i * 3: encoded(BYTE, t) for i, t in enumerate(TEXTS)}
    seen, start = defaultdict(list), 0
    for r in rows:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        seen[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
        start += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order[:-3]) + [None] * 3
    assert sorted(seen.pop(None)) == sorted([encoded(BYTE, "no id"), encoded(BYTE, "no id"), encoded(BYTE, "")])
    assert sorted(map(tuple, seen.pop(3))) == sorted([tuple(want.pop(3)), tuple(encoded(BYTE, "same id"))])
    assert {d: x[0] for d, x in seen.items()} == want
    assert manifest.count() > 1


def test_equal_rows_are_dealt_to_several_files(spark, monkeypatch):
    monkeypatch.setattr(planes, "PARTITION", 4000)
    directory = shared.scratch(spark, "planes")
    docs = spark.createDataFrame([(7, "the same words again and again")] * 900, "doc_id long, text string").repartition(4)
    manifest = planes.write(docs, directory, BYTE)
    assert planes.read(manifest, directory).count() == 900
    assert max(r["documents"] for r in manifest.collect()) < 300


def test_no_documents_no_files(spark):
    directory = shared.scratch(spark, "planes")
    assert planes.write(spark.createDataFrame([], SCHEMA), directory, BYTE).count() == 0


def check_packed(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(held)


def test_documents_are_cut_and_packed(spark):
    pieces = shared.stored(packing.cut(documents(spark), WORD, 64), "cut")
    whole = defaultdict(dict)
    for r in pieces.collect():
        assert r["length"] == len(r["ids"]) // 4 and r["start"] == 64 * r["piece"]
        whole[r["doc_id"]][r["piece"]] = r["ids"]
    for i, t in enumerate(TEXTS):
        ids = b"".join(whole[i * 3][k] for k in sorted(whole[i * 3]))
        assert np.frombuffer(ids, "<u4").tolist() == encoded(WORD, t)
    packed = packing.pack(pieces, 64).collect()
    assert len(packed) == pieces.count()
    check_packed(packed, 64)
    total = sum(r["length"] for r in packed)
    assert check_packed(packed, 64) == -(-total // 64)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight_and_complete(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = random.Random(seed)
    lengths = [min(100, int(rng.paretovariate(0.8) * 3)) for _ in range(1500)]
    df = spark.createDataFrame([(i, n, "old", 7, "hash") for i, n in enumerate(lengths)], "doc_id int, length int, offset string, size int, hash string")
    rows = packing.pack(df, 100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert {r["size"] for r in rows} == {7}
    assert check_packed(rows, 100) <= -(-sum(lengths) // 100) + 1


def test_plan_uses_exact_complements():
    assert packing.plan({60: 2, 40: 2}, 100) == [([60, 40], 2)]
    assert packing.plan({50: 1, 30: 1, 20: 1}, 100) == [([50, 30, 20], 1)]
    assert packing.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100) == [([40, 30, 20, 10], 1)]
    # Best fit where nothing closes the gap.
    assert packing.plan({70: 1, 20: 1, 15: 1}, 100) == [([70, 20], 1), ([15], 1)]
    assert packing.plan({}, 100) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece(counts):
    placed = defaultdict(int)
    for lengths, times in packing.plan(counts, 30):
        assert sum(lengths) <= 30
        for n in lengths:
            placed[n] += times
    assert placed == counts


def test_repeated_pieces_and_empty_tables(spark):
    schema = "doc_id long, length int"
    rows = packing.pack(spark.createDataFrame([(1, 40)] * 9, schema), 100).collect()
    assert check_packed(rows, 100) == 5 and len(rows) == 9
    assert packing.pack(spark.createDataFrame([], schema), 100).count() == 0


def test_equal_pieces_are_dealt_to_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    rows = packing.pack(spark.createDataFrame([(1, 30)] * 1000, "doc_id long, length int"), 100).collect()
    assert check_packed(rows, 100) == 334 and len(rows) == 1000


@pytest.mark.parametrize("bad", [None, 0, 101])
def test_impossible_lengths_are_an_error(spark, bad):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length int"), 100)

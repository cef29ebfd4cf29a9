"""Packing against the tokenizer, exhaustive search on small cases, and the laws of the result."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.text import as_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def whole_text_ids(text: str | None) -> list[int]:
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def fullest(lengths: list[int], capacity: int) -> int:
    return max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= capacity)


def test_combinations_are_the_fullest():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randint(5, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        left = list(lengths)
        for again, chosen in packing.fullest_combinations(counts, capacity):
            for _ in range(again):
                assert sum(n * t for n, t in chosen) == fullest(left, capacity)
                for n, t in chosen:
                    for _ in range(t):
                        left.remove(n)
        assert not left


def test_combinations_of_many_pieces_are_few():
    out = packing.fullest_combinations({n: 10**12 + n for n in range(1, 4097, 3)})
    assert sum(a * sum(n * t for n, t in c) for a, c in out) == sum(n * (10**12 + n) for n in range(1, 4097, 3)) and len(out) < 10_000
    assert packing.fullest_combinations({}) == []
    with pytest.raises(ValueError):
        packing.fullest_combinations({0: 1})


def check_laws(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_equals_whole_text_tokens(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = packing.op12_packing(spark, sf).collect()
    expected = {}
    for i, text in docs.items():
        ids = np.array(whole_text_ids(text), "<u4")
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == expected and len(out) == len(expected)
    assert check_laws(out, 4096) <= -(-sum(r.length for r in out) // 4096) + 1


ODD = [(1, "one two  three"), (1, "one two  three"), (2, None), (3, ""), (4, "Naïve café́ é ́x İstanbul ΣΑΣ it's <|endoftext|> we'll go　on\x85x 2024年 日本語\t\n"), (None, "a"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "😀" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def test_edges(spark, odd):
    wide = odd.withColumn("piece", F.lit("p")).withColumn("length", F.lit(3)).withColumn("part", F.lit(0)).withColumn("ahead", F.lit(1))
    out = packing.pack_documents(wide, with_ids=True)
    rows = out.collect()
    check_laws(rows, 4096)
    whole = sorted((tuple(whole_text_ids(t)), d or 0) for d, t in ODD)
    pieces = sorted(((r.doc_id or 0, r.piece, r.ids) for r in rows), key=lambda x: x[:2])
    joined = []
    for doc, group in itertools.groupby(pieces, key=lambda x: x[0]):
        group = list(group)
        repeats = sum(p == 0 for _, p, _ in group)
        for k in range(repeats):
            joined.append((tuple(itertools.chain.from_iterable(ids for _, _, ids in group[k::repeats])), doc))
    assert sorted(joined) == whole
    packed = packing.sequences(out).collect()
    assert sum(len(r.ids) for r in packed) == sum(len(i) for i, _ in whole) and all(sum(r.lengths) == len(r.ids) <= 4096 for r in packed)
    assert packing.pack_documents(odd.limit(0)).count() == 0
    small = packing.pack_documents(odd.where("doc_id = 1"), capacity=3).collect()
    assert [r.length for r in sorted(small, key=lambda r: r.piece)] == [3, 3, 1, 1] and check_laws(small, 3) == 3


def ids_of(words, texts):
    return [[*ids, 1] for ids in words.of_texts(*as_bytes(pa.array(texts, pa.string())))]


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "_KEPT", 3)
    words = packing.WordIds(PATH)
    texts = ["one two three four", "five six one two", "", "seven one"]
    for text in texts * 3:
        assert ids_of(words, [text]) == [whole_text_ids(text)]


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "_ROUND", 64)
    texts = ["it's a test " * 40, "short", "x" * 500 + " y", "", "é " * 100]
    assert ids_of(packing.WordIds(PATH), texts) == [whole_text_ids(t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abzAZ019 '-.\t\n", "'s", "'LL", "'re", "'V", "e", "'", "é", "E\u0301", "\u0301", "\u00a0", "İ", "Σ", "ß", "日", "😀", "\x00", "\x1c", "\x7f", "\x85", "<|endoftext|>", "</w>"]), max_size=30).map("".join), max_size=4))
def test_pieces_equal_whole_texts(texts):
    assert ids_of(packing._words_of(PATH), texts) == [whole_text_ids(t) for t in texts]


def test_rows_of_one_length_over_many_partitions(spark):
    docs = spark.range(5000, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit("same words again").alias("text"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    assert len(rows) == 5000 and check_laws(rows, 64) == -(-5000 // 16)

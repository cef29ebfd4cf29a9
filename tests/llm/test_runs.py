"""Periodic runs against a search by every period, and the edges of the operator."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs as runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def by_every_period(words: list, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """Maximal stretches of equal words q apart, for each q; a stretch counts if no smaller period has it."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, out = np.array([code[w] for w in words], np.int64), []
    for q in range(1, len(ids) // exponent + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = high - low + q
            part = ids[low : low + length]
            if length >= max(shortest, exponent * q) and not any((part[r:] == part[:-r]).all() for r in range(1, q)):
                out.append((low, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7), st.integers(0, 40), st.sampled_from([2, 3, 4]), st.sampled_from([2, 5, 6]))
def test_runs_equal_every_period(word, period, tail, exponent, shortest):
    words = word + [word[-period:][i % len(word[-period:])] for i in range(tail)] if word else word
    ids = np.array([-1, *words, 99], np.int64)
    found = [(a - 1, n, q) for a, n, q in runs.runs_of(ids, shortest, exponent).tolist()]
    assert found == by_every_period(words, shortest, exponent)


def test_classes_stay_ordered():
    rng = np.random.default_rng(3)
    order = rng.permutation(5000).tolist()
    held = runs.Positions(order[0])
    for i, at in enumerate(order[1:300], 1):
        before, after = held.insert(at)
        known = order[:i]
        assert before == max((k for k in known if k < at), default=-1) and after == min((k for k in known if k > at), default=-1)
    for at in order[300:]:
        held.insert(at)
    assert list(held) == list(range(5000)) and max(map(len, held.lists)) <= 512


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = runs.op11_periodic_runs(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    seen = 0
    for r in out:
        words, h = SPACE.findall(docs[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        expected = by_every_period(words, 6, 4)
        seen += bool(expected)
        assert r.n_runs == len(expected)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in expected).encode()).hexdigest()
        dropped = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
        best = max(expected, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert seen > 5


@pytest.fixture(scope="module")
def odd(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, "a b " * 4), (1, "a b " * 4), (2, None), (3, ""), (4, long), (None, "x x x x x x x"), (5, " \t\n "), (6, "A a A a A a A a"), (7, "é é " * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edges(spark, odd):
    wide = odd.withColumn("runs", F.lit("r")).withColumn("found", F.lit(1)).withColumn("start", F.lit(2))
    out = wide.withColumn("got", runs.periodic_runs(F.col("text"))).collect()
    of = {(r.doc_id, r.text): [tuple(x) for x in r.got.runs] for r in out}
    assert len(out) == 9 and all((r.runs, r.found, r.start) == ("r", 1, 2) for r in out)
    assert of[(1, "a b " * 4)] == [(0, 8, 2)] and of[(2, None)] == of[(3, "")] == of[(5, " \t\n ")] == []
    assert of[(None, "x x x x x x x")] == [(0, 7, 1)] and of[(6, "A a A a A a A a")] == [(0, 8, 2)] and of[(7, "é é " * 6)] == [(0, 6, 1)]
    long = next(r for r in out if r.doc_id == 4)
    assert [tuple(x) for x in long.got.runs] == [(0, 100_000, 5)] and long.got.collapsed == "lorem ipsum dolor sit amet"
    assert next(r for r in out if r.doc_id == 2).got.collapsed == ""
    assert odd.limit(0).withColumn("got", runs.periodic_runs(F.col("text"))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(F.col("text"), exponent=1)


def test_query_edges(spark, odd, tmp_path):
    odd.withColumn("n_runs", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    out = runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == 9 and all(r.runs_sha256 and r.collapsed_sha256 for r in out)
    assert {r.n_runs for r in out if r.doc_id in (2, 3, 5)} == {0} and {r.start for r in out if r.doc_id == 2} == {None}


def test_long_texts_come_in_lists(monkeypatch):
    monkeypatch.setattr(runs, "RUN_BYTES", 16)
    raw = b"one two  three\tfour five " * 30
    assert [w for part in runs.word_lists(raw) for w in part] == raw.split()
    found = runs.runs_of(np.array([-1, *[i % 5 for i in range(150)], 99]), 6, 4) - [1, 0, 0]
    assert runs.collapsed(raw, found) == b"one two three four five" and runs.collapsed(raw, found[:0]) == b" ".join(raw.split())

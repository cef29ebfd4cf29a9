"""Source divergence against plain Python, its buckets and its edges; the whole query is held against SQL in test_brute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import term_divergence as terms
from tidemark.llm.text import as_bytes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def found(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, min_docs=10, top=10):
    count, held, groups, kept = defaultdict(Counter), defaultdict(Counter), defaultdict(set), {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(found(text))
        held[lang].update(set(found(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB é日😀_1 ."), max_size=80), min_size=1, max_size=12), st.integers(1, 3))
def test_counts_equal_plain_python(texts, n_groups):
    group = np.sort(np.arange(len(texts)) % n_groups)
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    n, docs = Counter(), Counter()
    for words, of, count, held in terms.term_counts(data, offsets, group):
        for w, g, c, h in zip(words.to_pylist(), of.tolist(), count.tolist(), held.tolist(), strict=True):
            n[w, g] += c
            docs[w, g] += h
    assert n == Counter((w, int(g)) for t, g in zip(texts, group, strict=True) for w in found(t))
    assert docs == Counter((w, int(g)) for t, g in zip(texts, group, strict=True) for w in set(found(t)))


@pytest.mark.parametrize("length", range(1, 17))
def test_radix_order(length):
    rng = np.random.default_rng(length)
    letters = np.zeros((500, 16), np.uint8)
    letters[:, :length] = rng.integers(97, 100, (500, length))
    words = letters.view(">u8").astype(np.uint64)
    order = terms.radix_order(words[:, 0], words[:, 1] if length > 8 else None, length)
    plain = [bytes(r) for r in letters]
    assert order.tolist() == sorted(range(500), key=lambda i: plain[i])


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(terms, "GROUP_BYTES", 64)
    text = "alpha beta gamma " * 40 + "x" * 500 + " alpha " + "é" * 200
    data, offsets = as_bytes(pa.array([text, "beta"]))
    n, docs = Counter(), Counter()
    for words, of, count, held in terms.term_counts(data, offsets, np.array([0, 1])):
        for w, g, c, h in zip(words.to_pylist(), of.tolist(), count.tolist(), held.tolist(), strict=True):
            n[w, g] += c
            docs[w, g] += h
    assert n == Counter((w, g) for t, g in ((text, 0), ("beta", 1)) for w in found(t)) and set(docs.values()) == {1}


def test_edges(spark):
    rows = [("en", "a", "Foo bar foo"), ("en", "a", "Foo bar foo"), ("en", None, "foo baz"), ("en", "b", None), ("en", "c", "baz " * 20_000), (None, "a", "foo"), (None, "", "é É e"), ("xx", "only", "word"), ("yy", "a", "123"), ("yy", "b", ""), ("en", "a", "w" * 3000 + " bar")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, n int")
    clash = docs.withColumn("term", F.lit("t")).withColumn("p", F.lit(1)).withColumn("block", F.lit(2)).withColumn("docs", F.lit(0))
    for least in (1, 2, 3):
        assert got(terms.source_divergence(clash, min_docs=least)) == expected(rows, least)
    assert terms.source_divergence(docs.limit(0)).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(terms, "CELLS", 30)
    rng = np.random.default_rng(1)
    rows = [("en" if i % 3 else "fr", f"s{rng.integers(4)}", " ".join(f"w{'abcdefghij'[k]}{'abcdefgh'[j]}" for k, j in rng.integers(0, 8, (30, 2)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(terms.source_divergence(docs, min_docs=5, top=3)) == expected(rows, 5, 3)


def test_large_counts_stay_exact(spark):
    one = spark.createDataFrame([(30_000_000_000_000, 70_000_000_000_007, 12_345)], "n long, total long, terms long")
    n, total, v = one.first()
    assert one.select(terms._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)

"""Whole queries against plain Python on the small tables, and held-out accuracy where a model decides."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.llm import jaccard_join, language, mixing, sharding, toxicity
from tidemark.llm.registry import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(spark, QUERIES[name], SQL[name], sf)


def test_op1_equals_the_article_element(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op1_html_text"](spark, sf).collect()
    assert {r.page_id for r in out} == set(pages)
    for r in out:
        inner = pages[r.page_id].split("<article>", 1)[1].rsplit("</article>", 1)[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op2_accuracy(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op2_language"](spark, sf).collect()
    assert len(out) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op2_distance_by_hand():
    profiles = language.Profiles([("a", ord("x"), 0), ("a", ord("y"), 1), ("b", ord("y"), 0), ("b", ord("x"), 1)])
    lang, score = profiles.predict("xxxx yyy")
    assert lang == "a" and 0.5 < score <= 1


def test_op2_equals_brute_force(spark, sf):
    """Profiles, ranks and distances in plain Python over whole texts."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}

    def grams(text):
        folded = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "") + " "
        one = re.sub(" +", " ", folded)
        if not one.strip():
            return Counter()
        return Counter([c for c in one if c != " "] + [one[i : i + n] for n in (2, 3) for i in range(len(one) - n + 1)])

    def code(gram):
        out = 0
        for c in gram:
            out = (out << 21) | ord(c)
        return out

    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language.PROFILE]]
    total = defaultdict(Counter)
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 4 != 2 and r.text is not None and r.lang is not None:
            total[r.lang].update(grams(r.text))
    profiles = {k: {g: n for n, g in enumerate(top(c))} for k, c in sorted(total.items())}
    for r in QUERIES["op2_language"](spark, sf).collect():
        own = top(grams(rows[r.doc_id].text))
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        alike = {k: 1 - sum(abs(p[g] - n) if g in p else language.PROFILE for n, g in enumerate(own)) / (language.PROFILE * len(own)) for k, p in profiles.items()}
        best = max(alike, key=lambda k: alike[k])
        assert r.lang_pred == best and abs(r.score - alike[best] / sum(alike.values())) < 1e-9


def test_op3_equals_brute_force(spark, sf):
    """The same projected steps over all rows at once, and targets met within the stated tolerance."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classifier = mixing.fit_classifier(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    members = mixing.membership(docs, classifier).cache()
    steps, goal, expected = mixing.fit_rates(members, classifier.domains)
    assert np.abs(goal - expected).max() <= 10 * mixing.NEAR * goal.sum()
    given = {r.doc_id: (r.n_tokens, np.array(r.posterior)) for r in members.collect()}
    ids = sorted(given)
    tokens, p = np.array([given[i][0] for i in ids], float), np.stack([given[i][1] for i in ids])
    metric = np.linalg.pinv(p.T @ (p * tokens[:, None]) + 1e-9 * np.trace(p.T @ (p * tokens[:, None])) / p.shape[1] * np.eye(p.shape[1]))
    rate = np.ones(len(ids))
    for _ in steps:
        rate = np.maximum(0, rate - p @ (metric @ (p.T @ (tokens * rate) - goal)))
    out = {r.doc_id: r for r in mixing.rated(members, classifier.domains, steps, goal, expected).collect()}
    assert np.allclose([out[i].rate for i in ids], rate, atol=1e-6)
    assert all(out[i].domain == classifier.domains[int(p[n].argmax())] and abs(out[i].target_tokens - goal[p[n].argmax()]) < 1e-6 and int(rate[n] + 1e-9) <= out[i].copies <= int(rate[n] + 1) for n, i in enumerate(ids))
    members.unpersist()


def test_op3_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classifier = mixing.fit_classifier(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    members = mixing.membership(docs, classifier).cache()
    targets = {d: i + 1.0 for i, d in enumerate(classifier.domains)}
    steps, goal, expected = mixing.fit_rates(members, classifier.domains, targets)
    assert np.abs(goal - expected).max() < 0.02 * goal.sum()
    p = np.array([r.posterior for r in members.select("posterior").collect()])
    rates = mixing.rates_of(p, steps)
    assert rates.min() >= 0
    total = (rates * np.array([r.n_tokens for r in members.select("n_tokens").collect()])) @ p
    assert np.allclose(total, expected)
    members.unpersist()


def test_op4_equals_brute_force(spark, sf, texts):
    sets = {}
    for i, text in texts.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    index, overlap, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for shingle in sets[i]:
            overlap.update((j, i) for j in index[shingle])
            index[shingle].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in overlap.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, sf).collect()}
    assert out == {i: (len(s), find(i)) for i, s in sets.items()}


def test_op4_parts_of_a_large_block(spark, monkeypatch):
    """Blocks cut into parts find the same links as whole ones."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:50] + [f"x{k}y{j}" for j in range(k % 7)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == whole == {k: 0 for k in range(60)}


def test_op4_large_blocks_of_several_groups(spark, monkeypatch):
    """A block of a common first passage that holds groups, chains between groups and single texts equals brute force."""
    rng, common, rows = np.random.default_rng(3), [f"c{i}" for i in range(12)], []
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(30, 60)))]
        for k in range(18):
            text = list(base)
            for j in rng.integers(0, len(base), k % 4):
                text[j] = f"g{g}k{k}"
            rows.append((len(rows), " ".join(common + text)))
    rows += [(len(rows) + k, " ".join(common + [f"s{k}x{j}" for j in range(3 + k % 9)])) for k in range(40)]
    chain = [f"h{i}" for i in range(40)]
    rows += [(len(rows) + k, " ".join(common + chain[k:])) for k in range(20)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "REPRESENTATIVES", 2)
    # One block of everything, as a passage that all texts begin with would make.
    one = spark.createDataFrame([(0, i) for i in range(1, len(rows))], "pivot long, member long")
    real = jaccard_join._members
    monkeypatch.setattr(jaccard_join, "_members", lambda pairs: real(one))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == label
    assert 5 < len(set(label.values())) < len(rows)


def test_op4_tree_search_equals_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        core = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        sets += [np.unique(np.concatenate([core[: 200 - k], rng.integers(1, 1 << 62, k, dtype=np.uint64)])) for k in rng.integers(0, 60, 4)]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.RTree(np.stack([jaccard_join.point_of(s, 32) for s in sets]), sizes)
    for i in range(len(sets)):
        open_ = np.ones(len(sets), bool)
        open_[i] = False
        near = set(tree.search(jaccard_join.point_of(sets[i], 32), int(sizes[i]), open_).tolist())
        assert {j for j in range(len(sets)) if j != i and jaccard_join.linked(sets[i], sets[j])} <= near


def test_op5_equals_brute_force(spark, sf, texts):
    tokens = {i: [*words(t), "\0end"] for i, t in texts.items()}
    count = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    out = QUERIES["op5_language_model"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(base - r.base_score) <= 1e-8 * abs(base) and r.train_tokens == n
        assert r.n_tokens == len(tokens[r.doc_id]) and r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op5_automaton(spark, monkeypatch):
    """The automata that the query's own buckets build: every state's probabilities add up to one, and the state that is carried
    is the longest counted history of two tokens; stretches change nothing."""
    from tidemark.llm import language_model as m

    rng = np.random.default_rng(2)
    texts = ["", "a", *[" ".join(rng.choice(list("abcde"), rng.integers(0, 40), p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(30)]]
    rows = [(i, i % 5 == 4, t) for i, t in enumerate(texts)]
    count = Counter(g for _, held, t in rows if not held for w in [["\0", *t.split(), "\0"]] for n in (1, 2) for g in zip(*[w[i:] for i in range(n)], strict=False))
    table = m._pack_rows(pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows]) for k in range(3)]], ["bucket", "doc_id", "held_out", "text"]))
    asked = m._requests(pa.Table.from_batches([table]), m._bounds(2))
    told = pa.concat_tables(m._answers(asked.filter(pc.equal(asked["range"], r))) for r in sorted(set(asked["range"].to_pylist())))
    built, steps = [], []
    init, step = m.Backoff.__init__, m.Backoff.step
    monkeypatch.setattr(m.Backoff, "__init__", lambda self, *x: (init(self, *x), built.append(self))[0])
    monkeypatch.setattr(m.Backoff, "step", lambda self, s, t: (steps.append((s.copy(), t.copy())), step(self, s, t))[1])
    train = [t.split() for _, held, t in rows if not held]
    known, tokens = len({w for t in train for w in t}), sum(map(len, train))
    scores = m._scores(pa.Table.from_batches([table]), told, known, tokens, len(train))["score"].to_pylist()
    (automaton,) = built
    every = np.arange(automaton.tokens)
    reached = np.unique(np.concatenate([s for s, _ in steps]))
    assert len(reached) > 20
    for state in reached:
        weights, after = step(automaton, np.full(len(every), state), every)
        # All words of the training texts are in the bucket; one unseen word more makes the sum of the base model one.
        unseen = m.ADDED / (tokens + len(train) + m.ADDED * (known + 2))
        lost = unseen * 10 ** sum(automaton.fail_weight[s] for s in _failures(automaton, state))
        assert abs((10**weights).sum() + lost - 1) < 1e-9
    assert len(steps) == max(len(t.split()) + 1 for t in texts) + 2
    monkeypatch.setattr(m, "STRETCH", 7)
    again = m._scores(pa.Table.from_batches([table]), told, known, tokens, len(train))["score"].to_pylist()
    assert np.allclose(scores, again, rtol=1e-12) and count["a", "b"] > 0


def _failures(automaton, state):
    while state:
        yield state
        state = automaton.fail[state]


def test_op5_counts_all_ngrams(spark):
    """More kinds of words than any fixed table, every trigram and failure by hand; the order of rare words matters."""
    from tidemark.llm import language_model as m

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 1500, rng.integers(0, 60))) for _ in range(300)]
    texts = [*texts, texts[0], texts[1]]
    swapped = " ".join(reversed(texts[1].split()))
    rows = [(i, i % 7 == 3, t) for i, t in enumerate(texts)] + [(900, True, texts[1]), (901, True, swapped)]
    count = Counter()
    for _, held, t in rows:
        w = ["\0", *t.split(), "\0"]
        if not held:
            count.update((x,) for x in w[1:])
            count.update(tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    got = {r.doc_id: r.score for r in m.score_texts(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")).collect()}
    for i, _, t in rows:
        w, total = ["\0", *t.split(), "\0"], 0.0
        for k in range(1, len(w)):
            p = (count[w[k],] + m.ADDED) / (n + m.ADDED * (v + 1))
            for order in range(2, min(m.ORDER, k + 1) + 1):
                p = (count[tuple(w[k - order + 1 : k + 1])] + m.PRIOR * p) / (count[tuple(w[k - order + 1 : k])] + m.PRIOR)
            total += math.log10(p)
        assert abs(total - got[i]) < 1e-8 * (1 + abs(total)), i
    assert got[900] > got[901] + 1


def test_op7_accuracy(spark, sf):
    """Planted words of two kinds in clean texts; the model never sees the held-out ones' labels."""
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu") for b in ("ran", "tos", "vel", "win", "zar", "pem")]
    rows = []
    for i in range(1500):
        w = list(rng.choice(vocabulary, rng.integers(5, 60)))
        toxic = i % 8 == 0
        for _ in range(3 * toxic):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["nasty", "awful", "grubon", "grubish"])))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", "toxic"))
    scored = {r.doc_id: r.score >= toxicity.CUT for r in toxicity.score(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(scored[r[0]] for r in held if r[2]) >= 0.9 * sum(r[2] for r in held)
    assert sum(scored[r[0]] for r in held if not r[2]) <= 0.03 * len(held)


def test_op7_risk_and_scores():
    """The fit is a minimum of the written-out risk, and a score is the sum over a text's distinct features."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    with_bias = lambda x: np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    positive, unlabelled = with_bias(rng.random((300, 5)) < [0.6, 0.5, 0.4, 0.5, 0.5]), with_bias(rng.random((900, 5)) < [0.5, 0.5, 0.45, 0.5, 0.5])
    prior, sparsity = 0.2, 1e-3
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, prior, sparsity)

    def risk(w):
        loss = lambda z: sum(math.log1p(math.exp(-v)) for v in z) / len(z)
        zp, zu = positive @ w, unlabelled @ w
        return prior * loss(zp) + max(0.0, loss(-zu) - prior * loss(-zp)) + sparsity * np.abs(w[:-1]).sum()

    best = np.append(weights, bias)
    # Where the negatives' corrected risk is above zero the estimator is an ordinary minimum.
    assert np.logaddexp(0, unlabelled @ best).mean() > prior * np.logaddexp(0, positive @ best).mean()
    assert all(risk(best) <= risk(best + d) + 1e-6 for d in rng.normal(scale=0.05, size=(40, 6)))
    texts = ["awful grubon words grubon", "plain", "", None, "AWFUL awfully " * 3]
    features = lambda t: {int(f) for _, _, _, found in toxicity.present(pa.array([t])) for f in found}
    single = {t: set().union(*[features(w) for w in (t or "").split()]) if t else set() for t in texts}
    known = sorted(features("awful") | features("grubon"))
    model = toxicity.Model(np.array(known), np.linspace(-1, 2, len(known)), -0.5)
    expected = [1 / (1 + math.exp(0.5 - sum(model.table[f] for f in single[t]))) for t in texts]
    assert np.allclose(model.scores(pa.array(texts, pa.string())), expected)


def test_op9_contract(spark, sf, texts):
    out = QUERIES["op9_sharding"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def jump(key: int, shards: int) -> int:
    place, after = -1, 0
    while after < shards:
        place = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = int((place + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return place


def test_op9_hash_equals_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_shards(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_op10_edits(spark, sf, texts):
    out = {r.doc_id: r for r in QUERIES["op10_fingerprint"](spark, sf).collect()}
    ids = sorted(texts)
    assert set(out) == set(ids)
    for at, i in enumerate(ids):
        text, following = texts[i], texts[ids[(at + 1) % len(ids)]]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text)
    same = defaultdict(set)
    for i in ids:
        same[texts[i]].add(out[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert sum(r.near_edited for r in out.values()) / len(out) > 0.35 > 0.05 > sum(r.near_next for r in out.values()) / len(out)


def test_op10_equals_brute_force(spark):
    """The signatures of k-mers numbered by occurrence, from Spark's own hashes."""
    from tidemark.llm import fingerprint as f

    texts = ["a b c a b c a b c d", "x " * 30, "one two three four five six seven", "aaaaaaaaaaaaaaaaaaaaaaaa b", "b a b a b a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(f.signatures(F.col("t")).alias("s")).collect()]
    assert len(got[1]) == 29 and len(set(got[1])) == 29  # repeats count each time
    assert got[0] != got[4] and all(len(s) >= 1 for s in got)
    again = [r.s for r in df.select(f.signatures(F.concat(F.col("t"), F.lit(""))).alias("s")).collect()]
    assert again == got


def test_op10_order_matters(spark):
    from tidemark.llm import fingerprint as f

    w = [f"word{i}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[20:] + w[:20]), " ".join(w[:39] + ["new"]))], "a string, b string, c string")
    r = df.select(f.likeness(f.signatures(F.col("a")), f.signatures(F.col("c"))).alias("near"), f.likeness(f.signatures(F.col("a")), f.signatures(F.lit("nothing alike in this one"))).alias("far")).first()
    assert r.near > 0.8 and r.far == 0


def test_op10_signatures_in_plain_python(spark):
    """Pieces, numbering, selection and order in Python; Spark only hashes single tuples."""
    from tidemark.llm import fingerprint as f

    rng = np.random.default_rng(6)
    han = "".join(map(chr, rng.integers(0x4E00, 0x4E40, 300)))
    texts = ["a b c a b c a b c d", "x " * 30, "one two three fourteenth fourteenth fourteenth", "ab" * 60, han, "b", "", " ".join(f"w{i}" for i in rng.integers(0, 30, 200))]

    def hashes(kind, function, tuples):
        names = "abc"[: len(tuples[0])]
        df = spark.createDataFrame([(i, *t) for i, t in enumerate(tuples)], "i long, " + ", ".join(f"{c} {k}" for c, k in zip(names, kind, strict=True)))
        return {tuples[r.i]: r.h for r in df.select("i", function(*names).alias("h")).collect()}

    keys = {}
    for t in texts:
        pieces = [p for run in re.findall(r"[^ ]+", t) for p in ([run] if len(run) <= f.PIECE else run)]
        keys[t] = [tuple([*pieces, None, None][i : i + f.KMER]) for i in range(len(pieces))]
    first = hashes(["string"] * 3, F.xxhash64, sorted({k for ks in keys.values() for k in ks}, key=str))
    bits = f._POSITION_BITS
    again = hashes(["long", "int"], F.xxhash64, sorted({(first[k] >> bits, n) for ks in keys.values() for k in set(ks) for n in range(2, ks.count(k) + 1)}))
    chosen = {}
    for t, ks in keys.items():
        times, rows = Counter(), []
        for i, k in enumerate(ks):
            times[first[k] >> bits] += 1
            n = times[first[k] >> bits]
            rows.append(((first[k] >> bits) if n == 1 else again[first[k] >> bits, n] >> bits, i))
        kept = [h % (1 << (64 - bits)) for h, _ in sorted(sorted(rows)[: f.SELECTED], key=lambda r: r[1])]
        chosen[t] = [(x, y) for x, y in zip(kept, [*kept[1:], None], strict=False)][: max(len(kept) - 1, min(len(kept), 1))]
    paired = hashes(["long", "long"], F.hash, sorted({p for c in chosen.values() for p in c}, key=str))
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", f.signatures(F.col("t")).alias("s")).collect()}
    assert got == {t: [paired[p] for p in chosen[t]] for t in texts}


def test_op10_insertions_do_not_shift(spark):
    """One character more near the start of text without ASCII spaces; and the same k-mers in another order."""
    from tidemark.llm import fingerprint as f

    rng = np.random.default_rng(8)
    han = "".join(map(chr, rng.integers(0x4E00, 0x8000, 900)))
    wide = "\u3000".join(han[i : i + 4] for i in range(0, 900, 4))
    code = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 2000))
    blocks = [" ".join(f"w{6 * i + j}" for j in range(6)) for i in range(60)]
    pairs = [(t, t[:5] + "q" + t[5:]) for t in (han, wide, code, wide.replace("\u3000", "\xa0"))] + [(" ".join(blocks), " ".join(blocks[i] for i in rng.permutation(60)))]
    df = spark.createDataFrame(pairs, "a string, b string").select(f.likeness(f.signatures(F.col("a")), f.signatures(F.col("b"))).alias("x"))
    *shifted, reordered = [r.x for r in df.collect()]
    assert min(shifted) > 0.7 and reordered < 0.5, (shifted, reordered)

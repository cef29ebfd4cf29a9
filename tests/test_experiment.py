"""The matched experiment against numpy: states step by step, both ways to solve the ridge, waiting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, graph

NODES, PER_EPISODE = 12, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a in range(NODES) for b in range(NODES) if a != b and rng.random() < 0.25]
    edges = [(k, a, b, float(rng.random()), int(rng.choice([-1, 1]))) for k, (a, b) in enumerate(pairs)]
    samples = [(s, s // PER_EPISODE, 100 - s if s == 4 else s, float(rng.normal()), "train" if s % 4 else ("test" if s % 8 else "validation")) for s in range(21)]
    inputs = [(s, int(node), float(rng.normal())) for s in range(21) for node in rng.choice([0, 1, 2, 3, 99], 2, replace=False)]
    schema = "sample_id long, episode_id long, observed_us long, target double, partition string"
    frames = spark.createDataFrame(edges, "ordinal long, src long, dst long, weight double, sign int"), spark.createDataFrame(samples, schema), spark.createDataFrame(inputs, "sample_id long, node long, input double")
    return edges, samples, inputs, frames


def states(edges, samples, inputs, decay=0.9, scale=1.0):
    w = np.zeros((NODES, NODES))
    for _, a, b, weight, sign in edges:
        w[b, a] += weight * sign
    out, now, episode = {}, None, None
    for s, e, *_ in sorted(samples, key=lambda r: (r[1], r[2], r[0])):
        if e != episode:
            now, episode = np.zeros(NODES), e
        drive = np.zeros(NODES)
        for sample, node, x in inputs:
            if sample == s and node < NODES:
                drive[node] += scale * x
        now = decay * now + (1 - decay) * np.tanh(w @ now + drive)
        out[s] = now
    return np.array([out[s] for s in sorted(out)])


def ridge(x, y, train, l2=1.0):
    means, target = x[train].mean(0), y[train].mean()
    c = x[train] - means
    w = np.linalg.solve(c.T @ c + l2 * np.eye(x.shape[1]), c.T @ (y[train] - target))
    return target + (x - means) @ w


def test_states_equal_numpy(spark, data):
    edges, samples, inputs, (e, s, i) = data
    from pyspark.sql import Window

    placed = s.withColumn("place", F.row_number().over(Window.partitionBy("episode_id").orderBy("observed_us", "sample_id")) - 1)
    got = np.zeros((21, NODES))
    for r in experiment.encode(e, placed.select("sample_id", "episode_id", "place"), i, 0.9, 1.0).collect():
        got[r.sample_id, r.node] = r.value
    assert np.allclose(got, states(edges, samples, inputs), atol=1e-12)


def test_experiment_equals_numpy(spark, data):
    edges, samples, inputs, (e, s, i) = data
    metrics, predictions = experiment.run_experiment(e, s, i)
    mae = {r.model: r.mae for r in metrics.collect()}
    assert list(mae) == ["graph", "shuffled_wiring", "random_weights", "no_state", "ordinary"]
    y, train = np.array([r[3] for r in samples]), np.array([r[4] == "train" for r in samples])
    shuffled = [tuple(r) for r in graph.shuffled_targets(e, 7).select("ordinal", "src", "dst", "weight", "sign").collect()]
    weighted = [tuple(r) for r in graph.random_weights(e, 7).select("ordinal", "src", "dst", "weight", "sign").collect()]
    names = sorted({n for _, n, _ in inputs})
    x = np.zeros((21, len(names)))
    for sample, node, v in inputs:
        x[sample, names.index(node)] += v
    features = {"graph": states(edges, samples, inputs), "shuffled_wiring": states(shuffled, samples, inputs), "random_weights": states(weighted, samples, inputs), "no_state": x, "ordinary": (x.sum(1) / 2)[:, None]}
    for name, f in features.items():
        expected = ridge(f, y, train)
        assert abs(mae[name] - np.abs(expected - y)[~train].mean()) < 1e-9
        got = {r.sample_id: r.predicted for r in predictions.where(F.col("model") == name).collect()}
        assert set(got) == set(np.flatnonzero(~train)) and np.allclose([got[k] for k in sorted(got)], expected[~train], atol=1e-9)


def test_both_solvers_agree(spark, monkeypatch):
    monkeypatch.setattr(experiment, "TILE", 7)
    rng = np.random.default_rng(3)
    n, width = 25, 60
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.5)
    y, train = rng.normal(size=n), np.arange(n) % 3 > 0
    rows = [(int(i), int(k), float(x[i, k])) for i, k in zip(*np.nonzero(x), strict=True)]
    df = spark.createDataFrame(rows, "i long, node long, value double").cache()
    assert np.allclose(experiment.inner_products(df, n), x @ x.T)
    expected = ridge(x, y, train, 2.0)
    assert np.allclose(experiment.ridge_predictions(df, y, train, 2.0, dense=True), expected)
    assert np.allclose(experiment.ridge_predictions(df, y, train, 2.0, dense=False), expected, atol=1e-6)


def test_waiting(spark, data):
    *_, (e, s, i) = data
    metrics, predictions = experiment.run_experiment(e, s.where("sample_id in (1, 2)"), i)
    (row,) = metrics.collect()
    assert (row.status, row.model, row.mae) == ("waiting", None, None) and row.reasons == ["insufficient_qualified_train_examples", "no_heldout_examples"] and predictions.count() == 0
    (row,) = experiment.run_experiment(e, s.where("sample_id % 4 > 0"), i)[0].collect()
    assert row.reasons == ["no_heldout_examples"]


def test_edges_that_carry_nothing_are_left_out_of_the_rounds(spark, data, monkeypatch):
    _, _, _, (e, s, i) = data
    lonely = e.unionByName(spark.range(1000, 3000).select(F.col("id").alias("ordinal"), F.col("id").alias("src"), (F.col("id") % NODES).alias("dst"), F.lit(0.5).alias("weight"), F.lit(1).alias("sign")))
    sizes = {}
    monkeypatch.setattr(experiment, "cut", lambda df, name, old=experiment.cut: sizes.setdefault(name, old(df, name)))
    experiment.encode(lonely, s.select("sample_id", "episode_id", F.lit(0).alias("place")), i, 0.9, 1.0)
    assert sizes["edges"].count() == e.count()


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_longer_episodes_take_no_more_jobs(spark, data):
    _, _, _, (e, s, i) = data
    short = s.select("sample_id", (F.col("sample_id") * 1).alias("episode_id"), F.lit(0).alias("place"))
    long = s.select("sample_id", F.lit(0).alias("episode_id"), F.col("sample_id").cast("int").alias("place"))
    took = [jobs(spark, f"states {k}", lambda df=df: experiment.encode(e, df, i, 0.9, 1.0).collect()) for k, df in enumerate((short, long))]
    assert took[0] == took[1] > 0


def test_few_nodes_need_no_iterations(spark, data, monkeypatch):
    edges, samples, inputs, (e, s, i) = data
    monkeypatch.setattr(experiment, "MOST_SAMPLES", 5)
    monkeypatch.setattr(experiment, "_conjugate_gradients", lambda *_: pytest.fail("iterations"))
    mae = {r.model: r.mae for r in experiment.run_experiment(e, s, i)[0].collect()}
    y, train = np.array([r[3] for r in samples]), np.array([r[4] == "train" for r in samples])
    expected = ridge(states(edges, samples, inputs), y, train)
    assert len(mae) == 5 and abs(mae["graph"] - np.abs(expected - y)[~train].mean()) < 1e-9


@pytest.mark.parametrize("most_edges", [0, 200_000])
def test_states_by_joins_and_in_small_blocks_equal_numpy(spark, data, monkeypatch, most_edges):
    edges, samples, inputs, (e, s, i) = data
    from pyspark.sql import Window

    monkeypatch.setattr(experiment, "MOST_EDGES", most_edges)
    monkeypatch.setattr(experiment, "BLOCK_VALUES", 40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    try:
        placed = s.withColumn("place", F.row_number().over(Window.partitionBy("episode_id").orderBy("observed_us", "sample_id")) - 1)
        got = np.zeros((21, NODES))
        for r in experiment.encode(e, placed.select("sample_id", "episode_id", "place"), i, 0.9, 1.0).collect():
            got[r.sample_id, r.node] = r.value
    finally:
        spark.conf.set(key, before)
    assert np.allclose(got, states(edges, samples, inputs), atol=1e-12)


@pytest.mark.parametrize("most_samples", [5, 6000])
def test_many_nodes_by_samples_or_scans_equal_sums(spark, data, monkeypatch, most_samples):
    _, _, _, (e, s, i) = data
    placed = s.select("sample_id", "episode_id", "target", "partition", F.lit(0).alias("place"))
    rows = experiment.gathered(e, placed, i).select("sample_id", "target", "partition", F.col("entries.node").alias("nodes"), F.col("entries.input").alias("values")).cache()
    expected = {r.sample_id: r.predicted for r in experiment.ridge_heldout(rows, 1.0).collect()}
    monkeypatch.setattr(experiment, "MOST_NODES", 2)
    monkeypatch.setattr(experiment, "MOST_SAMPLES", most_samples)
    got = {r.sample_id: r.predicted for r in experiment.ridge_heldout(rows, 1.0).collect()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-7 for k in got)


def test_samples_without_inputs_keep_their_place(spark, data):
    """A null input counts as none; a sample without any goes on from the state before and is predicted."""
    _, _, _, (e, s, i) = data
    gaps = i.withColumn("input", F.when(~F.col("sample_id").isin(4, 8), F.col("input")))
    removed = i.where("sample_id not in (4, 8)")
    both = [experiment.run_experiment(e, s, given) for given in (gaps, removed)]
    found = [{(r.model, r.sample_id): r.predicted for r in predictions.collect()} for _, predictions in both]
    assert len(found[0]) == 5 * s.where("partition <> 'train'").count() and np.allclose([found[0][k] for k in sorted(found[0])], [found[1][k] for k in sorted(found[0])], atol=1e-9)

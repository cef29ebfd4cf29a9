"""Fixtures and invariants: values worked out by hand, causality, order and repetition."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.functions.integers import floor_div, round_to_spacing
from tidemark.functions.redact import redact_text
from tidemark.operators import chain, contracts, evaluation, graph, market, policies, windows
from tidemark.plans.bindings import raw_events
from tidemark.plans.market import AS_OF, DELAY, HORIZONS, points
from tidemark.sources import batches

SECOND = 1_000_000


def market_points(spark, times):
    return spark.createDataFrame([Row(event_id=i, pool=1, event_us=t * SECOND, arrival_us=(t if a is None else a) * SECOND, price=1000 + 100 * i) for i, (t, a) in enumerate(times)])


def test_labels_of_four_swaps(spark):
    p = market_points(spark, [(1, None), (61, None), (301, None), (901, None)])
    out = market.forward_label_join(p, [60 * SECOND, 300 * SECOND, 900 * SECOND], 0, 1000 * SECOND).collect()
    assert len(out) == 12
    first = {r.horizon // SECOND: r for r in out if r.point_id == 0}
    assert first[60].status == "observed" and first[60].end_id == 1 and first[60].net_return_bps == 1000
    assert first[300].status == "observed" and first[300].end_id == 2
    assert first[900].status == "observed" and first[900].end_id == 3
    assert {r.status for r in out if r.point_id == 3} == {"censored", "unresolved"}


def test_late_endpoint_revises_unresolved(spark):
    p = market_points(spark, [(1, None), (61, 500)])
    before = market.forward_label_join(p, [60 * SECOND], 0, 60 * SECOND).where("point_id = 0").first()
    after = market.forward_label_join(p, [60 * SECOND], 0, 600 * SECOND).where("point_id = 0").first()
    assert before.status == "unresolved" and after.status == "observed" and after.available_us == 500 * SECOND


def test_later_arrivals_change_no_feature(spark, sf):
    p = points(spark, sf)
    middle = AS_OF - 10 * 86_400 * SECOND
    full = market.history_features(p).where(F.col("arrival_us") <= middle)
    early = market.history_features(p.where(F.col("arrival_us") <= middle))
    assert full.exceptAll(early).count() == 0 and early.exceptAll(full).count() == 0


def test_repetition_and_order_change_no_label(spark, sf):
    p = points(spark, sf)
    a = market.forward_label_join(p, HORIZONS, DELAY, AS_OF)
    b = market.forward_label_join(p.orderBy(F.rand(3)).repartition(7), HORIZONS, DELAY, AS_OF)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize(("a", "b", "out"), [(7, 2, 3), (-7, 2, -4), (-8, 2, -4), (0, 5, 0)])
def test_floor_div(spark, a, b, out):
    assert spark.range(1).select(floor_div(F.lit(a), F.lit(b)).alias("x")).first().x == out


def test_floor_div_by_zero_is_null(spark):
    assert spark.range(1).select(floor_div(F.lit(3), F.lit(0)).alias("x")).first().x is None


def test_rounding_to_spacing(spark):
    r = spark.range(1).select(round_to_spacing(F.lit(61), F.lit(60), up=True).alias("u"), round_to_spacing(F.lit(-61), F.lit(60)).alias("d")).first()
    assert (r.u, r.d) == (120, -120)


def word(n: int) -> str:
    return f"{n % (1 << 256):064x}"


def test_words(spark):
    values = [0, 1, -1, 255, 1 << 40, -(1 << 58), 12345678901]
    df = spark.createDataFrame([(v, word(v)) for v in values], "v long, w string")
    r = df.select("v", "w", words.word_from_long(F.col("v")).alias("made"), words.to_long(F.col("w")).alias("back"), words.bit_length(F.col("w")).alias("bits"), words.fits_signed(F.col("w"), 24).alias("s24"), words.fits_unsigned(F.col("w"), 24).alias("u24")).collect()
    for x in r:
        assert x.made == x.w and x.back == x.v
        assert x.bits == (x.v % (1 << 256)).bit_length()
        assert x.s24 == (-(1 << 23) <= x.v < (1 << 23)) and x.u24 == (0 <= x.v < (1 << 24))


def test_wide_sum_beyond_64_bits(spark):
    values = [(1 << 200) + 7, (1 << 255) - 1, -5, -(1 << 100)]
    parts = spark.createDataFrame([(word(v),) for v in values], "w string").agg(*words.limb_sums(F.col("w")))
    assert parts.select(words.carry(F.array(*[F.col(f"limb{i}") for i in range(8)])).alias("x")).first().x == word(sum(values))


def test_liquidity_amounts_at_the_middle(spark):
    q = 1 << 96
    df = spark.createDataFrame([(word(10), word(q), word(q // 2), word(2 * q))], "l string, p string, a string, b string")
    assert tuple(df.select(words.liquidity_amounts("l", "p", "a", "b").alias("x")).first().x) == ("5", "5")


def test_fees_owed(spark):
    df = spark.createDataFrame([(word(1 << 128), word(10)), (word(2 << 128), word(10))], "g string, l string")
    assert [r.x for r in df.select(words.fees_owed("g", "l").alias("x")).collect()] == ["10", "20"]


def test_quote_fill(spark):
    fee, output, _ = policies.fill(F.lit(10_000).cast("long"), F.lit(1_000_000).cast("long"), F.lit(2_000_000).cast("long"), F.lit(30).cast("long"))
    r = spark.range(1).select(fee.alias("fee"), output.alias("output")).first()
    assert (r.fee, r.output) == (30, 19743)


def test_quote_as_of_takes_no_later_quote(spark):
    quotes = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, t long, name string")
    orders = spark.createDataFrame([(1, 9, 1), (1, 10, 2), (1, 19, 3), (1, 5000, 4), (3, 7, 5)], "k int, at long, id int")
    got = {r.id: r.quote and r.quote["name"] for r in policies.quote_as_of(orders, quotes, "k", "at", "t", 8).collect()}
    assert got == {1: None, 2: "a", 3: "a", 4: "b", 5: None}


def test_drawdown(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([100_000, 95_000, 90_000])], "k int, i int, e long")
    assert windows.max_drawdown_bps(df, ["k"], ["i"], "e").first().drawdown_bps == 1000


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("x", 1, 100, 50, False, 0, 0), ("x", 2, -50, 0, True, 0, 0)], "k string, block_id int, net_bps long, benchmark_bps long, failed boolean, turnover_bps long, exposure_bps long")
    r = evaluation.episode_metrics(df, ["k"]).first()
    assert (r.mean_excess_bps, r.failure_bps, r.inference) == (0, 5000, "insufficient_blocks")


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    df = spark.createDataFrame([("x", b, 10 * b - 40, 0) for b in range(10) for _ in range(3)], "k string, block_id int, net_bps long, benchmark_bps long")
    a, b = evaluation.block_bootstrap(df, ["k"], 200, 1).first(), evaluation.block_bootstrap(df, ["k"], 200, 1).first()
    assert a == b and a.low_bps <= 5 <= a.high_bps and a.low_bps < a.high_bps


def test_allocation(spark):
    df = spark.createDataFrame([(1, "C", 200, 1, "c"), (1, "A", 100, 1, "a"), (1, "B", 100, 1, "b")], "p int, asset string, score int, at int, id string").withColumn("cash", F.lit(200)).withColumn("slots", F.lit(2))
    got = {r.id: r.reason for r in policies.allocate(df, "p", "asset", "score", "at", "id", 100, "cash", "slots").collect()}
    assert got == {"c": "accepted", "a": "accepted", "b": "max_concurrent_positions"}
    more = spark.createDataFrame([(1, "A", 300, 1, "a"), (1, "B", 200, 1, "b"), (1, "B", 150, 1, "b2"), (1, "C", 100, 1, "c"), (1, "A", 90, 1, "a2"), (1, "D", 80, 1, "d")], "p int, asset string, score int, at int, id string").withColumn("cash", F.lit(100)).withColumn("slots", F.lit(3))
    open_ = spark.createDataFrame([(1, "D")], "p int, asset string")
    got = {r.id: r.reason for r in policies.allocate(more, "p", "asset", "score", "at", "id", 100, "cash", "slots", open_).collect()}
    assert got == {"a": "accepted", "b": "insufficient_simulation_cash", "b2": "insufficient_simulation_cash", "c": "insufficient_simulation_cash", "a2": "position_already_open_no_adding", "d": "position_already_open_no_adding"}


def test_clamped_position(spark):
    df = spark.createDataFrame([(1, 1, 100), (1, 2, -140), (1, 3, 60)], "k int, i int, d long")
    assert tuple(windows.clamped_position(df, ["k"], ["i"], "d").first()) == (1, 60, True, 3)


def tree(spark, rows):
    return spark.createDataFrame(rows, "hash string, parent string, height long")


def test_ancestry_of_a_fork_and_a_gap(spark):
    headers = tree(spark, [("a", None, 0), ("b", "a", 1), ("x", "a", 1), ("c", "b", 2), ("d", "c", 3)])
    assert {r.hash for r in chain.ancestry_walk(headers, "d").collect()} == {"a", "b", "c", "d"}
    gap = {r.hash: r.problem for r in chain.ancestry_walk(headers.where("hash <> 'b'"), "d").collect()}
    assert gap == {"d": None, "c": "missing_parent"}
    jump = {r.hash: r.problem for r in chain.ancestry_walk(tree(spark, [("a", None, 0), ("b", "a", 2)]), "b").collect()}
    assert jump == {"b": "nonconsecutive_height"}


def test_ancestry_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        chain.ancestry_walk(tree(spark, [("a", "c", 0), ("b", "a", 1), ("c", "b", -1)]).withColumn("height", F.lit(None).cast("long")), "c").count()


@pytest.mark.parametrize("size", [2, 3, 7])
def test_ancestry_over_many_ranges(spark, monkeypatch, size):
    """A chain with a branch in each range, a gap, a break and a height that is unknown."""
    monkeypatch.setattr(chain, "RANGE", size)
    rows = [(f"m{k}", f"m{k - 1}" if k else None, k) for k in range(40)] + [(f"s{k}", f"m{k - 1}", k) for k in range(1, 40)] + [("t", "s20", 21)]
    walk = lambda rows, tip: sorted((r.hash, r.problem) for r in chain.ancestry_walk(tree(spark, rows), tip).collect())
    assert walk(rows, "m39") == sorted((f"m{k}", None) for k in range(40))
    assert walk(rows, "t") == sorted([("t", None), ("s20", None)] + [(f"m{k}", None) for k in range(20)])
    assert walk([r for r in rows if r[0] != "m9"], "m39") == sorted((f"m{k}", "missing_parent" if k == 10 else None) for k in range(10, 40))
    assert walk([(h, p, n + 5 * (n > 11)) for h, p, n in rows], "m39") == sorted((f"m{k}", "nonconsecutive_height" if k == 12 else None) for k in range(12, 40))
    assert walk([(h, p, None if h == "m15" else n) for h, p, n in rows], "m39") == sorted((f"m{k}", None) for k in range(40))
    assert walk(rows, "none") == []


def test_ancestry_shuffles_do_not_grow_with_the_chain(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chain, "cut", lambda df, name, old=chain.cut: written.append(name) or old(df, name))
    chain.ancestry_walk(tree(spark, [(str(k), str(k - 1) if k else None, k) for k in range(3000)]), "2999").count()
    assert len(written) <= 4


def test_projection_states(spark):
    chain_rows = tree(spark, [("b", "a", 1), ("c", "b", 2)])
    events = spark.createDataFrame([(1, "b", 1, "new"), (2, "x", 1, "new"), (3, "a", 0, "new"), (4, "c", 2, "quarantined")], "id int, block_hash string, block long, status string")
    got = {r.id: r.projected for r in chain.canonical_projection(events, chain_rows, 1, 2, F.lit(True)).collect()}
    assert got == {1: "canonical", 2: "orphaned", 3: "unresolved", 4: "quarantined"}
    assert {r.projected for r in chain.canonical_projection(events, chain_rows, 1, 2, F.lit(False)).collect()} == {"unresolved", "quarantined"}


def test_coverage_by_hand(spark):
    expected, observed = spark.createDataFrame([(10,), (11,)], "k int"), spark.createDataFrame([(10,), (10,)], "k int")
    r = chain.coverage_audit(expected, observed, ["k"]).first()
    assert (r.recall, r.missing, r.repeated_keys, r.state) == (0.5, 1, 1, "degraded")
    empty = chain.coverage_audit(expected.limit(0), observed, ["k"]).first()
    assert empty.recall is None and "empty_reference_cannot_establish_coverage" in empty.notes


def test_quality_by_hand(spark):
    rows = [("s", 10, 0, 2, "ok"), ("s", 11, 0, 4, "quarantined"), ("s", 10, 0, 2, "ok")]
    df = spark.createDataFrame([(a, b, c, d * SECOND, e) for a, b, c, d, e in rows], "source string, block long, e long, a long, status string")
    r = chain.quality_report(df, ["source"], ["block"], "block", "e", "a", "status", head=15).first()
    assert (r.events, r.unique_events, r.duplicates, r.quarantined, r.p95_delay, r.block_lag, r.state) == (3, 2, 1, 1, 4.0, 4, "degraded") and abs(r.mean_delay - 8 / 3) < 1e-9


def test_contract_kinds():
    assert len(contracts.CONTRACTS) == 17 and all(contracts.CONTRACTS.values())


def broken(spark, contract, good, *changes):
    """The reasons of a good row and of copies of it with some fields changed."""
    schema = ", ".join(f"{n} {k}" for n, (k, _) in good.items())
    rows = [tuple({**{n: v for n, (_, v) in good.items()}, **change}.values()) for change in ({}, *changes)]
    return [r.reasons for r in contracts.validate(spark.createDataFrame(rows, schema), contract).collect()]


WORD, ADDRESS, AT = "0x" + "a" * 64, "0x" + "b" * 40, "2024-01-01T00:00:00Z"


def test_raw_event_contract(spark):
    good = {
        "chain_id": ("long", 1), "source": ("string", "s"), "source_schema_version": ("string", "v"), "block_number": ("long", None), "block_hash": ("string", WORD), "parent_hash": ("string", None), "transaction_hash": ("string", None),
        "log_index": ("int", 0), "event_time": ("string", AT), "received_time": ("string", "2024-01-01T02:00:00+02:00"), "payload": ("map<string,string>", {}), "ingestion_run": ("string", "r"), "canonical_status": ("string", "unresolved"),
    }
    got = broken(spark, "raw_event", good, {"chain_id": 0}, {"event_time": "2024-01-01T00:00:00"}, {"event_time": "2024-13-01T00:00:00Z"}, {"canonical_status": "orphaned", "block_hash": None}, {"canonical_status": "lost", "source": " "}, {"log_index": -1, "payload": None})
    assert got == ["", "chain_id", "event_time", "event_time", "orphan_hash", "source,status", "log_index,payload"]


def test_target_and_proposal_contracts(spark):
    target = {"target_id": ("string", "t"), "market": ("string", "spot"), "action": ("string", "entry"), "metric": ("string", "net_return_bps"), "horizons_seconds": ("array<long>", [60, 300]), "qualification_gate": ("string", "g")}
    assert broken(spark, "prediction_target", target, {"market": "x"}, {"horizons_seconds": [300, 60]}, {"horizons_seconds": [60, 60]}, {"horizons_seconds": []}, {"metric": None}) == ["", "market", "horizons", "horizons", "horizons", "metric"]
    proposal = {
        "proposal_id": ("string", "p"), "prediction_id": ("string", "q"), "target_id": ("string", "t"), "horizon_seconds": ("long", 60), "market": ("string", "spot"), "action": ("string", "exit"), "exit_kind": ("string", "sell_token"), "instrument": ("struct<kind: string>", ("token",)),
        "created_at": ("string", AT), "expires_at": ("string", "2024-01-01T00:00:01Z"), "model_version": ("string", "m"), "evidence_refs": ("array<string>", ["e"]), "proposal_state": ("string", "research_only"),
    }
    got = broken(spark, "proposal", proposal, {"exit_kind": "collect_fees"}, {"action": "enter"}, {"market": "lp"}, {"expires_at": "2024-01-01T01:00:00+01:00"}, {"evidence_refs": []})
    assert got == ["", "exit_kind", "exit_kind", "exit_kind,instrument", "expiry", "refs"]


def test_trade_contract(spark):
    leg = "array<struct<asset: string, direction: string>>"
    good = {
        "transaction_hash": ("string", WORD), "wallet": ("string", ADDRESS), "token": ("string", ADDRESS), "classification": ("string", "genuine_swap"), "route_status": ("string", "verified"), "trade_direction": ("string", "buy"), "payment_legs": (leg, [("a", "out")]), "receipt_legs": (leg, [("b", "in")]),
        "refund_legs": (leg, []), "quote_asset": ("string", "native:ETH"), "estimated_usd": ("boolean", False), "estimated_usd_value": ("string", None), "valuation_method": ("string", None), "method_version": ("string", "m"), "as_of_time": ("long", 1), "retrieved_time": ("long", 2), "raw_event_refs": ("array<string>", ["r"]),
    }
    got = broken(spark, "trade", good, {"payment_legs": []}, {"classification": "transfer", "payment_legs": []}, {"estimated_usd": True, "estimated_usd_value": "5"}, {"refund_legs": [("a", "out")]}, {"transaction_hash": "0x1", "classification": "gift"}, {"route_status": "uncertain"})
    assert got == ["", "swap_payment", "", "usd", "refund_direction", "transaction,class", "swap_route"]


def test_redaction(spark):
    text = "see https://a.b/c?key=1 with api_key=XYZ and Bearer abc.def plus 0x" + "f" * 64
    assert spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t")).alias("x")).first().x == "see <url> with api_key=<redacted> and <token> plus <hex>"


def test_shuffled_targets_keep_degrees(spark):
    e = spark.createDataFrame([(i, i % 5, (i * 7) % 11, float(i + 1), 1) for i in range(200)], "ordinal long, src long, dst long, weight double, sign int")
    s = graph.shuffled_targets(e, 3)
    degrees = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    assert degrees(e, "src") == degrees(s, "src") and degrees(e, "dst") == degrees(s, "dst") and s.exceptAll(e.select(s.columns)).count() > 0
    w = graph.random_weights(e, 4)
    assert abs(w.agg(F.avg("weight")).first()[0] - e.agg(F.avg("weight")).first()[0]) < 1e-9


def test_ridge_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    weights, intercept = graph.ridge_fit(df, F.array("a", "b", "c"), "y", 2.0, 3)
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    assert np.allclose(weights, expected) and abs(intercept - (y.mean() - x.mean(0) @ expected)) < 1e-9


def test_changed_export_is_found(spark):
    path = batches.fresh_path(spark, "export")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    batches.export(rows, path, "id", ["id", "x"])
    spark.createDataFrame([('{"id":1,"x":"a"}',), ('{"id":2,"x":"B"}',), ('{"id":9,"x":"n"}',)], "record_json string").write.mode("overwrite").parquet(f"{path}/records")
    assert {r.key: r.state for r in batches.read_export(spark, path, "id").collect()} == {"1": "verified", "2": "changed", "3": "missing", "9": "unlisted"}


def test_changed_bundle_is_refused(spark):
    path = batches.fresh_path(spark, "bundle")
    rows = spark.range(5)
    batches.write_bundle({"a": rows}, path)
    assert batches.read_bundle(spark, path)["a"].count() == 5
    spark.range(6).write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="manifest"):
        batches.read_bundle(spark, path)


def test_row_ranges_cover_all(spark, sf):
    e = raw_events(spark, sf).select("event_id")
    parts = [windows.row_range_partition(e, ["event_id"], k, 3).select("ordinal") for k in range(3)]
    got = sorted(r.ordinal for p in parts for r in p.collect())
    assert got == list(range(e.count()))


def test_sparse_propagation_reaches_all_nodes(spark):
    """The same states as from zeros at all nodes, ids of 40 and more included."""
    from tidemark.operators import graph

    edges = spark.createDataFrame([(0, 70, 0.5, 1), (0, 5, 0.2, -1), (70, 90, 0.4, 1), (5, 0, 0.3, 1), (80, 81, 1.0, 1), (1, 70, 0.9, 1)], "src long, dst long, weight double, sign int")
    drive = spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.2), (2, 0, 1.5), (2, 3, 9.0)], "vec_id long, node long, input double")
    start = drive.select("vec_id").distinct().crossJoin(graph.nodes(edges)).selectExpr("vec_id", "node", "0.0D AS value")
    whole = {(r.vec_id, r.node): r.value for r in graph.propagate(edges, start, 3, 0.3, ["vec_id"], drive).collect()}
    sparse = {(r.vec_id, r.node): r.value for r in graph.propagate_sparse(edges, 3, 0.3, ["vec_id"], drive).collect()}
    assert set(sparse) <= set(whole) and whole[1, 90] != 0
    assert all(abs(v - sparse.get(k, 0.0)) < 1e-12 for k, v in whole.items())


def test_tick_prices(spark):
    """The known ends, both sides of zero, and the upward rounding."""
    ticks = [-887272, -1, 0, 1, 60, 887272, 887273, None]
    got = [r.p and int(r.p, 16) for r in spark.createDataFrame([(t,) for t in ticks], "t int").select(words.sqrt_price_of_tick("t").alias("p")).collect()]
    assert got[0] == 4295128739 and got[5] == 1461446703485210103287273052203988822378723970342 and got[6:] == [None, None]
    assert got[2] == 1 << 96 and got[3] == 79232123823359799118286999568 and got[1] < got[2] < got[3] < got[4]


def test_growth_inside_by_range(spark):
    w = lambda x: f"{x % (1 << 256):064x}"
    df = spark.createDataFrame([(t, w(100), w(10), w(30)) for t in (-11, 0, 10)], "t int, g string, lo string, up string")
    got = [r.x for r in df.select(words.growth_inside(F.col("t"), F.lit(-10), F.lit(10), F.col("g"), F.col("lo"), F.col("up")).alias("x")).collect()]
    assert got == [w(-20), w(60), w(20)]

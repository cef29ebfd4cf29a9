"""Rules of linking, feedback, maturation, policies, gates and audits on rows written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feedback, policies

S = 1_000_000
ACTION = "action_id long, tx string, wallet string, market string, instrument string, action string, at_us long"
ACTIVITY = "activity_id long, tx string, wallet string, kind string, instrument string, delta long, at_us long"


def links(spark, actions, activities, window=120):
    out = feedback.link_actions(spark.createDataFrame(actions, ACTION), spark.createDataFrame(activities, ACTIVITY), window * S).collect()
    return {r.action_id: (r.status, r.activity_id, r.reason) for r in out}


def test_links_by_hash(spark):
    buy = (1, "0xAA", "0xW", "spot", "0xT", "enter", 3 * S)
    swap = (10, "0xaa", "0xw", "swap", "0xt", 100, 900 * S)
    assert links(spark, [buy], [swap]) == {1: ("matched", 10, "exact_transaction_match")}
    # Another wallet's activity with the hash, another direction, another instrument and a transfer don't fit.
    for other in ((10, "0xaa", "0xother", "swap", "0xt", 100, 3 * S), (10, "0xaa", "0xw", "swap", "0xt", -100, 3 * S), (10, "0xaa", "0xw", "swap", "0xu", 100, 3 * S), (10, "0xaa", "0xw", "lp", "0xt", 100, 3 * S)):
        assert links(spark, [buy], [other]) == {1: ("pending", None, "transaction_identity_not_observed")}
    # A hash that isn't found never falls back to the window.
    assert links(spark, [buy], [(10, "0xbb", "0xw", "swap", "0xt", 100, 3 * S)]) == {1: ("pending", None, "transaction_identity_not_observed")}
    assert links(spark, [buy], [swap, (11, *swap[1:])]) == {1: ("ambiguous", None, "multiple_exact_transaction_candidates")}
    assert links(spark, [(1, "0xAA", None, "spot", "0xT", "enter", 0)], [swap])[1][0] == "matched"
    assert links(spark, [(1, "0xAA", "wallet:0xW", "spot", "0xT", "enter", 0)], [swap])[1][0] == "matched"


def test_links_by_window(spark):
    sell = (1, None, "w", "spot", "t", "exit", 1000 * S)
    at = lambda i, s: (i, f"x{i}", "w", "swap", "t", -5, s * S)
    assert links(spark, [sell], [at(10, 880), at(11, 1121)]) == {1: ("matched", 10, "single_compatible_time_window_match")}
    assert links(spark, [sell], [at(10, 880), at(11, 1120)]) == {1: ("ambiguous", None, "multiple_compatible_time_window_candidates")}
    assert links(spark, [sell], [at(10, 879)]) == {1: ("pending", None, "manual_evidence_pending")}
    pool = (2, None, None, "lp", "p", "hold", 0)
    assert links(spark, [pool], [(20, "x", "w", "lp", "p", None, 0)])[2][:2] == ("matched", 20)
    assert links(spark, [(2, None, None, "lp", "p", "collect", 0)], [(20, "x", "w", "lp", "p", None, 0)])[2][0] == "pending"
    assert links(spark, [sell], []) == {1: ("pending", None, "manual_evidence_pending")}


OUTCOME = "outcome_id string, prediction_id string, target_id string, status string, observed_us long, available_us long, net_return_bps long, source_refs array<string>"


def examples(spark, *rows, cutoff=360, state="active"):
    p = spark.createDataFrame([("p1", "t", 60 * S, state)], "prediction_id string, target_id string, created_us long, state string")
    out = feedback.feedback_join(spark.createDataFrame([("o", *r) for r in rows], OUTCOME), p, cutoff * S)
    return [(r.excluded, r.reasons, r.eligible) for r in out.collect()]


def test_feedback(spark):
    assert examples(spark, ("p1", "t", "observed", 100 * S, 300 * S, 5, ["m"])) == [(False, "", True)]
    assert examples(spark, ("p1", "t", "censored", 100 * S, 300 * S, 5, ["m"])) == [(False, "", True)]
    assert examples(spark, ("p1", "t", "unresolved", 100 * S, 300 * S, None, ["m"])) == [(False, "outcome_unresolved_or_invalidated,numeric_target_unavailable", False)]
    # A label without an availability is hidden, as one after the cutoff.
    assert examples(spark, ("p1", "t", "observed", 100 * S, None, 5, ["m"])) == [(True, "label_after_cutoff_or_missing", False)]
    assert examples(spark, ("p1", "t", "observed", 100 * S, 361 * S, 5, ["m"])) == [(True, "label_after_cutoff_or_missing", False)]
    assert examples(spark, ("p2", "t", "observed", 100 * S, 300 * S, 5, ["m"])) == [(True, "prediction_not_found", False)]
    assert examples(spark, ("p1", "t", "observed", 59 * S, 300 * S, 5, ["p1", "m"])) == [(False, "outcome_before_prediction,prediction_self_label_reference", False)]
    assert examples(spark, ("p1", "u", "observed", 100 * S, 300 * S, 5, None)) == [(False, "target_identity_mismatch", False)]
    assert examples(spark, ("p1", "t", "observed", 100 * S, 300 * S, 5, []), state="expired") == [(False, "prediction_not_active_at_creation", False)]


def test_maturation(spark):
    p = spark.createDataFrame([(i, 100 * S if i < 6 else 900 * S) for i in range(1, 8)], "prediction_id long, due_us long")
    o = [(1, "observed", 50), (1, "unresolved", 60), (2, "censored", 50), (3, "unresolved", 50), (4, "observed", None), (5, "observed", 500), (6, "observed", 500)]
    outcomes = spark.createDataFrame([(i, s, None if t is None else t * S) for i, s, t in o], "prediction_id long, status string, available_us long")
    out = {r.prediction_id: (r.state, r.reason) for r in feedback.maturation_queue(p, outcomes, 360 * S).collect()}
    missing = ("missing", "label_due_without_available_outcome")
    assert out == {1: ("ready", None), 2: ("ready", None), 3: ("unresolved", "outcome_unresolved_or_invalidated"), 4: missing, 5: missing, 6: ("waiting", None), 7: ("waiting", None)}


def test_prediction_actions(spark):
    rows = [(100, 500, False), (99, 0, False), (-100, 0, True), (-99, 0, True), (900, 501, False), (-900, 501, True), (100, 0, True), (-100, 0, False)]
    d = policies.prediction_action(F.col("e"), F.col("u"), F.col("o"))
    out = spark.createDataFrame(rows, "e int, u int, o boolean").select(d.alias("d")).collect()
    assert [r.d.action for r in out] == ["enter", "watch", "exit", "hold", "watch", "watch", "hold", "watch"]
    assert out[4].d.reason == "uncertainty_above_threshold"


def test_baselines(spark):
    columns = "verified_flow int, liquidity int, price_change_bps int, candidate_available boolean, cohort_state string, positive_intervals int, position_open boolean, position_age_seconds int, id int"
    rows = [(10, 10, 50, True, "member", 2, False, 0, 1), (0, 10, -1, True, "unknown", 0, True, 300, 2), (1, 1, 1, False, "member", 1, False, 0, 3), (1, 1, 0, True, None, 0, True, 299, 4)]
    out = policies.baseline_decisions(spark.createDataFrame(rows, columns), ["id"]).collect()
    acted = lambda i: [r.action for r in out if r.id == i]
    assert acted(1) == ["watch", "enter", "enter", "enter", "enter"] and {r.allocation_bps for r in out if r.action == "enter"} == {500}
    assert acted(2) == ["watch", "exit", "exit", "exit", "watch"]
    assert acted(3) == ["watch", "watch", "watch", "watch", "watch"]
    assert acted(4) == ["watch", "hold", "hold", "hold", "watch"] and {r.allocation_bps for r in out if r.id in (2, 3, 4)} == {0}


def test_runs_of_rises(spark):
    points = spark.createDataFrame([("a", i, p) for i, p in enumerate([100, 110, 120, 120, 130, 90, 95])], "pool string, at int, price long")
    out = policies.market_observations(points, "pool", ["at"], "price").orderBy("at").collect()
    assert [r.positive_intervals for r in out] == [0, 1, 2, 0, 1, 0, 1] and out[1].price_change_bps == 1000


def test_ranges(spark):
    rows = spark.createDataFrame([(1, 1000, 50, True), (2, 1000, 100, False), (3, 1000, 10, None)], "id int, tick int, vol int, ok boolean")
    out = {(r.id, r.policy): (r.action, r.tick_lower, r.tick_upper) for r in policies.range_decisions(rows, ["id"], "tick", "vol", "ok").collect()}
    assert out[1, "fixed_wide_range"] == ("open", 400, 1600) and out[1, "volatility_range"] == ("open", 880, 1120)
    # Without evidence the ticks stay and the action is watch.
    assert out[2, "volatility_range"] == ("watch", 800, 1200) and out[3, "fixed_wide_range"] == ("watch", 400, 1600) and out[3, "idle"] == ("watch", None, None)


def test_evidence(spark):
    good = {f"{n}_verified": True for n in policies.VERIFIED} | {"chain_id": 7, "deployment_ref": "d", "bytecode_ref": "b", "source_refs": ["s"], "checkpoints": 1, "evidence_id": 1}
    schema = ", ".join(f"{n}_verified boolean" for n in policies.VERIFIED) + ", chain_id int, deployment_ref string, bytecode_ref string, source_refs array<string>, checkpoints int, evidence_id int"
    rows = [good, good | {"tick_math_verified": None, "checkpoints": 0}, good | {"evidence_id": None}, good | {"bytecode_ref": "", "chain_id": None, "source_refs": []}]
    out = policies.evidence_gate(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 7).collect()
    assert [(r.missing, r.qualifies, r.evidence_status) for r in out] == [
        ([], True, "verified"), (["missing_tick_math_verified", "missing_observed_position_checkpoint"], False, "inconclusive"), ([], False, "unavailable"),
        (["unsupported_or_unverified_chain", "missing_bytecode_evidence", "missing_live_source_refs"], False, "inconclusive"),
    ]


def test_health(spark):
    rows = [("degraded", False, 0, True), ("healthy", True, 59, False), ("healthy", False, 45, True), ("healthy", False, 44, False), ("unknown", None, 60, None), ("healthy", False, None, True)]
    df = spark.createDataFrame([(q, c, None if t is None else t * S, p) for q, c, t, p in rows], "q string, c boolean, t long, p boolean")
    out = [tuple(r.h) for r in df.select(policies.health(F.col("q"), F.col("c"), F.lit(60 * S), F.col("t"), F.col("p")).alias("h")).collect()]
    assert out == [
        ("degraded", False, "hold_and_reconcile_existing_position", True, "quality_degraded"), ("degraded", False, "pause_new_entries", False, "contradictory_observation"),
        ("healthy", True, "hold_existing_position", False, "within_deadline"), ("stale", False, "pause_new_entries", True, "decision_deadline_missed"),
        ("unknown", False, "pause_new_entries", False, "quality_unknown"), ("unknown", False, "hold_and_reconcile_existing_position", True, "no_received_observation"),
    ]
    with pytest.raises(Exception, match="in the future"):
        df.select(policies.health(F.col("q"), F.col("c"), F.lit(0), F.lit(S), F.col("p")).alias("h")).collect()


def test_stress(spark):
    rows = [(100, 1000, 333, 30, 5, None, True), (100, 1000, 333, 30, 5, 999, True), (100, 1000, 333, 30, 5, 1000, None)]
    c = F.col
    df = spark.createDataFrame(rows, "b long, s long, m int, f int, g int, d long, ok boolean").select(policies.linear_stress(c("b"), c("s"), c("m"), c("f"), c("g"), c("d"), c("ok")).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [(100 - 33 - 3 - 5, "modeled", "linearized_counterfactual"), (None, "excluded", "insufficient_exit_depth"), (None, "excluded", "unsupported_hook_or_token")]


def test_reconciliation(spark):
    rows = [("a", 10, True, False, -20), ("a", -5, False, False, None), ("b", 1, False, True, 3), ("c", None, False, False, 4), ("d", -3, False, False, None)]
    out = {r.k: tuple(r)[1:] for r in policies.reconcile_shadow(spark.createDataFrame(rows, "k string, drift_bps long, missed boolean, revised boolean, stress_bps long"), ["k"]).collect()}
    assert out == {"a": (2, 2, 1, 0, 1, "reviewed"), "b": (1, 1, 0, 1, 1, "inconclusive"), "c": (0, None, 0, 0, 1, "reviewed"), "d": (1, -3, 0, 0, 0, "inconclusive")}


def test_window_audit(spark):
    day = 86_400 * S
    rows = [(0, 4 * day, 20, 100, 2, 1), (0, 14 * day, 200, 1000, 10, 0), (0, None, 200, 0, 0, 0)]
    out = policies.audit_window(spark.createDataFrame(rows, "start_us long, end_us long, launches long, scheduled long, missed long, gaps long"), 14, 200, 9900).collect()
    assert [(r.state, r.availability_bps) for r in out] == [("inconclusive", 9800), ("pass", 9900), ("inconclusive", None)]
    assert out[0].reasons == ["insufficient_duration", "insufficient_eligible_launches", "healthy_interval_availability_below_gate", "unresolved_source_gaps"]
    assert out[2].reasons == ["insufficient_duration", "healthy_interval_availability_below_gate"]


def test_modes(spark):
    rows = [(1, "spot", 10, True, 100, True), (1, "lp", 90, True, 100, False), (2, "lp", 90, True, 100, False), (3, "spot", 5, False, 100, True), (4, "lp", 9, True, 100, True), (4, "spot", 9, True, 100, None), (5, "spot", 9, True, 99, True), (6, "spot", 9, True, 100, True)]
    df = spark.createDataFrame(rows, "d long, mode string, score_bps long, supported boolean, available_cash long, verified boolean")
    out = {r.d: (r.mode, r.accepted, r.reason) for r in policies.best_mode(df, "d", F.lit(100), F.col("d") == 6).collect()}
    assert out == {
        1: ("spot", True, "highest_registered_score"), 2: ("idle", True, "lp_disabled_until_verified_live_evidence"), 3: ("idle", True, "no_supported_affordable_mode"),
        4: ("lp", True, "highest_registered_score"), 5: ("idle", True, "no_supported_affordable_mode"), 6: ("idle", False, "shared_portfolio_already_allocated"),
    }


def test_linking_reads_each_side_of_its_join_once(spark):
    actions = spark.createDataFrame([(1, "0xA", None, "spot", "t", "enter", 5), (2, None, "wallet:0xb", "spot", "t", "exit", 5), (3, None, None, "spot", "t", "hold", 5), (3, None, None, "spot", "t", "hold", 5)], "action_id long, tx string, wallet string, market string, instrument string, action string, at_us long")
    activities = spark.createDataFrame([(7, "0xa", "0xb", "swap", "T", 4, 99), (8, None, "0xB", "swap", "t", -4, 12), (9, None, "0xb", "swap", "t", -4, 26)], "activity_id long, tx string, wallet string, kind string, instrument string, delta long, at_us long")
    out = feedback.link_actions(actions, activities, 10)
    assert sorted((r.action_id, r.activity_id, r.status) for r in out.collect() if r.action_id < 3) == [(1, 7, "matched"), (2, 8, "matched")]
    assert [r.reason for r in out.collect() if r.action_id == 3] == ["manual_evidence_pending"] * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Union" not in plan

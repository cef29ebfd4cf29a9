"""Predictions, outcomes, proposals and actions joined back to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div
from tidemark.operators.evaluation import reasons


def feedback_join(outcomes: DataFrame, predictions: DataFrame, cutoff: int) -> DataFrame:
    """Outcomes with their prediction, audit reasons, whether they are excluded and whether they may train a model.

    predictions(prediction_id, target_id, created_us, state); outcomes(outcome_id, prediction_id, target_id, status,
    observed_us, available_us, net_return_bps, source_refs).  An outcome without prediction, or whose label isn't available
    by the cutoff (a null availability included), is excluded with that reason alone.  Of the others, observed and
    censored ones with a numeric target and no violation are eligible.
    """
    p = predictions.select("prediction_id", F.col("target_id").alias("__target"), F.col("created_us").alias("__created"), F.col("state").alias("__state"), F.lit(True).alias("__found"))
    joined = outcomes.join(p, "prediction_id", "left")
    early = (F.col("observed_us") < F.col("__created")) | (F.col("available_us") < F.col("__created"))
    violations = [
        ("outcome_before_prediction", early), ("target_identity_mismatch", ~F.col("target_id").eqNullSafe(F.col("__target"))),
        ("prediction_self_label_reference", F.array_contains(F.col("source_refs").cast("array<string>"), F.col("prediction_id").cast("string"))),
        ("prediction_not_active_at_creation", F.col("__state").isin("invalidated", "expired")),
    ]
    unusable = [("outcome_unresolved_or_invalidated", F.col("status").isin("unresolved", "invalidated")), ("numeric_target_unavailable", F.col("net_return_bps").isNull())]
    hidden = F.when(F.col("__found").isNull(), "prediction_not_found").when(F.col("available_us").isNull() | (F.col("available_us") > cutoff), "label_after_cutoff_or_missing")
    fits = (reasons(violations) == "") & F.col("status").isin("observed", "censored") & F.col("net_return_bps").isNotNull()
    out = joined.withColumn("excluded", hidden.isNotNull()).withColumn("reasons", F.coalesce(hidden, reasons(violations + unusable)))
    return out.withColumn("eligible", hidden.isNull() & F.coalesce(fits, F.lit(False))).drop("__target", "__created", "__state", "__found")


def maturation_queue(predictions: DataFrame, outcomes: DataFrame, cutoff: int) -> DataFrame:
    """(prediction_id, state, reason): ready with an observed or censored outcome available by the cutoff, unresolved with others
    only, missing once its label is due, else waiting.  A later unresolved outcome doesn't hide a ready one.

    predictions(prediction_id, due_us); an outcome without availability isn't there.
    """
    known = outcomes.where(F.col("available_us") <= cutoff).groupBy("prediction_id").agg(F.bool_or(F.col("status").isin("observed", "censored")).alias("__ready"))
    joined = predictions.join(known, "prediction_id", "left")
    state = F.when(F.col("__ready"), "ready").when(~F.col("__ready"), "unresolved").when(F.col("due_us") <= cutoff, "missing").otherwise("waiting")
    reason = F.when(state == "unresolved", "outcome_unresolved_or_invalidated").when(state == "missing", "label_due_without_available_outcome")
    return joined.select("prediction_id", state.alias("state"), reason.alias("reason"))


def training_join(examples: DataFrame, features: DataFrame, partitions: DataFrame, group: str) -> DataFrame:
    """Examples with features and partition and a reason against use; a prediction with several outcomes is out as a whole."""
    many = F.count("outcome_id").over(Window.partitionBy("prediction_id"))
    joined = examples.withColumn("__n", many).join(features.withColumn("__f", F.lit(1)), "prediction_id", "left").join(partitions, group, "left")
    why = F.when(~F.col("eligible"), "not_eligible").when(F.col("__n") > 1, "several_outcomes").when(F.col("__f").isNull(), "features_missing").when(F.col("partition").isNull(), "partition_missing")
    return joined.withColumn("reason", why).drop("__n", "__f")


def inbox(proposals: DataFrame, predictions: DataFrame, cutoff: int) -> DataFrame:
    """Proposals with the action and state to show at a cutoff, for sorting newest first."""
    p = predictions.select("prediction_id", F.col("state").alias("__state"))
    joined = proposals.join(p, "prediction_id", "left")
    shown = F.when(F.col("__state").isNull(), "unknown_prediction").when(F.col("__state") != "active", "withdrawn").when(F.col("expires_us") <= cutoff, "expired").otherwise(F.col("proposal_state"))
    return joined.withColumn("shown_state", shown).withColumn("shown_action", F.when(shown == "open", F.col("action")).otherwise("none")).drop("__state")


def link_actions(actions: DataFrame, activities: DataFrame, window_us: int) -> DataFrame:
    """(action_id, activity_id, status, reason): the activity that an action was, if exactly one fits.

    actions(action_id, tx, wallet, market, instrument, action, at_us); activities(activity_id, tx, wallet, kind, instrument,
    delta, at_us), one row for each instrument of an activity.  Compatible are swaps of a spot action's instrument whose
    delta has the action's sign (enter: in, exit: out), and pool activities of a pool action; wallets agree where the
    action names one.  With a transaction hash only compatible activities of that hash count: none is pending, several
    are ambiguous.  Without a hash those within `window_us` count, in the same way.  Amounts never decide.
    """
    lower = lambda c: F.lower(F.col(c).cast("string"))
    # What must agree of market, kind, action and sign is one number: in, out or a pool.  Without one nothing is compatible.
    swaps, pooled = F.col("market") == "spot", (F.col("market") != "spot") & F.col("action").isin("enter", "exit", "hold")
    wanted = F.when(swaps & (F.col("action") == "enter"), 1).when(swaps & (F.col("action") == "exit"), -1).when(pooled, 0).cast("tinyint")
    given = F.when(F.col("kind") == "swap", F.when(F.col("delta") > 0, 1).when(F.col("delta") < 0, -1)).when(F.col("kind") == "lp", 0).cast("tinyint")
    # One join for both rules, by the hash or by the time bucket: each side is read and shuffled once.  A window as wide as a
    # bucket touches three of them.
    bucket = floor_div(F.col("at_us"), max(window_us, 1))
    hashed, nothing = F.struct(lower("tx").alias("tx"), F.lit(None).cast("long").alias("b")), F.lit(None).cast("string").alias("tx")
    left = actions.select("action_id", F.regexp_replace(lower("wallet"), "^wallet:", "").alias("wallet"), lower("instrument").alias("i"), wanted.alias("side"), F.when(F.col("tx").isNull(), F.col("at_us")).alias("at_us"), F.inline(F.when(F.col("tx").isNotNull(), F.array(hashed)).otherwise(F.array(*[F.struct(nothing, (bucket + d).alias("b")) for d in (-1, 0, 1)])))).where("side is not null")
    right = activities.select("activity_id", lower("wallet").alias("__w"), lower("instrument").alias("i"), given.alias("side"), F.inline(F.array(F.struct(lower("tx").alias("tx"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("__at")), F.struct(nothing, bucket.alias("b"), F.col("at_us").alias("__at"))))).where("side is not null and (tx is not null or b is not null)")
    same = [left["i"] == right["i"], left["side"] == right["side"], left["tx"].eqNullSafe(right["tx"]), left["b"].eqNullSafe(right["b"])]
    fits = (F.col("wallet").isNull() | (F.col("wallet") == F.col("__w"))) & (left["tx"].isNotNull() | (F.abs(F.col("at_us") - F.col("__at")) <= window_us))
    pairs = left.join(right, same).where(fits)
    counted = pairs.groupBy("action_id").agg(F.min("activity_id").alias("__one"), (F.min("activity_id") != F.max("activity_id")).alias("__many"))
    out = actions.select("action_id", F.col("tx").isNotNull().alias("__hashed")).join(counted, "action_id", "left")
    status = F.when(F.col("__one").isNull(), "pending").when(F.col("__many"), "ambiguous").otherwise("matched")
    why = F.when(F.col("__hashed"), F.when(status == "pending", "transaction_identity_not_observed").when(status == "ambiguous", "multiple_exact_transaction_candidates").otherwise("exact_transaction_match"))
    why = why.otherwise(F.when(status == "pending", "manual_evidence_pending").when(status == "ambiguous", "multiple_compatible_time_window_candidates").otherwise("single_compatible_time_window_match"))
    return out.select("action_id", F.when(status == "matched", F.col("__one")).alias("activity_id"), status.alias("status"), why.alias("reason"))


def versioned_upsert(current: DataFrame, incoming: DataFrame, ident: str, payload: list[str]) -> DataFrame:
    """One row an id of either side: change (inserted, duplicate, revised, kept), the new payload, the old one where revised,
    and the revision.  Payloads are compared by hash; `current` has a revision column."""
    from tidemark.functions.canon import row_hash

    old = current.select(F.col(ident), F.struct(*payload).alias("__old"), row_hash(payload).alias("__oh"), "revision")
    new = incoming.select(F.col(ident), F.struct(*payload).alias("__new"), row_hash(payload).alias("__nh"))
    both = old.join(new, ident, "full")
    change = F.when(F.col("__oh").isNull(), "inserted").when(F.col("__nh").isNull(), "kept").when(F.col("__oh") == F.col("__nh"), "duplicate").otherwise("revised")
    now = F.coalesce("__new", "__old")
    return both.select(ident, change.alias("change"), *[now[c].alias(c) for c in payload], F.when(change == "revised", F.to_json("__old")).alias("replaced"), F.when(change == "inserted", 1).when(change == "revised", F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))


def signal_rows(outputs: DataFrame, template: DataFrame, ttl: int) -> DataFrame:
    """Model outputs as predictions and proposals by the template row of their target: rounded half to even, rebased times,
    a proposal's end the earlier of expiry and ttl, and an exclusion for repeated ids, unknown targets and final-test rows.

    outputs(output_id, target_id, created_us, value, partition); template(target_id, horizon_us, prefix).
    """
    order = Window.partitionBy("output_id").orderBy("created_us")
    joined = outputs.withColumn("__n", F.row_number().over(order)).join(F.broadcast(template), "target_id", "left")
    why = F.when(F.col("__n") > 1, "repeated_output").when(F.col("prefix").isNull(), "unknown_target").when(F.col("partition") == "final_test", "final_test").when(F.isnan("value"), "not_finite")
    expires = F.col("created_us") + F.col("horizon_us")
    return joined.select("output_id", F.concat_ws(":", "prefix", "output_id").alias("prediction_id"), F.bround("value", 0).cast("long").alias("expected_bps"), expires.alias("expires_us"), F.least(expires, F.col("created_us") + ttl).alias("proposal_expires_us"), why.alias("excluded"))

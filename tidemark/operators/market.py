"""From canonical events to a labelled corpus: causal features, forward labels and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.functions.integers import floor_div, return_bps
from tidemark.operators.windows import global_row_number


def exclusion_split(events: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """`events` with `reason`: the first rule that holds, null for kept rows."""
    chain = F.lit(None).cast("string")
    for name, rule in reversed(reasons):
        chain = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(chain)
    return events.withColumn("reason", chain)


def state_features(tick: str = "tick", liquidity: str = "liquidity", fee: str = "fee", amount0: str = "amount0", amount1: str = "amount1") -> list[Column]:
    """Features of a swap's own state: its tick and fee in millionths within [-1, 1], the bits of its liquidity (a word) of 256, and the
    signs of both amounts (words).  Nothing later can change them."""
    sign = lambda c: F.when(words.is_negative(F.col(c)), -1.0).when(F.col(c) == "0" * 64, 0.0).otherwise(1.0)
    return [
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(tick) / 1_000_000)).alias("tick_scaled"), F.least(words.bit_length(F.col(liquidity)) / 256, F.lit(1.0)).alias("liquidity_log2_scaled"),
        F.least(F.col(fee) / 1_000_000, F.lit(1.0)).alias("fee_scaled"), sign(amount0).alias("amount0_sign"), sign(amount1).alias("amount1_sign"),
    ]


def history_features(points: DataFrame, key: str = "pool", event: str = "event_us", arrival: str = "arrival_us", ident: str = "event_id", price: str = "price", gap: int = 900) -> DataFrame:
    """Features of each point from what had arrived before it, in arrival order; no later arrival can change them."""
    order = Window.partitionBy(key).orderBy(arrival, event, ident)
    before, first = F.lag(price).over(order), F.first(price).over(order)
    place = F.row_number().over(order) - 1
    seconds = floor_div(F.col(arrival) - F.lag(arrival).over(order), 1_000_000)
    return points.select(
        *points.columns,
        F.when(place == 0, 0).otherwise(return_bps(before, F.col(price))).cast("long").alias("price_change_bps"),
        F.when(place == 0, 0).otherwise(return_bps(first, F.col(price))).cast("long").alias("price_level_bps"),
        (place > 0).cast("int").alias("history_available"),
        (F.least(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)), F.lit(gap)) / gap).alias("seconds_since_previous_scaled"),
        F.least(place / 1024, F.lit(1.0)).alias("sequence_index_scaled"),
    )


def forward_label_join(points: DataFrame, horizons: list[int], max_delay: int, as_of: int, key: str = "pool", event: str = "event_us", arrival: str = "arrival_us", ident: str = "event_id", price: str = "price") -> DataFrame:
    """For each point and horizon (microseconds) the first later point of its key with an event time in
    [t + h, t + h + max_delay] that arrived after the point and by `as_of`.

    An interval join by time buckets as wide as the delay: a point looks into two buckets, so rows
    grow by a factor of two and a busy key is spread over its buckets.  Status is observed, else
    censored once the horizon has passed, else unresolved.
    """
    width = max(max_delay, 1)
    target = F.col(event) + F.col("horizon")
    left = points.select(F.col(ident).alias("point_id"), F.col(key).alias("k"), F.col(event).alias("e"), F.col(arrival).alias("a"), F.col(price).alias("p"), F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])).alias("horizon"))
    left = left.withColumn("target", F.col("e") + F.col("horizon"))
    low, high = floor_div(F.col("target"), width), floor_div(F.col("target") + max_delay, width)
    left = left.withColumn("bucket", F.explode(F.array_distinct(F.array(low, high))))
    right = points.where(F.col(arrival) <= as_of).select(F.col(key).alias("rk"), F.col(event).alias("re"), F.col(arrival).alias("ra"), F.col(ident).alias("rid"), F.col(price).alias("rp"), floor_div(F.col(event), width).alias("rb"))
    fits = (F.col("k") == F.col("rk")) & (F.col("bucket") == F.col("rb")) & F.col("re").between(F.col("target"), F.col("target") + max_delay) & (F.col("re") > F.col("e")) & (F.col("ra") > F.col("a"))
    joined = left.join(right, fits, "left")
    del target
    end = F.when(F.col("rid").isNotNull(), F.struct("re", "ra", "rid", "rp"))
    found = joined.groupBy("point_id", "horizon").agg(F.min(end).alias("end"), F.first("target").alias("target"), F.first("a").alias("a"), F.first("p").alias("p"), F.first("k").alias("k"))
    status = F.when(F.col("end").isNotNull(), "observed").when(F.col("target") <= as_of, "censored").otherwise("unresolved")
    return found.select(
        "point_id", F.col("k").alias(key), "horizon", status.alias("status"), F.col("end.rid").alias("end_id"),
        F.when(F.col("end").isNotNull(), F.col("end.ra")).when(F.col("target") <= as_of, F.greatest("target", "a")).otherwise(F.col("target")).alias("observed_us"),
        F.when(F.col("end").isNotNull(), F.col("end.ra")).when(F.col("target") <= as_of, F.lit(as_of).cast("long")).alias("available_us"),
        return_bps(F.col("p"), F.col("end.rp")).alias("net_return_bps"),
    )


def group_chrono_split(rows: DataFrame, group: str, order: list[str], train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """(group, place, partition): groups ranked by their first row; floors of the fractions, and with three or more groups
    none of the partitions is empty.  A group never spans two partitions."""
    firsts = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("first"))
    ranked = global_row_number(firsts.select(group, *[F.col(f"first.{c}").alias(f"__{c}") for c in order]), [f"__{c}" for c in order] + [group], "place").select(group, "place")
    n = ranked.agg(F.count("*").alias("n"))
    train_end = F.greatest(F.lit(1), F.least("n", F.floor(F.col("n") * train)))
    valid_end = F.greatest(train_end, F.least("n", F.floor(F.col("n") * (train + validation))))
    train_end2 = F.when(F.col("n") >= 3, F.least(train_end, F.col("n") - 2)).otherwise(train_end)
    valid_end2 = F.when(F.col("n") >= 3, F.greatest(train_end2 + 1, F.least(valid_end, F.col("n") - 1))).otherwise(valid_end)
    return ranked.crossJoin(F.broadcast(n)).select(group, "place", F.when(F.col("place") <= train_end2, "train").when(F.col("place") <= valid_end2, "validation").otherwise("test").alias("partition"))


def label_to_outcome(labels: DataFrame, target: str) -> DataFrame:
    """Outcome rows of horizon labels: ids from prediction, target, horizon and episode; an observed one needs an availability."""
    ident = F.concat_ws("|", F.lit("outcome"), F.col("point_id").cast("string"), F.lit(target), F.col("horizon").cast("string"))
    return labels.select(ident.alias("outcome_id"), F.concat_ws("|", F.col("point_id").cast("string"), F.lit(target), F.col("horizon").cast("string")).alias("prediction_id"), F.lit(target).alias("target_id"), "status", "available_us", "net_return_bps", ((F.col("status") != "observed") | F.col("available_us").isNotNull()).alias("valid"))


def episode_label_join(observations: DataFrame, episodes: DataFrame, horizons: list[int], key: str = "key") -> DataFrame:
    """Episodes that begin after an observation and within each horizon, labelled in order: failed is unresolved, no exit by
    the horizon is censored, missing cash or an early entry is unresolved, else the return is observed.

    observations(key, observation_id, observed_us, available_us); episodes(key, episode_id, entry_us, entry_available_us,
    exit_us, exit_available_us, cost, proceeds, failed).  Joined in time buckets as wide as the longest horizon.
    """
    width = max(horizons)
    left = observations.withColumn("bucket", F.explode(F.array(floor_div(F.col("observed_us"), width), floor_div(F.col("observed_us"), width) + 1)))
    right = episodes.withColumn("bucket", floor_div(F.col("entry_us"), width))
    joined = left.join(right, [key, "bucket"]).withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    end = F.col("observed_us") + F.col("horizon")
    joined = joined.where((F.col("entry_us") > F.col("observed_us")) & (F.col("entry_us") <= end))
    cash = F.col("cost").isNotNull() & F.col("proceeds").isNotNull()
    status = F.when(F.col("failed"), "unresolved").when(F.col("exit_us").isNull() | (F.col("exit_us") > end), "censored").when(~cash, "unresolved").when(F.col("entry_available_us") < F.col("available_us"), "unresolved").otherwise("observed")
    joined = joined.withColumn("status", status)
    return joined.select(key, "observation_id", "episode_id", "horizon", "status", F.when(F.col("status") == "observed", return_bps(F.col("cost"), F.col("proceeds"))).alias("net_return_bps"), F.when(F.col("status") == "observed", F.col("exit_available_us")).alias("label_available_us"))

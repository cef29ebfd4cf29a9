"""Queries of the labelled corpus: points, features, labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.operators import market, windows
from tidemark.plans.bindings import DAY, MINUTE, floored, headers, micros, query, raw_events, table

HORIZONS = [21_600_000_000, 86_400_000_000, 259_200_000_000]
DELAY = 21_600_000_000
#: 2024-01-28 00:00:00 UTC.
AS_OF = 1_706_400_000_000_000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select("event_id", "pool", "event_us", "arrival_us", "price")


def returns(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {floored(f'({b} - {a}) * 10000', a)} END"


_FEATURES = f"""
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(price) OVER w AS pp, first_value(price) OVER w AS fp, lag(arrival_us) OVER w AS pa FROM ev
 WINDOW w AS (PARTITION BY pool ORDER BY arrival_us, event_us, event_id)),
feat AS (SELECT event_id, CASE WHEN place = 0 THEN 0 ELSE {returns("pp", "price")} END AS price_change_bps, CASE WHEN place = 0 THEN 0 ELSE {returns("fp", "price")} END AS price_level_bps,
 CASE WHEN place > 0 THEN 1 ELSE 0 END AS history_available, least(coalesce((arrival_us - pa) // 1000000, 0), 900) / 900 AS seconds_scaled, least(place / 1024, 1.0) AS sequence_scaled FROM o)"""

_LABELS = f"""
h AS (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS horizon),
base AS (SELECT event_id, pool, event_us, arrival_us, price, horizon, event_us + horizon AS target FROM ev, h),
cand AS (SELECT b.event_id, b.horizon, r.event_id AS rid, r.arrival_us AS ra, r.price AS rp,
 row_number() OVER (PARTITION BY b.event_id, b.horizon ORDER BY r.event_us, r.arrival_us, r.event_id) AS rn
 FROM base b JOIN ev r ON b.pool = r.pool AND r.event_us BETWEEN b.target AND b.target + {DELAY} AND r.event_us > b.event_us AND r.arrival_us > b.arrival_us AND r.arrival_us <= {AS_OF}),
lab AS (SELECT b.event_id AS point_id, b.pool, b.horizon, CASE WHEN rid IS NOT NULL THEN 'observed' WHEN target <= {AS_OF} THEN 'censored' ELSE 'unresolved' END AS status, rid AS end_id,
 CASE WHEN rid IS NOT NULL THEN ra WHEN target <= {AS_OF} THEN greatest(target, arrival_us) ELSE target END AS observed_us,
 CASE WHEN rid IS NOT NULL THEN ra WHEN target <= {AS_OF} THEN {AS_OF} END AS available_us, {returns("price", "rp")} AS net_return_bps
 FROM base b LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON b.event_id = c.event_id AND b.horizon = c.horizon)"""

_SPLIT = """
fi AS (SELECT pool, min({arrival_us: arrival_us, event_id: event_id}) AS f FROM ev GROUP BY pool),
ra AS (SELECT pool, row_number() OVER (ORDER BY f, pool) AS place, count(*) OVER () AS n FROM fi),
te AS (SELECT *, greatest(1, least(n, CAST(floor(n * 0.6) AS BIGINT))) AS t0, CAST(floor(n * (0.6 + 0.2)) AS BIGINT) AS v00 FROM ra),
vv AS (SELECT *, CASE WHEN n >= 3 THEN least(t0, n - 2) ELSE t0 END AS t1, greatest(t0, least(n, v00)) AS v0 FROM te),
split AS (SELECT pool, place, CASE WHEN place <= t1 THEN 'train' WHEN place <= CASE WHEN n >= 3 THEN greatest(t1 + 1, least(v0, n - 1)) ELSE v0 END THEN 'validation' ELSE 'test' END AS partition FROM vv)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.forward_label_join(points(spark, sf_dir), HORIZONS, DELAY, AS_OF)


@query("forward_label_join", f"{_LABELS} SELECT * FROM lab")
def forward_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


_SHOWN = ["price_change_bps", "price_level_bps", "history_available", "amount0_sign", "amount1_sign"]


@query("history_features", f"""{_FEATURES}, st AS (SELECT event_id, price - 5000 AS tick, CASE WHEN price = 0 THEN 0 ELSE 65 + CAST(floor(log2(price)) AS INTEGER) END AS bits, event_id % 5 * 300000 AS fee, price % 7 - 3 AS amount0, 3 - price % 7 AS amount1 FROM ev)
SELECT feat.event_id, price_change_bps, price_level_bps, history_available, round(seconds_scaled, 6) AS seconds_scaled, round(sequence_scaled, 6) AS sequence_scaled, round(tick / 1000000, 6) AS tick_scaled, round(bits / 256, 6) AS liquidity_log2_scaled,
 round(least(fee / 1000000, 1), 6) AS fee_scaled, CAST(sign(amount0) AS DOUBLE) AS amount0_sign, CAST(sign(amount1) AS DOUBLE) AS amount1_sign FROM feat JOIN st ON feat.event_id = st.event_id""")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten features of every event, as a swap whose liquidity is a multiple of 2**64."""
    p, own = points(spark, sf_dir), F.col("price") % 7 - 3
    liquidity = F.concat(F.substring(words.word_from_long(F.col("price")), 17, 48), F.lit("0" * 16))
    p = p.withColumns({"tick": F.col("price") - 5000, "liquidity": liquidity, "fee": F.col("event_id") % 5 * 300_000, "amount0": words.word_from_long(own), "amount1": words.word_from_long(-own)})
    f = market.history_features(p).select("*", *market.state_features())
    return f.select(
        "event_id", *_SHOWN, F.round("seconds_since_previous_scaled", 6).alias("seconds_scaled"), F.round("sequence_index_scaled", 6).alias("sequence_scaled"), *[F.round(c, 6).alias(c) for c in ("tick_scaled", "liquidity_log2_scaled", "fee_scaled")],
    )


@query("group_chrono_split", f"{_SPLIT} SELECT * FROM split")
def group_chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.group_chrono_split(points(spark, sf_dir), "pool", ["arrival_us", "event_id"])


@query("flagship_corpus", f"{_FEATURES}, {_LABELS}, {_SPLIT} SELECT point_id, lab.pool, horizon, status, end_id, net_return_bps, price_change_bps, price_level_bps, history_available, partition FROM lab JOIN feat ON point_id = feat.event_id JOIN split ON lab.pool = split.pool")
def flagship_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with causal features, labels at three horizons and a partition that keeps pools whole."""
    p = points(spark, sf_dir)
    features = market.history_features(p).select("event_id", "price_change_bps", "price_level_bps", "history_available")
    split = market.group_chrono_split(p, "pool", ["arrival_us", "event_id"]).select("pool", "partition")
    return labels(spark, sf_dir).join(features, F.col("point_id") == F.col("event_id")).join(split, "pool").select("point_id", "pool", "horizon", "status", "end_id", "net_return_bps", "price_change_bps", "price_level_bps", "history_available", "partition")


@query("label_to_outcome", f"{_LABELS} SELECT concat_ws('|', 'outcome', CAST(point_id AS VARCHAR), 'net_return', CAST(horizon AS VARCHAR)) AS outcome_id, concat_ws('|', CAST(point_id AS VARCHAR), 'net_return', CAST(horizon AS VARCHAR)) AS prediction_id, 'net_return' AS target_id, status, available_us, net_return_bps, (status <> 'observed' OR available_us IS NOT NULL) AS valid FROM lab")
def label_to_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.label_to_outcome(labels(spark, sf_dir), "net_return")


@query("exclusion_split", f"SELECT event_id, CASE WHEN status <> 'canonical' THEN 'noncanonical' WHEN event_us > {AS_OF} OR arrival_us > {AS_OF} THEN 'after_cutoff' WHEN event_us > arrival_us THEN 'event_after_arrival' WHEN event_type = 'error' THEN 'decode_failed' WHEN pool % 50 = 7 THEN 'unexpected_emitter' END AS reason FROM ev")
def exclusion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("noncanonical", F.col("status") != "canonical"), ("after_cutoff", (F.col("event_us") > AS_OF) | (F.col("arrival_us") > AS_OF)), ("event_after_arrival", F.col("event_us") > F.col("arrival_us")), ("decode_failed", F.col("event_type") == "error"), ("unexpected_emitter", F.col("pool") % 50 == 7)]
    return market.exclusion_split(raw_events(spark, sf_dir), rules).select("event_id", "reason")


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    return e.select(
        F.col("pool").alias("key"), F.col("event_id").alias("episode_id"), F.col("event_us").alias("entry_us"), F.col("arrival_us").alias("entry_available_us"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_us") + (F.col("event_id") % 11) * 60 * MINUTE).alias("exit_us"),
        (F.col("arrival_us") + 60 * MINUTE).alias("exit_available_us"), (F.col("price") + 1).alias("cost"), F.when(F.col("event_id") % 5 != 0, F.col("price") + F.col("event_id") % 100).alias("proceeds"), (F.col("event_id") % 13 == 0).alias("failed"),
    )


_EPISODES = """ep AS (SELECT pool AS key, event_id AS episode_id, event_us AS entry_us, arrival_us AS entry_available_us, CASE WHEN event_id % 7 <> 0 THEN event_us + (event_id % 11) * 3600000000 END AS exit_us,
 arrival_us + 3600000000 AS exit_available_us, price + 1 AS cost, CASE WHEN event_id % 5 <> 0 THEN price + event_id % 100 END AS proceeds, event_id % 13 = 0 AS failed FROM ev),
ob AS (SELECT pool AS key, event_id AS observation_id, event_us AS observed_us, arrival_us AS available_us FROM ev WHERE event_id % 3 = 0)"""


@query("episode_label_join", f"""{_EPISODES}, hz AS (SELECT unnest([21600000000, 86400000000]) AS horizon),
j AS (SELECT ob.key, observation_id, episode_id, horizon, CASE WHEN failed THEN 'unresolved' WHEN exit_us IS NULL OR exit_us > observed_us + horizon THEN 'censored' WHEN cost IS NULL OR proceeds IS NULL THEN 'unresolved' WHEN entry_available_us < available_us THEN 'unresolved' ELSE 'observed' END AS status, cost, proceeds, exit_available_us
 FROM ob JOIN ep ON ob.key = ep.key, hz WHERE entry_us > observed_us AND entry_us <= observed_us + horizon)
SELECT key, observation_id, episode_id, horizon, status, CASE WHEN status = 'observed' THEN {returns("cost", "proceeds")} END AS net_return_bps, CASE WHEN status = 'observed' THEN exit_available_us END AS label_available_us FROM j""")
def episode_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = raw_events(spark, sf_dir).where("event_id % 3 = 0").select(F.col("pool").alias("key"), F.col("event_id").alias("observation_id"), F.col("event_us").alias("observed_us"), F.col("arrival_us").alias("available_us"))
    return market.episode_label_join(observations, _episodes(spark, sf_dir), [6 * 60 * MINUTE, DAY])


@query("row_range_partition", """o AS (SELECT event_id, row_number() OVER (ORDER BY arrival_us, event_id) - 1 AS ordinal, count(*) OVER () AS n FROM ev) SELECT event_id, ordinal FROM o WHERE ordinal >= n * 2 // 5 AND ordinal < n * 3 // 5""")
def row_range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.row_range_partition(raw_events(spark, sf_dir).select("arrival_us", "event_id"), ["arrival_us", "event_id"], 2, 5).select("event_id", "ordinal")


@query("replay_order", "SELECT event_id, row_number() OVER (ORDER BY arrival_us, event_us, event_id) AS place, count(*) OVER (PARTITION BY event_id) > 1 AS repeated FROM ev")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).select("arrival_us", "event_us", "event_id")
    repeated = e.groupBy("event_id").agg((F.count("*") > 1).alias("repeated"))
    return windows.global_row_number(e, ["arrival_us", "event_us", "event_id"], "place").join(repeated, "event_id").select("event_id", "place", "repeated")


@query("latest_by_key", "SELECT pool, event_id, arrival_us, price FROM ev QUALIFY row_number() OVER (PARTITION BY pool ORDER BY arrival_us DESC, event_id DESC) = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_by_key(raw_events(spark, sf_dir).select("pool", "event_id", "arrival_us", "price"), ["pool"], ["arrival_us", "event_id"])


@query("as_of_filter", f"SELECT event_id, pool, event_us, arrival_us FROM ev WHERE event_us <= {AS_OF} AND arrival_us <= {AS_OF - 10 * DAY}")
def as_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.filters import as_of

    return as_of(raw_events(spark, sf_dir), AS_OF, AS_OF - 10 * DAY).select("event_id", "pool", "event_us", "arrival_us")


@query("consecutive_heights", "SELECT c.hash, c.height = p.height + 1 AS consecutive FROM hd c JOIN hd p ON c.parent = p.hash")
def consecutive_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    p = h.select(F.col("hash").alias("parent"), F.col("height").alias("parent_height"))
    return h.join(p, "parent").select("hash", (F.col("height") == F.col("parent_height") + 1).alias("consecutive"))


@query("outage_gap", "g AS (SELECT event_id, source, event_us - lag(event_us) OVER (PARTITION BY source ORDER BY event_us) AS gap FROM ev) SELECT event_id, source, gap FROM g WHERE gap > 2400000000")
def outage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.outage_gaps(raw_events(spark, sf_dir), ["source"], "event_us", 20 * MINUTE).select("event_id", "source", "gap")


@query("gap_ranges", "c AS (SELECT o_custkey AS key, epoch_us(o_orderdate) // 86400000000 AS low, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 30 AS high FROM orders), r AS (SELECT key, low, max(high) OVER (PARTITION BY key ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) SELECT key, reach + 1 AS gap_start, low - 1 AS gap_end FROM r WHERE reach + 1 <= low - 1")
def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.call_function("div", micros("o_orderdate"), F.lit(DAY))
    covered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), day.alias("low"), (day + F.col("o_orderkey") % 30).alias("high"))
    return windows.gap_ranges(covered, "low", "high", ["key"])


_WINDOWS = [("train", 0, 12), ("validation", 12, 20), ("test", 20, 28)]
#: 2024-01-01 00:00:00 UTC.
START = 1_704_067_200_000_000


@query("window_split", f"""wi(name, lo, hi) AS (VALUES {", ".join(f"('{n}', {START + a * DAY}, {START + b * DAY})" for n, a, b in _WINDOWS)}),
p AS (SELECT event_id, pool, event_us, event_us + 86400000000 AS horizon_end, name, hi FROM ev LEFT JOIN wi ON event_us >= lo AND event_us < hi),
q AS (SELECT *, CASE WHEN name IS NULL THEN 'outside_windows' WHEN horizon_end > hi THEN 'label_exceeds_partition_end' END AS r0 FROM p),
f AS (SELECT pool, arg_min(name, {{e: event_us, i: event_id}}) AS own FROM q WHERE r0 IS NULL GROUP BY pool)
SELECT event_id, CASE WHEN r0 IS NULL AND name = own THEN name END AS partition, CASE WHEN r0 IS NOT NULL THEN r0 WHEN name <> own THEN 'group_reused_across_partitions' END AS reason FROM q LEFT JOIN f ON q.pool = f.pool""")
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.filters import window_split as split

    rows = raw_events(spark, sf_dir).select("event_id", "pool", "event_us", (F.col("event_us") + DAY).alias("horizon_end"))
    return split(rows, [(n, START + a * DAY, START + b * DAY) for n, a, b in _WINDOWS], "pool", "event_us", "horizon_end", "event_id").select("event_id", "partition", "reason")

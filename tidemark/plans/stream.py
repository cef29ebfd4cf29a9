"""Streaming queries: each runs over the event table as a stream until it is read, then returns what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import return_bps
from tidemark.plans.bindings import DAY, MINUTE, micros, query
from tidemark.plans.market import DELAY, HORIZONS, returns
from tidemark.sources.shared import shared_dir
from tidemark.streaming import jobs


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream(spark: SparkSession, sf_dir: str, path: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The event table, or its copy at `path`, as a stream with two clocks and a status."""
    at, i = micros("ts"), F.col("event_id")
    raw = jobs.read_events(spark, path or f"{sf_dir}/events.parquet", files_per_batch)
    return raw.select(
        i, F.expr("event_id div 10").alias("block"), (i % 3).alias("source"), F.col("user_id").alias("pool"), "event_type", at.alias("event_us"), (at + (i % 13) * 17 * MINUTE).alias("arrival_us"),
        F.when(i % 20 == 0, "quarantined").when(i % 20 == 1, "orphaned").otherwise("canonical").alias("status"), F.round(F.col("value") * 100).cast("long").alias("price"),
    )


def _run(spark: SparkSession, name: str, out: DataFrame, mode: str = "append") -> DataFrame:
    path, checkpoint = _paths(spark, name)
    schema = out.schema
    jobs.run_once(out, path, checkpoint, mode)
    return spark.read.schema(schema).parquet(path) if mode == "append" else spark.read.parquet(path)


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)


@query("stream_dedup", "SELECT DISTINCT pool, block, source FROM ev")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated deliveries of a logical key (pool, block, source), within a watermark longer than the log."""
    s = jobs.with_arrival_clock(stream(spark, sf_dir), delay="400 days")
    return _run(spark, "dedup", jobs.deduplicated(s, ["pool", "block", "source"]).select("pool", "block", "source"))


@query("stream_dual_clock", "SELECT event_id, event_us, arrival_us, arrival_us > event_us AS later_known FROM ev WHERE status = 'canonical'")
def stream_dual_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.with_arrival_clock(stream(spark, sf_dir).where("status = 'canonical'"))
    return _run(spark, "clock", s.select("event_id", "event_us", "arrival_us", (F.col("arrival_us") > F.col("event_us")).alias("later_known")))


@query("stream_late", f"SELECT pool, count(*) FILTER (arrival_us <= {1_704_067_200_000_000 + 10 * DAY}) AS known_early, count(*) AS known_late FROM ev WHERE event_us <= {1_704_067_200_000_000 + 10 * DAY} GROUP BY pool")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to a time as known then and as known later: late ones are missing in the first count only."""
    cutoff = 1_704_067_200_000_000 + 10 * DAY
    kept = _run(spark, "late", jobs.with_arrival_clock(stream(spark, sf_dir)).select("pool", "event_us", "arrival_us"))
    return kept.where(F.col("event_us") <= cutoff).groupBy("pool").agg(F.count_if(F.col("arrival_us") <= cutoff).alias("known_early"), F.count("*").alias("known_late"))


@query("stream_confirmation", "SELECT event_id, block FROM ev WHERE block <= (SELECT max(block) FROM ev) - 12")
def stream_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.expr("event_id div 10"))).first()[0] or 0
    return _run(spark, "confirmed", jobs.confirmed_only(stream(spark, sf_dir), "block", head, 12).select("event_id", "block"))


@query("stream_quality", f"SELECT arrival_us // {DAY} * {DAY} AS from_us, count(*) AS events, count(*) FILTER (status = 'quarantined') AS quarantined, round(avg(greatest(0, arrival_us - event_us) / 1000000), 6) AS mean_delay FROM ev GROUP BY 1")
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.with_arrival_clock(stream(spark, sf_dir))
    out = _run(spark, "quality", jobs.quality(s, "1 day"), "update")
    last = out.groupBy("from_us").agg(F.max_by(F.struct("events", "quarantined", "mean_delay"), "batch").alias("l"))
    return last.select("from_us", "l.events", "l.quarantined", F.round("l.mean_delay", 6).alias("mean_delay"))


#: Events of a share of the pools in the state of the labels, over all of its buckets.
_SHARE_EVENTS = 20_000


#: The arrival clock of a finished stream: the watermark stays a day behind the newest arrival, in whole milliseconds.
_CLOCK = f"(SELECT max(arrival_us) // 1000 * 1000 - {DAY} FROM ev)"


@query("stream_labels", f"""h AS (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS horizon),
base AS (SELECT event_id, pool, event_us, arrival_us, price, horizon, event_us + horizon AS target FROM ev, h WHERE event_id % 2 = 0),
cand AS (SELECT b.event_id, b.horizon, r.event_id AS rid, r.arrival_us AS ra, r.price AS rp, row_number() OVER (PARTITION BY b.event_id, b.horizon ORDER BY r.event_us, r.arrival_us, r.event_id) AS rn
 FROM base b JOIN ev r ON b.pool = r.pool AND r.event_us BETWEEN b.target AND b.target + {DELAY} AND r.event_us > b.event_us AND r.arrival_us > b.arrival_us)
SELECT b.event_id AS point_id, b.pool, b.horizon, CASE WHEN rid IS NOT NULL THEN 'observed' WHEN greatest(target, arrival_us) <= {_CLOCK} THEN 'censored' ELSE 'unresolved' END AS status, rid AS end_id,
 CASE WHEN rid IS NOT NULL THEN ra WHEN greatest(target, arrival_us) <= {_CLOCK} THEN greatest(target, arrival_us) ELSE target END AS observed_us, {returns("price", "rp")} AS net_return_bps
FROM base b LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON b.event_id = c.event_id AND b.horizon = c.horizon""")
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every second event at three horizons as the stream leaves them, over several micro-batches."""
    _stateful(spark)
    path, _ = _paths(spark, "labels")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(4, "event_id").write.parquet(f"{path}-files")
    s = jobs.with_arrival_clock(stream(spark, sf_dir, f"{path}-files", 2)).select(F.col("event_id").alias("point_id"), "pool", "event_us", "arrival_us", "price", (F.col("event_id") % 2 == 0).alias("is_point"), "received_time")
    changes = _run(spark, "labels", jobs.forward_labels(s, HORIZONS, DELAY, 7 * DAY, shares=max(16, events.count() // _SHARE_EVENTS)))
    last = changes.groupBy("point_id", "horizon").agg(F.max_by(F.struct("pool", "status", "end_id", "observed_us", "start_price", "end_price"), "revision").alias("l"))
    return last.select("point_id", "l.pool", "horizon", "l.status", "l.end_id", "l.observed_us", return_bps(F.col("l.start_price"), F.col("l.end_price")).alias("net_return_bps"))


@query("stream_positions", "st AS (SELECT pool, event_id, arrival_us, CASE WHEN event_type IN ('error', 'click') THEN -price * 3 ELSE price END AS d FROM ev WHERE status = 'canonical'), ru AS (SELECT pool, d, sum(d) OVER (PARTITION BY pool ORDER BY arrival_us, event_id) AS s, arrival_us, event_id FROM st) SELECT pool, CAST(arg_max(s, {a: arrival_us, e: event_id}) - least(0, min(s)) AS BIGINT) AS liquidity, min(s) < 0 AS uncertain, count(*) AS steps FROM ru GROUP BY pool")
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    delta = F.when(F.col("event_type").isin("error", "click"), -F.col("price") * 3).otherwise(F.col("price"))
    s = stream(spark, sf_dir).where("status = 'canonical'").select("pool", "event_id", "arrival_us", delta.alias("delta"))
    out = _run(spark, "positions", jobs.positions(s), "update")
    last = out.groupBy("pool").agg(F.max_by(F.struct("liquidity", "uncertain", "steps"), "steps").alias("l"))
    return last.select("pool", "l.*")


#: The life of a position as windows: its first open, the first remove after it, and the clamped sum between them.
_LIFE_SQL = """st AS (SELECT pool AS position_id, event_id // 2 * 2 AS action_id, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'resize' ELSE 'collect' END AS action,
 price - 3000 AS delta, event_id % 5 AS gas, event_id % 17 = 0 AS failed, arrival_us, event_id FROM ev),
nu AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY arrival_us, action_id, event_id) AS k, row_number() OVER (PARTITION BY position_id, action_id ORDER BY arrival_us, event_id) > 1 AS dup FROM st),
ok AS (SELECT *, NOT dup AND NOT failed AS live FROM nu),
op AS (SELECT position_id, min(k) AS k_open FROM ok WHERE live AND action = 'open' GROUP BY 1),
rm AS (SELECT position_id, min(k) AS k_end FROM ok JOIN op USING (position_id) WHERE live AND action = 'remove' AND k > k_open GROUP BY 1),
fl AS (SELECT ok.*, k_open, coalesce(k_end, 9223372036854775807) AS k_end FROM ok LEFT JOIN op USING (position_id) LEFT JOIN rm USING (position_id)),
su AS (SELECT *, sum(CASE WHEN live AND k >= k_open AND k < k_end AND action IN ('open', 'resize') THEN delta ELSE 0 END) OVER (PARTITION BY position_id ORDER BY k) AS s,
 sum(CASE WHEN dup THEN 0 ELSE gas END) OVER (PARTITION BY position_id ORDER BY k) AS used FROM fl),
mi AS (SELECT *, coalesce(min(CASE WHEN live AND k > k_open AND k < k_end THEN s END) OVER (PARTITION BY position_id ORDER BY k), 0) AS least_s FROM su)
SELECT position_id, action_id, CASE WHEN dup THEN 'duplicate' WHEN failed THEN 'failed' WHEN k_open IS NULL OR k < k_open THEN 'orphan' WHEN k > k_end THEN 'superseded' ELSE 'applied' END AS verdict,
 CAST(CASE WHEN k_open IS NULL OR k < k_open OR k >= k_end THEN 0 ELSE s - least(0, least_s) END AS BIGINT) AS liquidity, CAST(used AS BIGINT) AS gas FROM mi"""


@query("stream_lp_lifecycle", _LIFE_SQL)
def stream_lp_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    i = F.col("event_id")
    action = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "resize").otherwise("collect")
    s = stream(spark, sf_dir).select(F.col("pool").alias("position_id"), (F.expr("event_id div 2") * 2).alias("action_id"), action.alias("action"), (F.col("price") - 3000).alias("delta"), (i % 5).alias("gas"), (i % 17 == 0).alias("failed"), "arrival_us")
    return _run(spark, "lifecycle", jobs.lifecycles(s))


#: A step of all portfolios at a time; the three sources are the assets.
_DECISIONS_SQL = """RECURSIVE ob AS (SELECT pool, event_id // 4 * 4 + event_id % 3 AS observation_id, source AS asset, price % 300 - 140 AS expected, price % 110 AS uncertainty, arrival_us, event_id FROM ev),
nu AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY arrival_us, observation_id, event_id) AS k FROM ob),
fi AS (SELECT *, min(k) OVER (PARTITION BY pool, observation_id) AS k_first FROM nu),
wa(pool, k, cash, h0, h1, h2, decision) AS (SELECT DISTINCT pool, 0::BIGINT, 20000::BIGINT, false, false, false, NULL::VARCHAR FROM fi UNION ALL
 SELECT pool, k, CASE v WHEN 'enter' THEN cash - 1000 WHEN 'exit' THEN cash + 1000 ELSE cash END,
 CASE WHEN asset = 0 AND v IN ('enter', 'exit') THEN v = 'enter' ELSE h0 END, CASE WHEN asset = 1 AND v IN ('enter', 'exit') THEN v = 'enter' ELSE h1 END, CASE WHEN asset = 2 AND v IN ('enter', 'exit') THEN v = 'enter' ELSE h2 END, v
 FROM (SELECT *, CASE WHEN k <> k_first THEN NULL WHEN expected > uncertainty AND NOT held AND cash >= 1000 THEN 'enter' WHEN held AND expected < -uncertainty THEN 'exit' WHEN held THEN 'hold' ELSE 'watch' END AS v
  FROM (SELECT fi.*, cash, h0, h1, h2, CASE asset WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END AS held FROM wa JOIN fi ON fi.pool = wa.pool AND fi.k = wa.k + 1)))
SELECT fi.pool AS portfolio, observation_id, first.decision, fi.k <> k_first AS repeated, wa.cash FROM fi JOIN wa ON wa.pool = fi.pool AND wa.k = fi.k JOIN wa first ON first.pool = fi.pool AND first.k = k_first"""


@query("stream_decisions", _DECISIONS_SQL)
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio a pool, with the sources as its assets."""
    _stateful(spark)
    p = F.col("price")
    s = stream(spark, sf_dir).select(F.col("pool").alias("portfolio"), (F.expr("event_id div 4") * 4 + F.col("event_id") % 3).alias("observation_id"), F.col("source").alias("asset"), (p % 300 - 140).alias("expected"), (p % 110).alias("uncertainty"), "arrival_us")
    return _run(spark, "decisions", jobs.decisions(s, 1000, 20_000))


def newest_lineage(rows: DataFrame) -> DataFrame:
    """Of each (source, block) the rows of its newest lineage that are canonical."""
    last = F.max("lineage").over(Window.partitionBy("source", "range", "block"))
    return rows.withColumn("newest", last).where("lineage = newest and status = 'canonical'").drop("newest")


@query("stream_reorg", """li AS (SELECT event_id, event_id % 3 AS source, event_id % 200 // 10 AS block, event_id // 200 AS lineage, event_id % 200 // 100 AS range,
 CASE WHEN event_id // 200 % 5 = 4 AND event_id % 200 >= 100 AND event_id % 3 = 2 THEN 'orphaned' ELSE status END AS status FROM ev),
la AS (SELECT *, max(lineage) OVER (PARTITION BY source, block) AS newest FROM li)
SELECT source, range, block, lineage, count(*) AS canonical FROM la WHERE lineage = newest AND status = 'canonical' GROUP BY ALL""")
def stream_reorg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events replace the lineage of the same blocks, in micro-batches of a few files each.  Every fifth lineage leaves
    nothing canonical in one range of one source."""
    path, checkpoint = _paths(spark, "reorg")
    files = f"{path}-files"
    # The table as a log of files in the order of its events; files by time are taken in the order they were written.
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(8, "event_id").write.parquet(files)
    lineage = F.expr("event_id div 200")
    emptied = (lineage % 5 == 4) & (F.col("event_id") % 200 >= 100) & (F.col("source") == 2)
    s = stream(spark, sf_dir, files, 2).select(
        "event_id", "source", F.expr("event_id % 200 div 10").alias("block"), lineage.alias("lineage"), F.when(emptied, "orphaned").otherwise(F.col("status")).alias("status"), F.expr("event_id % 200 div 100").alias("range")
    )
    store = jobs.RangeStore(spark, path, newest_lineage, F.max("lineage"))
    jobs.repair_on_reorg(s, store, checkpoint).awaitTermination()
    out = store.current()
    return out.groupBy(F.col("source").cast("long").alias("source"), F.col("range").cast("long").alias("range"), "block", "lineage").agg(F.count("*").alias("canonical"))

"""Queries of sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.bindings import DAY, query, raw_events, table
from tidemark.plans.market import labels
from tidemark.sources import batches, pages
from tidemark.streaming import jobs

_COLUMNS = ["arrival_us", "event_id", "event_us", "pool", "status"]
_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c == "status" else T.LongType()) for c in _COLUMNS])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select(*_COLUMNS, "source", F.call_function("div", F.col("event_us"), F.lit(7 * DAY)).alias("week"))


@query("scan_raw_batches", "SELECT event_id, pool, status, arrival_us, event_us FROM ev")
def scan_raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = batches.fresh_path(spark, "raw")
    batches.append_raw(_events(spark, sf_dir), path, _COLUMNS, ["source", "week"])
    rows, report = batches.scan_raw(spark, path, _SCHEMA)
    return rows.join(F.broadcast(report.where("sound").select("batch_id")), "batch_id", "left_semi").select("event_id", "pool", "status", "arrival_us", "event_us")


@query("sink_raw_append", f"SELECT source, event_us // {7 * DAY} AS week, count(*) AS rows, true AS sound, 0 AS added_again FROM ev GROUP BY 1, 2")
def sink_raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches after appending the same events twice: each once, and nothing added by the second append."""
    path = batches.fresh_path(spark, "raw")
    batches.append_raw(_events(spark, sf_dir), path, _COLUMNS, ["source", "week"])
    batches.append_raw(_events(spark, sf_dir), path, _COLUMNS, ["source", "week"])
    _, report = batches.scan_raw(spark, path, _SCHEMA)
    manifest = spark.read.parquet(f"{path}/manifest")
    again = manifest.groupBy("batch_id").agg((F.count("*") - 1).cast("int").alias("added_again"))
    return manifest.join(report.select("batch_id", "sound"), "batch_id").join(again, "batch_id").select("source", "week", "rows", "sound", "added_again")


@query("sink_export", """SELECT sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS hash, CAST(p_partkey AS VARCHAR) AS key FROM part""")
def sink_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = batches.fresh_path(spark, "export")
    batches.export(table(spark, sf_dir, "part"), path, "p_partkey", ["p_partkey", "p_brand", "p_size"])
    return spark.read.parquet(f"{path}/manifest").select("hash", "key")


@query("scan_parquet_verified", "SELECT CAST(p_partkey AS VARCHAR) AS key, 'verified' AS state FROM part")
def scan_parquet_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = batches.fresh_path(spark, "export")
    batches.export(table(spark, sf_dir, "part"), path, "p_partkey", ["p_partkey", "p_brand", "p_size"])
    return batches.read_export(spark, path, "p_partkey").select("key", "state")


@query("sink_snapshot", "cu AS (SELECT sha256(concat_ws('|', p_brand, p_type, p_name))[1:24] AS snapshot_id, p_brand, p_type FROM part WHERE p_partkey % 3 = 0), inc AS (SELECT sha256(concat_ws('|', p_brand, p_type, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END))[1:24] AS snapshot_id, p_brand AS source, p_type AS kind, CASE WHEN p_partkey % 4 = 1 THEN sha256(concat_ws('|', p_brand, p_type, p_name))[1:24] WHEN p_partkey % 4 = 3 THEN sha256('none')[1:24] END AS replaces FROM part), di AS (SELECT DISTINCT * FROM cu) SELECT inc.snapshot_id, replaces, replaces IS NULL OR coalesce(di.p_brand = source AND di.p_type = kind, false) AS valid FROM inc LEFT JOIN di ON replaces = di.snapshot_id WHERE inc.snapshot_id NOT IN (SELECT snapshot_id FROM cu)")
def sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ident = F.substring(F.sha2(F.concat_ws("|", "p_brand", "p_type", "p_name").cast("binary"), 256), 1, 24)
    current = p.where("p_partkey % 3 = 0").select(ident.alias("snapshot_id"), F.col("p_brand").alias("source"), F.col("p_type").alias("kind")).distinct()
    none = F.substring(F.sha2(F.lit("none").cast("binary"), 256), 1, 24)
    content = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_partkey").cast("string")))
    incoming = p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("kind"), content.alias("content"), F.when(F.col("p_partkey") % 4 == 1, ident).when(F.col("p_partkey") % 4 == 3, none).alias("replaces"))
    return batches.snapshots(current, incoming).select("snapshot_id", "replaces", "valid")


@query("sink_bundle", "SELECT 'points' AS name, count(*) AS rows FROM ev UNION ALL SELECT 'labels', count(*) * 3 FROM ev")
def sink_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = batches.fresh_path(spark, "bundle")
    batches.write_bundle({"points": raw_events(spark, sf_dir).select("event_id", "pool", "price"), "labels": labels(spark, sf_dir)}, path)
    out = None
    for name, df in batches.read_bundle(spark, path).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_bundle", "SELECT pool, event_id, price, 'prediction' AS kind FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT pool, event_id, price, 'outcome' FROM ev WHERE event_id % 2 = 1")
def scan_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested JSON bundle per pool, read into typed rows of predictions and outcomes."""
    path = batches.fresh_path(spark, "nested")
    item = F.struct("event_id", "price")
    even = F.col("event_id") % 2 == 0
    nested = raw_events(spark, sf_dir).groupBy("pool").agg(F.collect_list(F.when(even, item)).alias("predictions"), F.collect_list(F.when(~even, item)).alias("outcomes"))
    nested.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    typed = spark.read.schema("pool long, predictions array<struct<event_id: long, price: long>>, outcomes array<struct<event_id: long, price: long>>").json(path)
    rows = lambda name, kind: typed.select("pool", F.inline(name)).withColumn("kind", F.lit(kind))
    return rows("predictions", "prediction").unionByName(rows("outcomes", "outcome"))


_LOG = "block long, event_id long, event_type string, pool long, event_us long"


#: Events of a file of the log, and pages of 128 blocks that a task reads: about as many events.
_FILE_EVENTS, _TASK_PAGES = 250_000, 200


def _append_log(logs: DataFrame, path: str) -> None:
    """Store events as the log that the page source reads: files in block order, more for a larger log."""
    files = max(4, -(-logs.count() // _FILE_EVENTS))
    logs.select("block", "event_id", "event_type", "pool", "event_us").repartitionByRange(files, "block").write.mode("append").parquet(path)


@query("scan_log_pages", """lv AS (SELECT unnest([128, 64, 32, 16, 8, 4, 2, 1]) AS w), pg AS (SELECT w, block - block % w AS low, count(*) AS logs FROM ev, lv GROUP BY 1, 2),
 sm AS (SELECT * FROM pg WHERE logs <= 40 OR w = 1),
 st AS (SELECT low, low + w - 1 AS high FROM sm s WHERE NOT EXISTS (SELECT 1 FROM sm p WHERE p.w > s.w AND p.low = s.low - s.low % p.w))
SELECT low, high, block, event_id, event_type FROM st JOIN ev ON block BETWEEN low AND high""")
def scan_log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read by pages of 128 blocks from the log, halved on executors while a page holds more than 40."""
    path = batches.fresh_path(spark, "pages")
    logs = raw_events(spark, sf_dir)
    _append_log(logs, path)
    end = (logs.agg(F.max("block")).first()[0] or 0) // 128 * 128 + 127
    spark.dataSource.register(pages.LogPages)
    options = {"path": path, "columns": "block,event_id,event_type,pool,event_us", "rows": f"{_LOG}, page_low long, page_high long", "page": 128, "task_pages": max(1, min(_TASK_PAGES, end // 128 // 16)), "most": 40, "start": 0, "end": end}
    read = spark.read.format("log_pages").options(**options).load()
    return read.select(F.col("page_low").alias("low"), F.col("page_high").alias("high"), "block", "event_id", "event_type")


def tail_log(spark: SparkSession, log: str, out: str, checkpoint: str, max_blocks: int, lag: int = 12) -> None:
    """Take all blocks of the log that are confirmed by now, `max_blocks` a micro-batch, beyond what the checkpoint has."""
    spark.dataSource.register(pages.LogPages)
    options = {"path": log, "columns": "block,event_id,event_type,pool,event_us", "rows": _LOG, "page": max(1, max_blocks // 4), "lag": lag, "max_blocks": max_blocks}
    jobs.run_until_idle(spark.readStream.format("log_pages").options(**options).load(), out, checkpoint)


@query("stream_log_tail", "SELECT event_id, block, event_type FROM ev WHERE block <= (SELECT max(block) FROM ev) - 12")
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by a stream whose offset is the next block and that stays 12 blocks behind the head.  Half of the log is there at
    first; a second run on the same checkpoint takes the blocks near the first head and all later ones, none twice."""
    path = batches.fresh_path(spark, "tail")
    logs = raw_events(spark, sf_dir)
    head = logs.agg(F.max("block")).first()[0] or 0
    for arrived in (F.col("block") <= head // 2, F.col("block") > head // 2):
        _append_log(logs.where(arrived), f"{path}/log")
        # An eighth of the log a micro-batch.
        tail_log(spark, f"{path}/log", f"{path}/out", f"{path}/checkpoint", head // 8 + 1)
    return spark.read.schema(_LOG).parquet(f"{path}/out").select("event_id", "block", "event_type")

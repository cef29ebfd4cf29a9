"""The supplied tables as the engine's inputs, and the same bindings as SQL for the checks.

Instants are bigint microseconds since 1970, whatever the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MINUTE = 60_000_000
DAY = 86_400_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL (the CTEs of CTES that it names are added)."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 and B2: an event log with two clocks, a status and a price in cents."""
    at = micros("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("event_id div 10").alias("block"), (F.col("event_id") % 3).alias("source"), F.col("user_id").alias("pool"), "event_type", "props",
        at.alias("event_us"), (at + (F.col("event_id") % 13) * 17 * MINUTE).alias("arrival_us"),
        F.when(F.col("event_id") % 20 == 0, "quarantined").when(F.col("event_id") % 20 == 1, "orphaned").otherwise("canonical").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("price"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1b: a block tree with side branches."""
    k = F.col("o_orderkey")
    parent = F.when(k == 0, None).when(k % 10 == 9, k - 2).otherwise(k - 1 - F.when((k - 1) % 10 == 9, 1).otherwise(0))
    height = k - F.expr("o_orderkey div 10") - F.when(k % 10 == 9, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select(k.alias("hash"), parent.alias("parent"), height.alias("height"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: trades with a class, a direction and integer amounts."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("asset"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'genuine' WHEN 'N' THEN 'ambiguous' ELSE 'transfer' END").alias("class"),
        F.expr("CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END").alias("direction"),
        F.round(F.col("l_quantity")).cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        micros("l_shipdate").alias("arrival_us"),
    )
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("wallet"), micros("o_orderdate").alias("event_us"))
    return line.join(order, "tx")


CTES = {
    "ev": """ev AS (SELECT event_id, event_id // 10 AS block, event_id % 3 AS source, user_id AS pool, event_type, props, epoch_us(ts) AS event_us,
 epoch_us(ts) + (event_id % 13) * 17 * 60000000 AS arrival_us, CASE event_id % 20 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'orphaned' ELSE 'canonical' END AS status,
 CAST(round(value * 100) AS BIGINT) AS price FROM events)""",
    "hd": """hd AS (SELECT o_orderkey AS hash, CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 10 = 9 THEN o_orderkey - 2
 ELSE o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 10 = 9 THEN 1 ELSE 0 END END AS parent,
 o_orderkey - o_orderkey // 10 - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS height FROM orders)""",
    "tr": """tr AS (SELECT l_orderkey AS tx, l_linenumber AS line, l_partkey AS token, l_suppkey AS asset,
 CASE l_returnflag WHEN 'A' THEN 'genuine' WHEN 'N' THEN 'ambiguous' ELSE 'transfer' END AS class, CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END AS direction,
 CAST(round(l_quantity) AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, epoch_us(l_shipdate) AS arrival_us,
 o_custkey AS wallet, epoch_us(o_orderdate) AS event_us FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def with_ctes(sql: str) -> str:
    """Puts the definitions of the named bindings before the query, which begins with SELECT or with its own `name AS (`."""
    used = [c for name, c in CTES.items() if f" {name} " in f" {sql.replace(chr(10), ' ').replace(')', ' ').replace(',', ' ')} "]
    own = sql.strip()
    recursive = own.startswith("RECURSIVE ")
    own = own.removeprefix("RECURSIVE ")
    if own.startswith("SELECT"):
        return ("WITH " + ",\n".join(used) + "\n" if used else "") + own
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*used, own])


def floored(a: str, b: str) -> str:
    """SQL for the floor of a / b with positive b, where // truncates."""
    return f"(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"

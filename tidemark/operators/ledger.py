"""Ledgers: sums where order doesn't matter, ordered folds where a failure depends on what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import sorted_fold


def requested(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, requested, entries): plain sums, right where no entry can fail."""
    return rows.groupBy(key).agg(F.sum(amount).alias("requested"), F.count("*").alias("entries"))


def cash_fold(rows: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    """(key, entries, balance, failed): entries in order; one that would take the balance below 0 fails and changes nothing.
    A null amount is an entry of 0."""
    step = lambda s, x: (s[0] + 1, s[1], s[2] + 1) if s[1] + x < 0 else (s[0] + 1, s[1] + x, s[2])
    return sorted_fold(rows, [key], order, amount, (0, 0, 0), step, ["entries", "balance", "failed"], False)


def decisions(log: DataFrame, enter: str, leave: str) -> DataFrame:
    """Per portfolio of (portfolio, asset, event_type, price, arrival_us, event_id): cash change, entries, exits and what the
    latest row of each asset says is open."""
    latest = log.groupBy("portfolio", "asset").agg(F.max_by(F.struct("event_type", "price"), F.struct("arrival_us", "event_id")).alias("l"))
    open_ = latest.groupBy("portfolio").agg(F.count_if(F.col("l.event_type") == enter).alias("open_assets"), F.coalesce(F.sum(F.when(F.col("l.event_type") == enter, F.col("l.price"))), F.lit(0)).cast("long").alias("open_amount"))
    kind = F.col("event_type")
    cash = log.groupBy("portfolio").agg(F.sum(F.when(kind == enter, -F.col("price")).when(kind == leave, F.col("price")).otherwise(0)).alias("cash_change"), F.count_if(kind == enter).alias("entries"), F.count_if(kind == leave).alias("exits"))
    return cash.join(open_, "portfolio")

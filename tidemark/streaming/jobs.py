"""Structured Streaming jobs over an event log: duplicates, quality, labels, positions, decisions and reorganisations.

The two clocks stay apart: the watermark follows arrival, which decides when something is known; event
time is data.  A late event is not dropped: it appears in views as of its arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.integers import floor_div
from tidemark.sources.shared import cut, small_or_shuffled

#: State stores of stateful processors.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_arrival_clock(stream: DataFrame, arrival_us: str = "arrival_us", delay: str = "1 day") -> DataFrame:
    """`stream` with received_time as watermark."""
    return stream.withColumn("received_time", F.timestamp_micros(F.col(arrival_us))).withWatermark("received_time", delay)


def deduplicated(stream: DataFrame, key: list[str]) -> DataFrame:
    """First delivery of each logical key within the watermark; nulls in a key part count as a value."""
    marked = stream.withColumn("__key", F.to_json(F.struct(*[F.col(c) for c in key]), {"ignoreNullFields": "false"}))
    return marked.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def quality(stream: DataFrame, interval: str = "15 seconds", status: str = "status", event_us: str = "event_us", arrival_us: str = "arrival_us") -> DataFrame:
    """Per tumbling window of arrival: events, quarantined and mean delay."""
    delay = F.greatest(F.lit(0), F.col(arrival_us) - F.col(event_us)) / 1_000_000
    out = stream.groupBy(F.window("received_time", interval)).agg(F.count("*").alias("events"), F.count_if(F.col(status) == "quarantined").alias("quarantined"), F.avg(delay).alias("mean_delay"))
    return out.select(F.unix_micros("window.start").alias("from_us"), "events", "quarantined", "mean_delay")


_ENDS = pa.schema([("end_pool", pa.int64()), ("end_us", pa.int64()), ("end_arrival_us", pa.int64()), ("end_id", pa.int64()), ("end_price", pa.int64())])
_WAITING = pa.schema([("point_id", pa.int64()), ("pool", pa.int64()), ("horizon", pa.int64()), ("target_us", pa.int64()), ("event_us", pa.int64()), ("arrival_us", pa.int64()), ("price", pa.int64()), ("status", pa.int8()), ("end_id", pa.int64()), ("revision", pa.int64())])
_STATUS = ["unresolved", "censored", "observed"]
LABELS = "point_id long, pool long, horizon long, status string, end_id long, observed_us long, start_price long, end_price long, revision long"


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(state: Any, schema: pa.Schema) -> pd.DataFrame:
    return pa.ipc.open_stream(state.get()[0]).read_all().to_pandas() if state.exists() else schema.empty_table().to_pandas()


class ForwardLabels(StatefulProcessor):
    """Labels of the points of one (share of the pools, bucket of target times): unresolved when first seen, observed with the
    first end of the pool's window that arrived after the point, censored by a timer once the arrival clock passes the
    target; a later arrival that is an earlier end, or an end of a censored point, revises the label.  Emits each change
    with its revision.

    State is what the bucket's points and ends need.  With `forget_us` a bucket is dropped that long after its last
    target; without it, arbitrarily late ends still revise.
    """

    def __init__(self, delay_us: int, forget_us: int | None = None):
        self.delay, self.forget = delay_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.ends = handle.getValueState("ends", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ends = pd.concat([_unpacked(self.ends, _ENDS), new[~new.is_point][["pool", "event_us", "arrival_us", "point_id", "price"]].set_axis(_ENDS.names, axis=1)])
        ends = ends.drop_duplicates(["end_pool", "end_id"]).sort_values(["end_pool", "end_us", "end_arrival_us", "end_id"], ignore_index=True)
        points = new[new.is_point][["point_id", "pool", "horizon", "target_us", "event_us", "arrival_us", "price"]].assign(status=0, end_id=-1, revision=-1)
        waiting = pd.concat([_unpacked(self.waiting, _WAITING), points]).drop_duplicates(["pool", "point_id", "horizon"], ignore_index=True)
        self.ends.update((_packed(ends, _ENDS),))
        yield from self._mature(key, waiting, ends, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._mature(key, _unpacked(self.waiting, _WAITING), _unpacked(self.ends, _ENDS), timerValues.getCurrentWatermarkInMs())

    def _first_ends(self, waiting: pd.DataFrame, ends: pd.DataFrame) -> np.ndarray:
        """The place of each point's end among the ordered ends, -1 for none."""
        # Ends are ordered by pool and time: the ranks of both, as one number, keep that order.
        pools, times = np.unique(ends.end_pool.to_numpy()), np.unique(ends.end_us.to_numpy())
        width = len(times) + 1
        keys = np.searchsorted(pools, ends.end_pool.to_numpy()) * width + np.searchsorted(times, ends.end_us.to_numpy())
        pool = waiting.pool.to_numpy()
        own = np.searchsorted(pools, pool)
        known_pool = own < len(pools)
        known_pool[known_pool] = pools[own[known_pool]] == pool[known_pool]
        at = np.searchsorted(keys, own * width + np.searchsorted(times, np.maximum(waiting.target_us, waiting.event_us + 1).to_numpy()))
        last = np.searchsorted(keys, own * width + np.searchsorted(times, (waiting.target_us + self.delay).to_numpy(), side="right"))
        last = np.where(known_pool, last, at)
        known, arrived = waiting.arrival_us.to_numpy(), ends.end_arrival_us.to_numpy()
        open_ = np.flatnonzero(at < last)
        while len(open_):
            open_ = open_[arrived[at[open_]] <= known[open_]]
            at[open_] += 1
            open_ = open_[at[open_] < last[open_]]
        return np.where(at < last, at, -1)

    def _mature(self, key: Any, waiting: pd.DataFrame, ends: pd.DataFrame, clock_ms: int) -> Iterator[pd.DataFrame]:
        if not len(waiting):
            return
        place = self._first_ends(waiting, ends)
        due = np.maximum(waiting.target_us, waiting.arrival_us).to_numpy()
        status = np.where(place >= 0, 2, np.where(due <= clock_ms * 1000, 1, 0)).astype(np.int8)
        end_id = np.where(place >= 0, ends.end_id.to_numpy()[place] if len(ends) else -1, -1)
        changed = (waiting.revision < 0).to_numpy() | (status != waiting.status.to_numpy()) | (end_id != waiting.end_id.to_numpy())
        waiting = waiting.assign(status=status, end_id=end_id, revision=waiting.revision + changed)
        pending = due[status == 0]
        if len(pending):
            self.handle.registerTimer(int(-(-pending.min() // 1000)))
        elif self.forget is not None:
            until = -(-int(due.max() + self.delay + self.forget) // 1000)
            if until <= clock_ms:
                self.waiting.clear()
                self.ends.clear()
            else:
                self.handle.registerTimer(until)
        if len(pending) or self.forget is None or until > clock_ms:
            self.waiting.update((_packed(waiting, _WAITING),))
        out = waiting[changed]
        if not len(out):
            return
        ended, where = out.status == 2, place[changed]
        pick = lambda c: pd.Series(np.where(ended, ends[c].to_numpy()[where], 0) if len(ends) else 0, out.index).where(ended).astype("Int64")
        observed = pick("end_arrival_us").fillna(np.maximum(out.target_us, out.arrival_us).where(out.status == 1, out.target_us)).astype("int64")
        yield pd.DataFrame({
            "point_id": out.point_id, "pool": out.pool, "horizon": out.horizon, "status": pd.Series([_STATUS[s] for s in out.status], out.index, dtype=object), "end_id": pick("end_id"),
            "observed_us": observed, "start_price": out.price, "end_price": pick("end_price"), "revision": out.revision,
        })

    def close(self) -> None:
        pass


def forward_labels(stream: DataFrame, horizons: list[int], delay_us: int, width_us: int | None = None, forget_us: int | None = None, shares: int = 200) -> DataFrame:
    """Label changes (`LABELS`) of a stream (point_id, pool, event_us, arrival_us, price, is_point) with a watermark on the column
    received_time, the arrival clock.  Every row is an end of others; rows with is_point get labels.

    A point goes to the bucket of its target, an event to the buckets whose points' windows can hold it (at most two, as
    `width_us` is at least the delay), so that a busy pool is spread over its buckets and one key decides each label.  A key
    is one of `shares` of the pools in a bucket, so that a task handles the pools of a share together; more shares make
    smaller states.  The number of shares stays as it is over the runs of a checkpoint.
    """
    width = max(width_us or delay_us, delay_us, 1)
    points = stream.where("is_point").withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    points = points.withColumn("target_us", F.col("event_us") + F.col("horizon")).withColumn("bucket", floor_div(F.col("target_us"), width))
    nothing = F.lit(None).cast("long")
    ends = stream.withColumn("is_point", F.lit(False)).withColumn("horizon", nothing).withColumn("target_us", nothing)
    ends = ends.withColumn("bucket", F.explode(F.array_distinct(F.array(floor_div(F.col("event_us") - delay_us, width), floor_div(F.col("event_us"), width)))))
    names = ["share", "bucket", "pool", "is_point", "point_id", "horizon", "target_us", "event_us", "arrival_us", "price", "received_time"]
    share = F.pmod(F.xxhash64("pool"), F.lit(shares)).alias("share")
    keyed = points.select(share, *names[1:]).unionByName(ends.select(share, *names[1:]))
    return keyed.groupBy("share", "bucket").transformWithStateInPandas(ForwardLabels(delay_us, forget_us), LABELS, "append", "eventTime")


class Positions(StatefulProcessor):
    """Liquidity per (wallet, position): a running sum held at 0; going below marks it uncertain.  Emits each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "liquidity long, uncertain boolean, steps long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        liquidity, uncertain, steps = self.state.get() if self.state.exists() else (0, False, 0)
        batch = pd.concat(list(rows)).sort_values(["arrival_us", "event_id"])
        for delta in batch["delta"].tolist():
            uncertain = uncertain or liquidity + delta < 0
            liquidity, steps = max(0, liquidity + delta), steps + 1
        self.state.update((int(liquidity), bool(uncertain), int(steps)))
        yield pd.DataFrame({"pool": [key[0]], "liquidity": [liquidity], "uncertain": [uncertain], "steps": [steps]})

    def close(self) -> None:
        pass


def positions(stream: DataFrame) -> DataFrame:
    """Changes of (pool, liquidity, uncertain, steps) of a stream (pool, event_id, arrival_us, delta)."""
    return stream.groupBy("pool").transformWithStateInPandas(Positions(), "pool long, liquidity long, uncertain boolean, steps long", "update", "none")


class Lifecycle(StatefulProcessor):
    """A position's life: open, resize, collect, remove, each at most once per action id.

    Emits a verdict per action: applied, duplicate, orphan (before open), superseded (after remove) or failed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("life", "stage string, liquidity long, gas long")
        self.seen = handle.getListState("seen", "action_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A call of the state store costs more than a row: each state is read once and written once.
        known = self.state.exists()
        stage, liquidity, gas = self.state.get() if known else ("none", 0, 0)
        seen = {r[0] for r in self.seen.get()} if known else set()
        out, new = [], []
        for row in pd.concat(list(rows)).sort_values(["arrival_us", "action_id"]).itertuples():
            if row.action_id in seen:
                out.append((key[0], row.action_id, "duplicate", liquidity, gas))
                continue
            seen.add(row.action_id)
            new.append((row.action_id,))
            gas += int(row.gas)
            if row.failed:
                verdict = "failed"
            elif row.action == "open" and stage == "none":
                stage, liquidity, verdict = "open", int(row.delta), "applied"
            elif stage == "none":
                verdict = "orphan"
            elif stage == "removed":
                verdict = "superseded"
            elif row.action == "remove":
                stage, liquidity, verdict = "removed", 0, "applied"
            else:
                liquidity, verdict = max(0, liquidity + (int(row.delta) if row.action in ("resize", "open") else 0)), "applied"
            out.append((key[0], row.action_id, verdict, liquidity, gas))
        self.state.update((stage, int(liquidity), int(gas)))
        if new:
            self.seen.appendList(new)
        yield pd.DataFrame(out, columns=["position_id", "action_id", "verdict", "liquidity", "gas"])

    def close(self) -> None:
        pass


def lifecycles(stream: DataFrame) -> DataFrame:
    """Verdicts of a stream (position_id, action_id, action, delta, gas, failed, arrival_us)."""
    return stream.groupBy("position_id").transformWithStateInPandas(Lifecycle(), "position_id long, action_id long, verdict string, liquidity long, gas long", "append", "none")


class Decisions(StatefulProcessor):
    """One decision per observation and portfolio with shared cash: duplicates return the first, older input is rejected."""

    def __init__(self, ticket: int, cash: int):
        self.ticket, self.start = ticket, cash

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cash", "cash long, last long")
        self.open = handle.getListState("open", "asset long, amount long")
        self.done = handle.getListState("done", "observation_id long, decision string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A call of the state store costs more than a row: each state is read once and written once.
        known = self.state.exists()
        cash, last = self.state.get() if known else (self.start, -1)
        open_ = {r[0]: r[1] for r in self.open.get()} if known else {}
        done = {r[0]: r[1] for r in self.done.get()} if known else {}
        before, out, new = dict(open_), [], []
        for row in pd.concat(list(rows)).sort_values(["arrival_us", "observation_id"]).itertuples():
            if row.observation_id in done:
                out.append((key[0], row.observation_id, done[row.observation_id], True, cash))
                continue
            held = row.asset in open_
            if row.arrival_us < last:
                verdict = "rejected_out_of_order"
            elif row.expected > row.uncertainty and not held and cash >= self.ticket:
                verdict, cash = "enter", cash - self.ticket
                open_[row.asset] = self.ticket
            elif held and row.expected < -row.uncertainty:
                verdict, cash = "exit", cash + open_.pop(row.asset)
            else:
                verdict = "hold" if held else "watch"
            last = max(last, row.arrival_us)
            done[row.observation_id] = verdict
            new.append((row.observation_id, verdict))
            out.append((key[0], row.observation_id, verdict, False, cash))
        self.state.update((int(cash), int(last)))
        if open_ != before:
            if open_:
                self.open.put([(int(asset), int(amount)) for asset, amount in open_.items()])
            else:
                self.open.clear()
        if new:
            self.done.appendList(new)
        yield pd.DataFrame(out, columns=["portfolio", "observation_id", "decision", "repeated", "cash"])

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, ticket: int, cash: int) -> DataFrame:
    """Decisions of a stream (portfolio, observation_id, asset, expected, uncertainty, arrival_us)."""
    return stream.groupBy("portfolio").transformWithStateInPandas(Decisions(ticket, cash), "portfolio long, observation_id long, decision string, repeated boolean, cash long", "append", "none")


def confirmed_only(stream: DataFrame, block: str, head: int, lag: int) -> DataFrame:
    """Events at least `lag` blocks behind the head; the stream of `sources.pages` stays behind it at the source."""
    return stream.where(F.col(block) <= head - lag)


#: Ranges that one micro-batch may touch so that they are named as literals, which prune partitions.
MOST_RANGES = 2000


class RangeStore:
    """A raw log and its canonical projection by (source, range), in three folders under `path`.

    raw: every row ever seen, by source, range and batch.  canonical: the projection of a range, a version a replay, by
    source, range and version.  manifest: for each replay of a range a mark `needs_repair` before it and a row `canonical`
    after it, with the version, the range's tip and its canonical rows.  The newest row of a range is its state: a replay
    that failed leaves the mark, and a range without canonical rows has a version without files.
    """

    def __init__(self, spark: SparkSession, path: str, project: Callable[[DataFrame], DataFrame], tip: Column):
        self.spark, self.project, self.tip = spark, project, tip
        self.raw, self.canonical, self.manifest = f"{path}/raw", f"{path}/canonical", f"{path}/manifest"

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def state(self) -> DataFrame:
        """(source, range, status, version, tip, rows): the newest manifest row of each range."""
        rows = self.spark.read.parquet(self.manifest)
        newest = F.max_by(F.struct("status", "version", "tip", "rows"), F.struct("version", F.col("status") == "canonical"))
        return rows.groupBy("source", "range").agg(newest.alias("s")).select("source", "range", "s.*")

    def current(self) -> DataFrame:
        """The canonical rows of every range's last finished replay."""
        done = self.spark.read.parquet(self.manifest).where("status = 'canonical'").groupBy("source", "range").agg(F.max("version").alias("version"))
        # One row a range.
        return self.spark.read.parquet(self.canonical).join(small_or_shuffled(done), ["source", "range", "version"], "left_semi").drop("version")

    def _mark(self, rows: DataFrame, number: int) -> None:
        rows.select("source", "range", "status", "version", "tip", "rows").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(self.manifest)

    def _of_ranges(self, stored: DataFrame, ranges: DataFrame) -> DataFrame:
        """The stored rows of some ranges; literal keys let Spark list and read their partitions only."""
        keys = ranges.limit(MOST_RANGES + 1).collect()
        if len(keys) <= MOST_RANGES:
            stored = stored.where(F.col("source").isin([k["source"] for k in keys]) & F.col("range").isin([k["range"] for k in keys]))
        return stored.join(small_or_shuffled(ranges), ["source", "range"], "left_semi")

    def store(self, batch: DataFrame, number: int) -> None:
        """Store a micro-batch and replay the ranges that it touches and those whose last replay failed.  A batch that runs again
        writes the same files."""
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "range", "batch").parquet(self.raw)
        keys = batch.select("source", "range").distinct()
        kinds = batch.withColumn("batch", F.lit(number)).schema
        if self._exists(self.manifest):
            broken = self.state().where("status = 'needs_repair'").select(*[F.col(c).cast(kinds[c].dataType) for c in ("source", "range")])
            keys = keys.union(broken).distinct()
        touched = cut(keys, "ranges")
        if touched.isEmpty():
            return
        stored = self._of_ranges(self.spark.read.schema(kinds).parquet(self.raw), touched).where(F.col("batch") <= number)
        # Tips are known even where no row is canonical.
        tips = cut(stored.groupBy("source", "range").agg(self.tip.cast("string").alias("tip")), "tips")
        version = F.lit(number).cast("long").alias("version")
        self._mark(tips.select("source", "range", F.lit("needs_repair").alias("status"), version, "tip", F.lit(None).cast("long").alias("rows")), number)
        replayed = self.project(stored.drop("batch")).withColumn("version", F.lit(number).cast("long"))
        replayed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "range", "version").parquet(self.canonical)
        written = self.spark.read.schema(replayed.schema).parquet(self.canonical).where(F.col("version") == number).groupBy("source", "range").agg(F.count("*").alias("rows"))
        done = tips.join(written, ["source", "range"], "left").select("source", "range", F.lit("canonical").alias("status"), version, "tip", F.coalesce("rows", F.lit(0)).alias("rows"))
        self._mark(done, number)


def repair_on_reorg(stream: DataFrame, store: RangeStore, checkpoint: str) -> StreamingQuery:
    """Keeps a stream (source, range, ...) and its canonical projection in a range store, micro-batch by micro-batch."""
    return stream.writeStream.foreachBatch(store.store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All input there is, written as Parquet at `path`; a second run on the same checkpoint takes only what is new.
    Update mode writes each batch's changes beside its batch number, so that a repeated batch replaces itself."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()


def run_until_idle(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to Parquet at `path`, trigger by trigger, until its source has nothing more.  For sources that limit what
    a trigger takes: a run for what is available now would take one such part."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).format("parquet").outputMode("append").start(path)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (one file or a folder) as a stream, in the table's own schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern: the file source takes a plain path for a folder.
    return reader.parquet(f"{path}*")

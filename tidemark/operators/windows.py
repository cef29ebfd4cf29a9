"""Orderings and folds: global ranks without one task, latest rows, gaps, ordered folds with floors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div


def global_row_number(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """`df` with the place (from 1) of each row in a total order, without sorting everything in one task.

    The first order column (a number) is cut into ranges at its approximate quantiles; rows are ranked
    inside a range, and the sizes of the ranges before are added.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.select(F.percentile_approx(order[0], [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    ranged = df.withColumn("__range", range_number(F.col(order[0]), cuts))
    sizes = ranged.groupBy("__range").count()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__place") + F.col("__start")).cast("long")).drop("__range", "__place", "__start")


def range_number(value: Column, cuts: list, first: int = 0) -> Column:
    """How many of the sorted cuts are at most `value`, by a balanced tree of comparisons; 0 for null."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(value >= F.lit(cuts[middle]), range_number(value, cuts[middle + 1 :], first + middle + 1)).otherwise(range_number(value, cuts[:middle], first))


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def row_range_partition(df: DataFrame, order: list[str], part: int, parts: int) -> DataFrame:
    """The part-th of so many contiguous, balanced ranges of the rows in order, with their ordinal from 0."""
    numbered = global_row_number(df, order, "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    total = numbered.agg(F.count("*").alias("__n"))
    low, high = floor_div(F.col("__n") * part, parts), floor_div(F.col("__n") * (part + 1), parts)
    return numbered.crossJoin(F.broadcast(total)).where((F.col("ordinal") >= low) & (F.col("ordinal") < high)).drop("__n")


def gap_ranges(covered: DataFrame, low: str, high: str, key: list[str]) -> DataFrame:
    """(key, gap_start, gap_end) between the merged intervals of each key: a running maximum of ends, no explode."""
    order = Window.partitionBy(*key).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return covered.select(*key, (reach + 1).alias("gap_start"), (F.col(low) - 1).alias("gap_end")).where("gap_start <= gap_end")


def outage_gaps(beats: DataFrame, key: list[str], at: str, interval: int) -> DataFrame:
    """Beats whose distance from the one before is over twice the interval."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at))
    return beats.withColumn("gap", gap).where(F.col("gap") > 2 * interval)


def sorted_fold(df: DataFrame, key: list[str], order: list[str], value: str, start: tuple[int, ...], step: Callable[[tuple[int, ...], int], tuple[int, ...]], columns: list[str], every: bool) -> DataFrame:
    """(key, columns): the state after each row of a key in order (`every`), or after its last row.

    For folds whose next state depends on all before it.  A key's rows are sorted by Spark and pass through one task as a
    stream, which holds one state; nothing is gathered.  Other keys go to other tasks.
    """
    rows = df.select(*key, *order, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("step value")).repartition(*key).sortWithinPartitions(*key, *order)
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, start, None

        def pack(keys: list[tuple], states: list[tuple[int, ...]]) -> pa.RecordBatch:
            arrays = [pa.array([k[i] for k in keys], kinds[i]) for i in range(n)] + [pa.array([s[i] for s in states], pa.int64()) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays(arrays, [*key, *columns])

        for batch in batches:
            kinds, keys, states = batch.schema.types[:n], [], []
            for one, x in zip(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if one != now:
                    if now is not None and not every:
                        keys.append(now)
                        states.append(state)
                    now, state = one, start
                state = step(state, x)
                if every:
                    keys.append(one)
                    states.append(state)
            yield pack(keys, states)
        if now is not None and not every:
            yield pack([now], [state])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key], *[f"{c} long" for c in columns]]))


def equity_curve(cases: DataFrame, key: list[str], order: list[str], bps: str, start: int) -> DataFrame:
    """(key, step, equity) of every case: e <- max(0, e + floor(e * bps / 10000)) in order."""
    step = lambda s, x: (s[0] + 1, max(0, s[1] + s[1] * x // 10_000))
    return sorted_fold(cases, key, order, bps, (0, start), step, ["step", "equity"], True)


def max_drawdown_bps(points: DataFrame, key: list[str], order: list[str], equity: str) -> DataFrame:
    """(key, drawdown_bps): the largest floored fall below the running peak."""
    peak = F.max(equity).over(Window.partitionBy(*key).orderBy(*order))
    fall = F.when(peak > 0, floor_div((peak - F.col(equity)) * 10_000, peak)).otherwise(0)
    return points.withColumn("__fall", fall).groupBy(*key).agg(F.max("__fall").alias("drawdown_bps"))


def clamped_position(rows: DataFrame, key: list[str], order: list[str], delta: str) -> DataFrame:
    """(key, liquidity, uncertain, steps): running sum of deltas that is held at 0 or above; going below makes it uncertain.

    A sum held at 0 equals the plain running sum less its smallest value, where that is below 0, so no
    key's rows are gathered into a list.
    """
    total = F.sum(F.col(delta).cast("long")).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("__s", total).groupBy(*key).agg(F.max_by("__s", F.struct(*order)).alias("__last"), F.min("__s").alias("__low"), F.count("*").alias("steps"))
    low = F.least(F.col("__low"), F.lit(0))
    return summed.select(*key, (F.col("__last") - low).alias("liquidity"), (F.col("__low") < 0).alias("uncertain"), "steps")

"""The range store: ranges that lose all canonical rows, failed replays, repeated batches, pruned reads."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans.stream import newest_lineage
from tidemark.streaming.jobs import RangeStore

SCHEMA = "event_id long, source long, range long, block long, lineage long, status string"


@pytest.fixture
def store(spark, tmp_path):
    return RangeStore(spark, str(tmp_path / "store"), newest_lineage, F.max("lineage"))


def ids(store):
    return sorted(r.event_id for r in store.current().collect())


def states(store):
    return {(int(r.source), int(r.range)): (r.status, r.version, r.tip, r.rows) for r in store.state().collect()}


def batch(spark, lineage, status, first=0, ranges=(0,)):
    return spark.createDataFrame([(first + 10 * r + i, 1, r, 10 * r + i, lineage, status) for r in ranges for i in range(5)], SCHEMA)


def test_range_without_canonical_rows_is_emptied(spark, store):
    store.store(batch(spark, 0, "canonical", ranges=(0, 1)), 0)
    assert ids(store) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    store.store(batch(spark, 1, "orphaned", 100), 1)
    assert ids(store) == [10, 11, 12, 13, 14]
    assert states(store) == {(1, 0): ("canonical", 1, "1", 0), (1, 1): ("canonical", 0, "0", 5)}
    store.store(batch(spark, 2, "canonical", 200), 2)
    assert ids(store) == [10, 11, 12, 13, 14, 200, 201, 202, 203, 204] and states(store)[1, 0] == ("canonical", 2, "2", 5)


def test_failed_replay_leaves_a_mark_and_is_repaired_later(spark, store):
    store.store(batch(spark, 0, "canonical", ranges=(0, 1)), 0)
    good = store.project

    def fails(rows):
        raise RuntimeError("replay failed")

    store.project = fails
    with pytest.raises(RuntimeError):
        store.store(batch(spark, 1, "canonical", 100), 1)
    # Readers still see the last finished replay; the mark names the new tip.
    assert ids(store) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14] and states(store)[1, 0][:3] == ("needs_repair", 1, "1")
    store.project = good
    # Another range comes; the marked one is replayed as well.
    store.store(batch(spark, 1, "canonical", 100, ranges=(1,)), 2)
    assert ids(store) == [100, 101, 102, 103, 104, 110, 111, 112, 113, 114]
    assert {s[0] for s in states(store).values()} == {"canonical"}


def test_repeated_batch_changes_nothing(spark, store):
    for _ in range(2):
        store.store(batch(spark, 0, "canonical"), 0)
    assert ids(store) == [0, 1, 2, 3, 4] and spark.read.parquet(store.raw).count() == 5


def test_empty_batch(spark, store):
    store.store(batch(spark, 0, "canonical").limit(0), 0)
    store.store(batch(spark, 0, "canonical"), 1)
    assert ids(store) == [0, 1, 2, 3, 4]


def test_only_touched_partitions_are_read(spark, store):
    for n in range(3):
        store.store(batch(spark, n, "canonical", 100 * n, ranges=(n,)), n)
    touched = spark.createDataFrame([(1, 2)], "source long, range long")
    stored = store._of_ranges(spark.read.parquet(store.raw), touched)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", stored._jdf.queryExecution().executedPlan().toString())[1]
    assert "source#" in filters and "range#" in filters
    assert {r.range for r in stored.collect()} == {2}

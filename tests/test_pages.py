"""The paged log source: halving, refusals, confirmed blocks only, and two runs on one checkpoint."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import sources
from tidemark.sources import pages

OPTIONS = {"columns": "block,event_id,event_type,pool,event_us", "rows": sources._LOG}


class Provider:
    """Gives the block numbers, at most `most` of them at once."""

    def __init__(self, most=10**9, rows=None):
        self.most, self.given, self.asked = most, rows, []

    def head(self):
        return 10**6

    def rows(self, low, high):
        self.asked.append((low, high))
        if high - low >= self.most:
            raise OSError("too many logs")
        return [(b,) for b in range(low, high + 1)] if self.given is None else self.given


@pytest.fixture
def log(spark, tmp_path):
    """Blocks 0 to 99 with two events each."""

    def append(low, high):
        rows = spark.range(2 * low, 2 * high + 2).select(F.expr("id div 2").alias("block"), F.col("id").alias("event_id"), F.lit("e").alias("event_type"), F.lit(1).cast("long").alias("pool"), F.lit(0).cast("long").alias("event_us"))
        rows.repartitionByRange(3, "block").write.mode("append").parquet(f"{tmp_path}/log")

    append(0, 99)
    append.path = str(tmp_path)
    return append


def test_pages_halve_on_failure():
    p = Provider(4)
    found = list(pages.fetch(p, 0, 15))
    assert [r for _, _, rows in found for r in rows] == [(b,) for b in range(16)] and [f[:2] for f in found] == [(0, 3), (4, 7), (8, 11), (12, 15)]
    assert p.asked[0] == (0, 15)
    p = Provider(0)
    with pytest.raises(OSError):
        list(pages.fetch(p, 0, 3))
    assert p.asked[-1] == (0, 0)


def test_rows_of_other_blocks_and_repeated_rows_are_refused():
    with pytest.raises(ValueError, match="came with page"):
        list(pages.fetch(Provider(rows=[(99,)]), 0, 3))
    with pytest.raises(ValueError, match="repeated rows"):
        list(pages.fetch(Provider(rows=[(2,), (2,)]), 0, 3))


def test_batch_reads_each_row_once(spark, log):
    spark.dataSource.register(pages.LogPages)
    options = OPTIONS | {"path": f"{log.path}/log", "start": 5, "end": 27, "page": 10, "most": 6, "rows": f"{sources._LOG}, page_low long, page_high long"}
    df = spark.read.format("log_pages").options(**options).load()
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 3 and sorted(r.event_id for r in rows) == list(range(10, 56))
    assert all(r.page_low <= r.block <= r.page_high and r.page_high - r.page_low < 3 for r in rows)


def test_transport(log, tmp_path):
    read = pages.ParquetLog(OPTIONS | {"path": f"file:{log.path}/log", "most": "4"})
    assert read.head() == 99 and [r[1] for r in read.rows(3, 4)] == [6, 7, 8, 9]
    with pytest.raises(pages.PageTooLarge):
        read.rows(3, 6)
    nothing = pages.ParquetLog(OPTIONS | {"path": f"{tmp_path}/none"})
    assert nothing.head() == -1 and nothing.rows(0, 9) == []


def test_two_runs_take_disjoint_blocks_behind_the_head(spark, log):
    run = lambda: sources.tail_log(spark, f"{log.path}/log", f"{log.path}/out", f"{log.path}/cp", 30)
    stored = lambda: sorted(r.event_id for r in spark.read.schema(sources._LOG).parquet(f"{log.path}/out").collect())
    run()
    assert stored() == list(range(2 * 88))
    run()
    assert stored() == list(range(2 * 88))
    log(100, 149)
    run()
    # The blocks near the first head come now, none twice.
    assert stored() == list(range(2 * 138))
    batches = spark.read.schema(sources._LOG).parquet(f"{log.path}/out").groupBy(F.input_file_name()).agg((F.max("block") - F.min("block")).alias("w"))
    assert batches.agg(F.max("w")).first()[0] < 30


def test_offset_is_capped_and_never_falls(log):
    schema = type("Schema", (), {"names": ["block"]})
    tail = pages._Tail(OPTIONS | {"path": f"{log.path}/log", "lag": "12", "max_blocks": "50"}, schema)
    assert tail.latestOffset() == {"block": 50} == tail.latestOffset()
    assert [(p.low, p.high) for p in tail.partitions({"block": 0}, {"block": 50})] == [(0, 49)] and tail.latestOffset() == {"block": 88}
    tail.partitions({"block": 50}, {"block": 88})
    tail.options["lag"] = "60"
    assert tail.latestOffset() == {"block": 88} and tail.partitions({"block": 88}, {"block": 88}) == []


def test_a_task_reads_its_pages_and_their_halves_from_row_groups_read_once(spark, log, monkeypatch):
    spark.dataSource.register(pages.LogPages)
    options = OPTIONS | {"path": f"{log.path}/log", "start": 5, "end": 27, "page": 10, "task_pages": 2, "most": 6, "rows": f"{sources._LOG}, page_low long, page_high long"}
    df = spark.read.format("log_pages").options(**options).load()
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 2 and sorted(r.event_id for r in rows) == list(range(10, 56))
    # Pages are the same as with a task a page.
    alone = spark.read.format("log_pages").options(**options | {"task_pages": 1}).load().collect()
    assert sorted(rows) == sorted(alone)
    read, opened = pages.ParquetLog(OPTIONS | {"path": f"{log.path}/log", "most": "4"}), []
    monkeypatch.setattr(pages.ParquetLog, "_sorted", lambda self, k, old=pages.ParquetLog._sorted: opened.append(k) or old(self, k))
    assert [r[1] for _, _, found in pages.fetch(read, 0, 99) for r in found] == list(range(200))
    assert sorted(opened) == list(range(len(read._row_groups())))

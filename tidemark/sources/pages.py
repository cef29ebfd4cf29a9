"""Paged log sources: a batch reader with a partition for some pages, and a stream reader that stays behind the head.

A transport gives a log's rows by block range.  It is made on executors (and on the driver for its head) by a function
`module:function` of the options, and has `head()`, the newest block or -1, and `rows(low, high)`, tuples whose first value
is the block.  `parquet_log` is one: the log is a folder of Parquet files to which another job appends.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.integers import floor_div


class Transport(Protocol):
    def head(self) -> int: ...

    def rows(self, low: int, high: int) -> list[tuple]: ...


class PageTooLarge(Exception):
    """A page holds more rows than the transport gives at once."""


class ParquetLog:
    """Options: path (a folder that driver and executors share), columns (the block's first, comma-joined), most (rows given at
    once, unlimited by default).  Statistics of row groups decide which of them a page opens.  The row groups of the last page
    stay in memory, sorted by block, so that its halves and the pages after it don't read them again."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        fs, path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True))
        self._files, self._fs = sorted(f.path for f in found if f.path.endswith(".parquet")), fs
        self._columns = options["columns"].split(",")
        self._most = int(options["most"]) if "most" in options else None
        self._pieces: list[tuple[int, int, ds.ParquetFileFragment]] | None = None
        self._held: dict[int, tuple[pa.Table, np.ndarray]] = {}

    def _row_groups(self) -> list[tuple[int, int, ds.ParquetFileFragment]]:
        """(first block, last block, row group) of the log, known once."""
        if self._pieces is None:
            block, self._pieces = self._columns[0], []
            for path in self._files:
                for piece in ds.ParquetFileFormat().make_fragment(path, self._fs).split_by_row_group():
                    known = (piece.row_groups[0].statistics or {}).get(block)
                    if known is not None:
                        self._pieces.append((known["min"], known["max"], piece))
                    elif piece.row_groups[0].num_rows:
                        blocks = piece.to_table(columns=[block]).column(0)
                        if blocks.null_count < len(blocks):
                            self._pieces.append((pc.min(blocks).as_py(), pc.max(blocks).as_py(), piece))
        return self._pieces

    def head(self) -> int:
        return max((last for _, last, _ in self._row_groups()), default=-1)

    def rows(self, low: int, high: int) -> list[tuple]:
        touched = [k for k, (first, last, _) in enumerate(self._row_groups()) if first <= high and last >= low]
        # Pages ascend: only row groups before this one are done with.
        self._held = {k: v for k, v in self._held.items() if self._row_groups()[k][1] >= low}
        self._held |= {k: self._sorted(k) for k in touched if k not in self._held}
        found = []
        for table, blocks in (self._held[k] for k in touched):
            start = np.searchsorted(blocks, low)
            found.append(table.slice(start, np.searchsorted(blocks, high, side="right") - start))
        count = sum(len(t) for t in found)
        if self._most is not None and count > self._most:
            raise PageTooLarge(f"{count} rows in {low}-{high}")
        return [row for t in found for row in zip(*[c.to_pylist() for c in t.columns], strict=True)]

    def _sorted(self, k: int) -> tuple[pa.Table, np.ndarray]:
        block = self._columns[0]
        table = self._row_groups()[k][2].to_table(columns=self._columns)
        table = table.filter(pc.is_valid(table.column(block))).sort_by(block).combine_chunks()
        return table, table.column(block).to_numpy()


def parquet_log(options: dict[str, str]) -> Transport:
    return ParquetLog(options)


def _transport(options: dict[str, str]) -> Transport:
    module, function = options.get("transport", "tidemark.sources.pages:parquet_log").split(":")
    return getattr(importlib.import_module(module), function)(options)


def fetch(transport: Transport, low: int, high: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """(low, high, rows) of the pages of [low, high]; a page that fails is halved until single blocks, whose failure is an
    error.  Rows must be of the page and come once."""
    try:
        rows = transport.rows(low, high)
    except Exception:
        if low == high:
            raise
        middle = (low + high) // 2
        yield from fetch(transport, low, middle)
        yield from fetch(transport, middle + 1, high)
        return
    for row in rows:
        if not low <= row[0] <= high:
            raise ValueError(f"a row of block {row[0]} came with page {low}-{high}")
    if len(set(rows)) != len(rows):
        raise ValueError(f"page {low}-{high} has repeated rows")
    yield low, high, rows


class Page(InputPartition):
    """Blocks that a task reads, one page after the other."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class LogPages(DataSource):
    """A log by block.  Options: rows (the schema; with the columns page_low and page_high at its end, the page that a row came
    with), page (blocks a page), task_pages (neighbouring pages that a task reads, 1 by default), transport and its options; for a batch start and end (inclusive); for a stream start (the
    first block), lag (blocks that a batch stays behind the head) and max_blocks (a trigger)."""

    @classmethod
    def name(cls) -> str:
        return "log_pages"

    def schema(self) -> str:
        return self.options["rows"]

    def reader(self, schema: Any) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Tail(self.options, schema)


class _Pages:
    def __init__(self, options: dict[str, str], schema: Any):
        self.options, self.size = dict(options), int(options.get("page", 1000))
        self.together = self.size * max(1, int(options.get("task_pages", 1)))
        self.with_page = schema.names[-2:] == ["page_low", "page_high"]

    def pages(self, low: int, high: int) -> list[Page]:
        return [Page(a, min(a + self.together - 1, high)) for a in range(low, high + 1, self.together)]

    def read(self, partition: Page) -> Iterator[tuple]:
        transport = _transport(self.options)
        for first in range(partition.low, partition.high + 1, self.size):
            for low, high, rows in fetch(transport, first, min(first + self.size - 1, partition.high)):
                yield from (row + (low, high) for row in rows) if self.with_page else rows


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(int(self.options["start"]), int(self.options["end"]))


class _Tail(_Pages, DataSourceStreamReader):
    """The offset is the next block.  A restarted query plans its last batch again, which tells where it stands."""

    def __init__(self, options: dict[str, str], schema: Any):
        super().__init__(options, schema)
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"block": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        if self.next is None:
            self.next = self.initialOffset()["block"]
        lag, most = int(self.options.get("lag", 12)), int(self.options.get("max_blocks", 2000))
        confirmed = _transport(self.options).head() - lag + 1
        # Never backwards: a head that falls leaves the offset where it is.
        return {"block": max(self.next, min(confirmed, self.next + most))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.next = end["block"]
        return self.pages(start["block"], end["block"] - 1)

    def commit(self, end: dict) -> None:
        pass


def plan_pages(logs: DataFrame, block: str, size: int, most: int) -> DataFrame:
    """(low, high, logs, repeated): pages of `size` blocks, halved while they hold more than `most` logs.

    Counts per block are halved as bits of the block number, so that all depths come from one aggregation.
    """
    depth = (size - 1).bit_length()
    counted = logs.groupBy(block).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("u"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    at = counted.withColumn("level", levels)
    width = F.expr(f"shiftleft(1L, {depth} - level)")
    ranged = at.withColumn("low", floor_div(F.col(block), F.lit(1)) - F.pmod(F.col(block), width)).withColumn("width", width)
    totals = ranged.groupBy("level", "low", "width").agg(F.sum("n").alias("logs"), F.sum(F.col("n") - F.col("u")).alias("repeated"))
    small = totals.where((F.col("logs") <= most) | (F.col("level") == depth))
    # A page stands if no wider one around it is small enough.
    parents = small.select(F.col("level").alias("pl"), F.col("low").alias("plow"), F.col("width").alias("pw"))
    inner = small.withColumn("pl", F.explode(F.expr("case when level = 0 then array(cast(-1 as int)) else sequence(0, level - 1) end"))).withColumn("plow", F.col("low") - F.expr(f"pmod(low, shiftleft(1L, {depth} - greatest(pl, 0)))"))
    covered = inner.join(parents.drop("pw"), ["pl", "plow"], "left_semi").select("level", "low").distinct()
    return small.join(covered, ["level", "low"], "left_anti").select("low", (F.col("low") + F.col("width") - 1).alias("high"), "logs", "repeated")

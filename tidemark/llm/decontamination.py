"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words and cut into windows of `WINDOW` words (an item
with fewer words is one window); each distinct window is a pattern.  A document is normalised the
same way and scanned once; the ends of the matches give the hit words, whose offsets in the original
text follow from the order of the words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches

WINDOW = 10
#: A set of items is split so that the patterns of one automaton have at most this many bytes (about
#: 40 times as much memory); each part is one more scan inside the same pass over the documents.
PATTERN_BYTES = 16 << 20
#: Text of a test set that may be broadcast as windows (each word is in up to `WINDOW` of them).
ITEM_BYTES = 32 << 20

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows_of(items: Iterable[tuple[object, str | None]]) -> dict[bytes, set[str]]:
    """Pattern (words between single spaces) to the ids of the items that have it."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        if item is None:
            continue
        words = words_of(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            found[b" " + b" ".join(words[i : i + WINDOW]) + b" "].add(str(item))
    return found


def build_automata(windows: dict[bytes, set[str]]) -> list[ahocorasick.Automaton]:
    out, size = [], PATTERN_BYTES + 1
    for pattern in sorted(windows):
        if size > PATTERN_BYTES:
            out.append(ahocorasick.Automaton())
            size = 0
        out[-1].add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, tuple(sorted(windows[pattern]))))
        size += len(pattern)
    for automaton in out:
        automaton.make_automaton()
    return out


_BUILT: dict[int, list[ahocorasick.Automaton]] = {}


def automata_of(shared: Broadcast) -> list[ahocorasick.Automaton]:
    """The automata of broadcast windows, built once in a Python worker and replaced when other windows come."""
    key = hash(frozenset((pattern, frozenset(ids)) for pattern, ids in shared.value.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build_automata(shared.value)
    return _BUILT[key]


def scan(text: str | None, automata: list[ahocorasick.Automaton]) -> tuple[int, np.ndarray, set[str]]:
    """(number of words, sorted indexes of the hit words, ids of the items found)."""
    words = words_of(text)
    if not words:
        return 0, np.zeros(0, np.int64), set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    ends, lengths, items = [], [], set()
    for automaton in automata:
        for end, (length, ids) in automaton.iter(line):
            ends.append(end)
            lengths.append(length)
            items.update(ids)
    if not ends:
        return len(words), np.zeros(0, np.int64), items
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 0x20)
    last = np.searchsorted(spaces, np.array(ends))  # the match ends at the space after word number `last` - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.array(lengths), 1)
    np.add.at(change, last, -1)
    return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the original text that hit words cover, adjoining words joined."""
    wanted, out = set(hit.tolist()), []
    before = -2
    for i, found in enumerate(_ORIGINAL_WORD.finditer(text)):
        if i in wanted:
            if before == i - 1:
                out[-1] = (out[-1][0], found.end())
            else:
                out.append(found.span())
            before = i
    return out


def _found(text: str | None, automata: list[ahocorasick.Automaton]) -> tuple[int, int, set[str], list[dict[str, int]]]:
    """(words, hit words, items, spans) of a text."""
    n, hit, items = scan(text, automata)
    return n, len(hit), items, [{"start": a, "end": b} for a, b in spans(text, hit)] if len(hit) else []


def given_windows(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> dict[bytes, set[str]]:
    """The windows of all items, for a broadcast; a test set beyond `ITEM_BYTES` of text is refused, as it should be scanned in
    parts."""
    size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    if size > ITEM_BYTES:
        raise ValueError(f"the items have {size} bytes of text; scan for at most {ITEM_BYTES} at a time")
    return windows_of((r[0], r[1]) for r in items.select(F.col(item_id), F.col(item_text)).toLocalIterator())


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted strings), spans (start, end in code points).

    A null or empty text has no words and no hits; an item with a null id or no words has no window.
    The items are a test set: they're gathered on the driver and sent to the tasks as patterns.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(given_windows(items, item_id, item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = automata_of(shared)
        for batch in batches:
            # One text at a time; of it only its hits and their offsets are kept.
            rows = [_found(t.as_py(), automata) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.concat_ws(",", "item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) without a hit word, decided row by row in one pass.  Null and empty
    texts stay, as do all of equal rows; without items every row stays."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(given_windows(items))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = automata_of(shared)
        for batch in batches:
            clean = [not any(True for a in automata for _ in a.iter(" " + b" ".join(words_of(t.as_py())).decode("latin-1") + " ")) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold any window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM wins),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin d JOIN wins x ON d.k = x.k AND d.n = x.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h, 0) AS BIGINT) AS n_hit, CAST(coalesce(c, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent letter n-grams (n = 1 to 3, words padded by one space) of a
language, in order.  A document's own list is compared with each profile by the out-of-place
distance: the differences of ranks, and the list's length for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, spare_name

#: n-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
_SPACE = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-case letter, anything else to a space."""
    if not _LETTERS:
        table = np.full(0x110000, _SPACE, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low[0]) if len(low) == 1 else cp
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the text's n-grams and their counts; none without letters."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.full(len(points) + 2, _SPACE, dtype=np.uint32)
    folded[1:-1] = _letters()[points]
    blank = folded == _SPACE
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    one = folded[keep].astype(np.uint64)
    if len(one) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (one[:-1] << np.uint64(21)) | one[1:]
    three = (two[:-1] << np.uint64(21)) | one[2:]
    grams = np.concatenate([one[one != _SPACE], two, three])
    grams.sort()
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]]))
    return grams[edge[:-1]], np.diff(edge)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, the smaller code first among equals."""
    top = int(counts.max(initial=0))
    order = np.argsort((top - counts).astype(np.uint16) if top < 1 << 16 else top - counts, kind="stable")
    return codes[order[:n]]


def held_out_is(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, code, rank from 0) from every row with a text and a lang.  Each task sums its n-grams per language first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def merge(name: str) -> None:
            codes, counts = (np.concatenate(x) for x in zip(*held[name], strict=True))
            unique, place = np.unique(codes, return_inverse=True)
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, place, counts)
            held[name], sizes[name] = [(unique, total)], 0

        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes, counts = gram_counts(value.as_py())
                held.setdefault(name, []).append((codes, counts))
                sizes[name] = sizes.get(name, 0) + len(codes)
                if sizes[name] > 1_000_000:
                    merge(name)
        for name in held:
            merge(name)
            codes, counts = held[name][0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "code", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """All profiles as one matrix: languages by the n-grams that any of them lists."""

    def __init__(self, rows: list[tuple[str, int, int]], profile: int = PROFILE):
        self.names = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64).astype(np.uint64))
        self.length = profile
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, dtype=np.int32)
        index = {name: i for i, name in enumerate(self.names)}
        for name, code, rank in rows:
            self.ranks[index[name], np.searchsorted(self.codes, np.uint64(code))] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest out-of-place distance (the first by name among equals) and its share of all
        similarities; `und` and 0 without letters or profiles."""
        codes, counts = gram_counts(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.length)
        at = np.searchsorted(self.codes, own)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own)
        theirs = self.ranks[:, np.where(known, at, len(self.codes))]
        apart = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))), self.length)
        alike = 1.0 - apart.sum(axis=1) / (self.length * len(own))
        best = int(np.argmax(alike))
        total = float(alike.sum())
        return self.names[best], float(alike[best] / total) if total > 0 else 0.0


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred and score for every row.  Profiles are gathered: `PROFILE` rows a language."""
    bounded_batches(docs.sparkSession)
    model = Profiles([(r[0], r[1], r[2]) for r in profiles.toLocalIterator()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).cast("string").alias(spare_name(docs, "whole_text"))).mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double"]))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the fourth by crc32 of its id is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out_is(F.col("doc_id"), 4, 2))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs, profiles, keep=("doc_id", "held_out"))

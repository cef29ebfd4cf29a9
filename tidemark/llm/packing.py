"""Best-fit packing of tokenised documents by minimum bin slack (Gupta and Ho, 1999).

Only lengths decide how pieces fit together, so the sequences are planned on the table of lengths
and their counts, which has at most `capacity` rows however large the corpus is.  For one sequence
after another, a subset-sum table over the lengths still available (one bitset for each length)
gives the fullest feasible combination; among equally full ones that with the longest pieces is
taken, as many times as the counts allow.  Every piece then finds its place by its rank among the
pieces of its length: ranks within input partitions are counted while tokenising, and a table of
counts by length and partition makes them global.  No task sees all pieces.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.periodic_runs import spaced_parts
from tidemark.llm.shared import bounded_batches, cut, small_or_shuffled
from tidemark.llm.text import LOWER, SPACE_WORDS, Words, as_bytes, chunks

CAPACITY, END = 4096, 1
#: Rows that a task gives at a time.
_ROWS = 2000
#: Distinct pieces of words whose ids a worker keeps, how many are joined to be tokenised at a time, and bytes of text a round.
_KEPT, _JOINED, _ROUND = 1_500_000, 1000, 4 << 20
#: Kinds of bytes: white space, letter, digit, other ASCII, beyond ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x80:] = 4


class Pieces(Words):
    """The pieces that the tokenizer splits words into: of ASCII words runs of letters, single digits, runs of other characters and
    the endings 's 't 're 've 'm 'll 'd; words beyond ASCII stay whole, as their normal forms are the tokenizer's own."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int):
        super().__init__(data, offsets, low, high, SPACE_WORDS)
        kind = _KIND[self._raw]
        beyond = np.unique(np.searchsorted(self.begin, np.flatnonzero(kind == 4), side="right") - 1)
        step = np.zeros(len(kind) + 1, np.int8)
        step[self.begin[beyond]] = 1
        # Words don't touch, so an end is never a beginning.
        step[self.end[beyond]] -= 1
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = 4
        starts = kind != 0
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts[self.begin] = True
        begin = np.flatnonzero(starts)
        end = np.minimum(np.append(begin[1:], len(kind)), self.end[np.searchsorted(self.begin, begin, side="right") - 1])[: len(begin)]
        # A lone apostrophe takes an ending from the letters behind it.
        quote = np.flatnonzero((self._raw[begin[:-1]] == 0x27) & (end[:-1] - begin[:-1] == 1) & (begin[1:] == end[:-1]) & (kind[begin[1:]] == 1))
        letter = LOWER[self._raw[begin[quote + 1]]]
        second = np.where(end[quote + 1] - begin[quote + 1] > 1, LOWER[self._raw[np.minimum(begin[quote + 1] + 1, len(kind) - 1)]], 0)
        two = (np.isin(letter, [ord("r"), ord("v")]) & (second == ord("e"))) | ((letter == ord("l")) & (second == ord("l")))
        taken = np.where(np.isin(letter, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
        end[quote] += taken
        begin[quote + 1] += taken
        left = begin < end
        self.begin, self.end = begin[left], end[left]

    def texts(self, places: np.ndarray) -> list[bytes]:
        raw = self._raw.tobytes()
        return [raw[b:e].lower() for b, e in zip(self.begin[places].tolist(), self.end[places].tolist(), strict=True)]


class WordIds:
    """Token ids of texts, each distinct piece of a word tokenised once.

    The tokenizer drops white space, never joins characters across it, and ends each piece that it splits off with an id of
    a token that ends a word.  So the ids of a text are those of its pieces one after another, and many pieces can be
    tokenised in one call.  Pieces are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        # The names of special tokens in a text are ordinary text.
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of known pieces, the place of each among the ids, and the ids.
        self._keys, self._code = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._first, self._ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their numbers of ids)."""
        ids, sizes, order = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64), []
        plain = [i for i, p in enumerate(pieces) if p.isascii()]
        for line in (plain[k : k + _JOINED] for k in range(0, len(plain), _JOINED)):
            found = np.array(self._tokenizer.encode_batch_fast([b" ".join(pieces[i] for i in line).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self._ends[found])
            if len(ends) != len(line):
                raise ValueError("the tokenizer doesn't end each piece of a word with a token of its own")
            sizes[line] = np.diff(ends, prepend=-1)
            ids.append(found)
            order += line
        for i in (i for i, p in enumerate(pieces) if not p.isascii()):
            found = self._tokenizer.encode_batch_fast([pieces[i].decode()], add_special_tokens=False)[0].ids
            sizes[i] = len(found)
            ids.append(np.array(found, np.uint32))
            order.append(i)
        begins = np.zeros(len(pieces), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gathered(np.concatenate(ids), begins, sizes), sizes

    def _codes(self, found: Pieces) -> np.ndarray:
        """The code of each piece; new ones are tokenised."""
        hashes, first, of = np.unique(found.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self._keys, hashes), len(self._keys) - 1)
        new = self._keys[at] != hashes if len(self._keys) else np.ones(len(hashes), bool)
        if new.any():
            ids, sizes = self._encode(found.texts(first[new]))
            codes = np.arange(len(self._keys), len(self._keys) + len(sizes), dtype=np.int32)
            self._first, self._ids = np.concatenate([self._first, np.cumsum(sizes) + self._first[-1]]), np.concatenate([self._ids, ids])
            places = np.searchsorted(self._keys, hashes[new])
            self._keys, self._code = np.insert(self._keys, places, hashes[new]), np.insert(self._code, places, codes)
            at = np.searchsorted(self._keys, hashes)
        return self._code[at][of]

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text; one after another, a round of texts at a time, a longer text in parts."""
        for low, high in chunks(offsets, _ROUND):
            if len(self._keys) > _KEPT:
                self._forget()
            if offsets[high] - offsets[low] > 2 * _ROUND:
                edges = np.cumsum([offsets[low], *map(len, spaced_parts(data[offsets[low] : offsets[high]].tobytes(), _ROUND))])
                yield np.concatenate([self._round(data, edges, k, k + 1)[0] for k in range(len(edges) - 1)])
            else:
                yield from self._round(data, offsets, low, high)

    def _round(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        found = Pieces(data, offsets, low, high)
        codes = self._codes(found)
        sizes = self._first[codes + 1] - self._first[codes]
        ids = _gathered(self._ids, self._first[codes], sizes)
        edge = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(found.begin, offsets[low : high + 1] - found.base)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[begins:begins + sizes], one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - ends + sizes, sizes) + np.arange(total)]


@functools.cache
def _words_of(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]) of every document: its ids and the id `end`, cut into pieces
    of `capacity` ids, the last one shorter.  `nth` numbers the pieces of one length within the input partition `part`.
    A null text counts as empty and gives the end id alone; equal rows give pieces of their own."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = tokenizer
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    columns = f"doc_id {named.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = _words_of(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            texts = enumerate(words.of_texts(data, offsets))
            while some := list(itertools.islice(texts, _ROWS)):
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, found in some:
                    own = np.append(found, np.uint32(end)).astype("<u4")
                    for at in range(0, len(own), capacity):
                        here = own[at : at + capacity]
                        row.append(i)
                        piece.append(at // capacity)
                        start.append(at)
                        length.append(len(here))
                        crc.append(zlib.crc32(here.tobytes()))
                        nth.append(seen[len(here)])
                        seen[len(here)] += 1
                        if with_ids:
                            ids.append(here.astype(np.int32))
                out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids])

    return named.mapInArrow(run, columns)


def fullest_combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over lengths and their counts: (sequences, [(length, pieces of it in each)]) until no piece is left.

    Each entry is the fullest combination of the pieces left, with the longest pieces among equally full ones, for
    as many sequences as the counts allow: while they do, the same combination stays the fullest.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("every length lies between 1 and the capacity")
    lengths, limit = sorted(left), (1 << capacity + 1) - 1
    # sums[k]: bit s is set if pieces of the k shortest lengths add up to s.
    sums, valid, out = [1], 0, []
    while lengths:
        for n in lengths[valid:]:
            now, room, times = sums[-1], min(left[n], capacity // n), 1
            while room:
                take = min(times, room)
                now |= now << take * n & limit
                room, times = room - take, times * 2
            sums.append(now)
        total = sums[-1].bit_length() - 1
        chosen = []
        for k in range(len(lengths), 0, -1):
            n = lengths[k - 1]
            if not total:
                break
            times = min(left[n], total // n)
            while not sums[k - 1] >> total - times * n & 1:
                times -= 1
            if times:
                chosen.append((n, times))
                total -= times * n
        again = min(left[n] // times for n, times in chosen)
        out.append((again, chosen))
        before, taken = lengths, {n for n, _ in chosen}
        for n, times in chosen:
            left[n] -= again * times
        # Sums stay right below the first length that now limits how often it can be taken.
        valid = next((k for k, n in enumerate(before) if n in taken and left[n] < capacity // n), len(before))
        lengths = [n for n in before if left[n]]
        del sums[valid + 1 :]
    return out


def _places(combinations: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length in a sequence, offset of the first), sorted."""
    rows, used, sequence = [], defaultdict(int), 0
    for again, chosen in combinations:
        offset = 0
        for n, times in chosen:
            rows.append((n, used[n], sequence, times, offset))
            used[n] += again * times
            offset += n * times
        sequence += again
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with length, part and nth as from `tokenized_pieces`, read from a written table) with sequence_id and offset in
    place of part and nth.  Offsets of a sequence's pieces are gapless from 0; sequence ids from 0 as well."""
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("pieces"))
    # At most `capacity` rows.
    counts = {r["length"]: r["pieces"] for r in sizes.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    places = _places(fullest_combinations(counts, capacity))
    # Ranks are below 2**50, lengths below 2**13.
    key = (places[:, 0] << 50) | places[:, 1]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, rank in batches:
            n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
            _, first, sequence, times, offset = places[np.searchsorted(key, (n << 50) | r, side="right") - 1].T
            ahead = r - first
            yield pa.StructArray.from_arrays([pa.array(sequence + ahead // times), pa.array(offset + ahead % times * n)], ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(small_or_shuffled(starts), ["length", "part"])
    placed = ranked.withColumn("place", place("length", F.col("ahead") + F.col("nth")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "nth")], "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence and offset (and with their ids, if wanted); an empty table gives none."""
    bounded_batches(docs.sparkSession)
    return place_pieces(cut(tokenized_pieces(docs, doc_id, text, tokenizer, capacity, end, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the ids of each sequence and the lengths of its pieces, from pieces with ids.
    A sequence holds at most its capacity of ids, so a group is small whatever the input."""
    kept = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("pieces"))
    return kept.select("sequence_id", F.flatten("pieces.ids").alias("ids"), F.col("pieces.length").alias("lengths"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4,096 ids.  A null text is empty and gives one piece of
    the end id; repeated rows are packed each; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

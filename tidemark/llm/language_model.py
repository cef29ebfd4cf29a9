"""Language-model scores by a weighted backoff automaton over words.

Words and one end per text are tokens; the end also stands before a text.  All word n-grams of the
training texts up to `ORDER` are counted exactly.  A state of the automaton is a history of up to
`ORDER - 1` tokens and an arc a counted n-gram, smoothed with a Dirichlet prior on the next shorter
history; a failure arc leads there with the state's backoff weight, at last to the word's exact
unigram.  The counts stay spread over the cluster: texts are dealt into buckets, each bucket asks for
the counts of its own distinct n-grams, and hash ranges of n-grams answer.  From the answers a bucket
builds the part of the automaton that its texts can reach, and traverses it once with each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import held_out_is
from tidemark.llm.shared import bounded_batches, partitions
from tidemark.llm.text import SPACE_WORDS, Words, as_bytes, chunks, sequence_hashes

#: The longest n-grams that are counted; the automaton's states are histories of up to two tokens.
ORDER = 3
#: The weight of the shorter history in tokens, and what the base model adds to each count.
PRIOR, ADDED = 8.0, 0.1
#: Bytes of text times orders in a bucket, at most about; a bucket is one group of a task, and so is a range of n-grams.
BUCKET_BYTES = 48 << 20
#: Tokens that one stretch of a text has in the traversal.
STRETCH = 256
#: Columns of packed rows beside the bucket.
PACKED = "ids array<{kind}>, held array<boolean>, sizes array<int>, raw binary"
_TEXT_CODEC = pa.Codec("zstd", compression_level=6)
#: Stands for the end of a text, and before its first word.
_END = np.uint64(0xA24BAED4963EE407)


def words_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a column in order, and the number of words of each row."""
    data, offsets = as_bytes(column)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in chunks(offsets):
        found = Words(data, offsets, low, high, SPACE_WORDS)
        hashes.append(found.hashes())
        counts.append(np.diff(found.first))
    return np.concatenate(hashes), np.concatenate(counts)


def _bounds(ranges: int) -> np.ndarray:
    """The smallest hash of each range but the first."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest, byte by byte of equal rank, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + pa.compress(np.ascontiguousarray(planes.T).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(pa.decompress(raw[1:], raw[0] * n, codec="zstd", asbytes=True), np.uint8).reshape(raw[0], n).T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which pack better than the values; a sum from the start undoes them."""
    return np.diff(ascending, prepend=np.uint64(0))


def _grams(words: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of texts with so many words each, and how many each text has.  Single words come without
    ends; longer n-grams begin at the end before the text at the earliest and stop with the end behind it."""
    if order == 1:
        return words, counts
    lengths = counts + 2
    padded = np.full(int(lengths.sum()), _END)
    padded[np.arange(len(words)) + 2 * np.repeat(np.arange(len(counts)), counts) + 1] = words
    many = np.maximum(lengths - order + 1, 0)
    # Runs across two texts are left out.
    at = np.arange(int(many.sum())) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(many) - many), many)
    return sequence_hashes(padded, order)[at], many


def _pack_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (bucket, doc_id, held_out, text) as one row a bucket, the texts compressed together."""
    place = np.argsort(batch.column(0).to_numpy(), kind="stable")
    bucket, ids, held, text = (c.take(pa.array(place)) for c in batch.columns)
    some, first = np.unique(bucket.to_numpy(), return_index=True)
    edges = np.append(first, len(place))
    data, offsets = as_bytes(text)
    raw = [_TEXT_CODEC.compress(data[offsets[a] : offsets[b]].tobytes(), asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), x)
    sizes = pa.array(np.diff(offsets).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(some), lists(ids), lists(held), lists(sizes), pa.array(raw, pa.binary())], ["bucket", "ids", "held", "sizes", "raw"])


def _unpack_rows(table: pa.Table) -> pa.Table:
    """What `_pack_rows` had of one bucket: (doc_id, held_out, text)."""
    flat = lambda name: table.column(name).combine_chunks().flatten()
    sizes = table.column("sizes")
    raw = b"".join(pa.decompress(r.as_py(), int(np.sum(n.values.to_numpy())), codec="zstd", asbytes=True) for r, n in zip(table.column("raw"), sizes, strict=True))
    offsets = np.concatenate([[0], np.cumsum(flat("sizes").to_numpy(), dtype=np.int64)])
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
    return pa.table([flat("ids"), flat("held"), text], ["doc_id", "held_out", "text"])


def _requests(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """For a bucket of packed rows: its distinct n-grams with their training counts, a row for each order and range that has
    any.  Rows are never more than n-grams."""
    docs = _unpack_rows(table)
    words, counts = words_of(docs.column("text"))
    train = ~np.asarray(docs.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
    del docs
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    rows = []
    for order in range(1, ORDER + 1):
        grams, many = _grams(words, counts, order)
        unique, place = np.unique(grams, return_inverse=True)
        times = np.bincount(place[np.repeat(train, many)], minlength=len(unique)).astype(np.uint64)
        edges = np.concatenate([[0], np.searchsorted(unique, bounds), [len(unique)]])
        for r in np.flatnonzero(np.diff(edges)):
            low, high = edges[r], edges[r + 1]
            rows.append(((order - 1) * (len(bounds) + 1) + int(r), bucket, int(high - low), pack(_steps(unique[low:high])), pack(times[low:high])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "bucket", "n", "grams", "times"])


def _answers(table: pa.Table) -> pa.Table:
    """For a range (range, bucket, n, grams, times): each bucket's n-grams' counts in all buckets, in the order of the n-grams."""
    sizes = table.column("n").to_numpy()
    if not len(sizes):
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())], ["range", "bucket", "n", "times"])
    flat = np.concatenate([np.cumsum(unpack(g.as_py(), n), dtype=np.uint64) for g, n in zip(table.column("grams"), sizes, strict=True)])
    times = np.concatenate([unpack(t.as_py(), n) for t, n in zip(table.column("times"), sizes, strict=True)])
    unique, place = np.unique(flat, return_inverse=True)
    # Sums of whole numbers below 2**53 are exact.
    total = np.bincount(place, times.astype(np.float64), minlength=len(unique)).astype(np.uint64)[place]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    packed = [pack(total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([table.column("range"), table.column("bucket"), table.column("n"), pa.array(packed, pa.binary())], ["range", "bucket", "n", "times"])


def smoothed(count: np.ndarray, total: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of tokens after a history seen `total` times and with the token `count` times, from those after the
    next shorter history.  Without a count it is the failure arc: the backoff weight times the shorter one's."""
    return (count + PRIOR * shorter) / (total + PRIOR)


class Backoff:
    """A weighted backoff automaton over tokens 0..T-1, of which the last is the end of a text.

    State 0 is the empty history, state 1 + t the history t (for the end: the start of a text), state 1 + T + k that of the k-th
    bigram.  A state's arcs are its counted continuations with smoothed log10 probabilities; they lead to the longest
    history of at most two tokens that was counted.  The failure arc leads to the history without its first token, with
    the log10 backoff weight; the empty history has an arc for every token.
    """

    def __init__(self, counts: np.ndarray, base: np.ndarray, first: np.ndarray, second: np.ndarray, bigrams: np.ndarray, before: np.ndarray, after: np.ndarray, trigrams: np.ndarray):
        """counts and base: training counts and probabilities of the tokens.  Tokens and counts of each bigram; of each trigram its
        first and its last bigram and its count."""
        size = self.tokens = len(counts)
        self.root, self.root_next = np.log10(base), np.where(counts > 0, 1 + np.arange(size), 0)
        self.fail = np.concatenate([np.zeros(1 + size, np.int32), 1 + second])
        chance = smoothed(bigrams, counts[first], base[second])
        # Arcs of single tokens and of bigrams, each in the order of (state, token).
        some = np.flatnonzero(trigrams)
        self.three = self._arcs((1 + size + before[some].astype(np.int64)) * size + second[after[some]], lambda k: smoothed(trigrams[some[k]], bigrams[before[some[k]]], chance[after[some[k]]]), lambda k: 1 + size + after[some[k]])
        some = np.flatnonzero(bigrams)
        self.two = self._arcs((1 + first[some].astype(np.int64)) * size + second[some], lambda k: chance[some[k]], lambda k: 1 + size + some[k])
        self.fail_weight = np.log10(PRIOR / (np.concatenate([[0], counts, bigrams]) + PRIOR))

    @staticmethod
    def _arcs(keys: np.ndarray, chance: Callable[[np.ndarray], np.ndarray], state: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        weights = chance(order)
        return keys, np.log10(weights, out=weights), state(order).astype(np.int32)

    @property
    def start(self) -> int:
        return int(self.root_next[-1])

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of each token in its state: along failure arcs until a state has the token's arc."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            at_root = state == 0
            done, now = open_[at_root], token[at_root]
            weight[done] += self.root[now]
            after[done] = self.root_next[now]
            open_, state, token = open_[~at_root], state[~at_root], token[~at_root]
            found = np.zeros(len(open_), bool)
            for own, (keys, weights, following) in ((state <= self.tokens, self.two), (state > self.tokens, self.three)):
                at = np.flatnonzero(own)
                if len(at) and len(keys):
                    key = state[at] * self.tokens + token[at]
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[place] == key
                    found[at[hit]] = True
                    weight[open_[at[hit]]] += weights[place[hit]]
                    after[open_[at[hit]]] = following[place[hit]]
            open_, state, token = open_[~found], state[~found], token[~found]
            weight[open_] += self.fail_weight[state]
            state = self.fail[state].astype(np.int64)
        return weight, after

    def traverse(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probabilities of token sequences (each ends with the end), `sizes` tokens each, from left to right.

        Sequences advance side by side.  A long one is cut into stretches of `STRETCH` tokens; as a state is known from the two
        tokens before it, each stretch finds the state that the one before it ends in by walking those two.
        """
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[of] + nth * STRETCH
        length = np.minimum(sizes[of] - nth * STRETCH, STRETCH)
        state = np.full(len(of), self.start, np.int64)
        inner = np.flatnonzero(nth > 0)
        state[inner] = 0
        for back in (2, 1):
            state[inner] = self.step(state[inner], tokens[at[inner] - back])[1]
        # The longest first, so that those still under way are a prefix.
        order = np.argsort(-length, kind="stable")
        at, length, state = at[order], length[order], state[order]
        total = np.zeros(len(of))
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, side="left"))
            weight, state[:n] = self.step(state[:n], tokens[at[:n] + k])
            total[:n] += weight
        return np.bincount(of[order], total, minlength=len(sizes))


def _scores(table: pa.Table, answers: pa.Table, known: int, tokens: int, ends: int) -> pa.Table:
    """Scores of a bucket of packed rows whose n-grams' counts are in `answers` (range, n, times): the automaton of the bucket's
    n-grams is built and its texts are traversed."""
    table = _unpack_rows(table)
    words, counts = words_of(table.column("text"))
    place_of = np.argsort(answers.column("range").to_numpy())
    sizes, packed = answers.column("n").to_numpy()[place_of], answers.column("times")
    lists = [unpack(packed[int(i)].as_py(), n) for i, n in zip(place_of, sizes, strict=True)]
    # Orders follow each other, and ranges within them, as in the sorted n-grams.
    told, used = np.concatenate([np.zeros(0, np.uint64), *lists]), 0
    del lists
    told = told.astype(np.int32 if told.max(initial=0) < 1 << 31 else np.int64)

    def counted(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of the distinct n-grams, the number of each n-gram of the texts in order, and the first place of each."""
        nonlocal used
        unique, place = np.unique(_grams(words, counts, order)[0], return_inverse=True)
        used += len(unique)
        if used > len(told):
            raise ValueError("the counts don't fit the n-grams of the bucket")
        place = place.astype(np.int32)
        first = np.empty(len(unique), np.int32)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1, dtype=np.int32)
        return told[used - len(unique) : used], place, first

    n, v = tokens + ends, known + (1 if ends else 0)
    times, token, _ = counted(1)
    times = np.append(times, ends)
    base = (times + ADDED) / (n + ADDED * (v + 1))
    # Texts with the end behind them, and with one before them too.
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
    stream = np.full(len(row), len(times) - 1, np.int32)
    inner = np.ones(len(row), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    stream[inner] = token
    # A bigram stops at each token of the stream; a trigram at each but the first of a text.
    last = np.ones(len(row), bool)
    last[np.cumsum(counts + 1) - (counts + 1)] = False
    previous = np.where(last, np.roll(stream, 1), stream.dtype.type(len(times) - 1))
    pairs, pair, place = counted(2)
    first, second = previous[place].astype(np.int32), stream[place]
    del previous, token, inner
    triples, place = counted(3)[::2]
    stops = np.flatnonzero(last)[place]
    before, after = pair[stops - 1], pair[stops]
    del words, last, pair, stops, place
    automaton = Backoff(times, base, first, second, pairs, before, after, triples)
    del first, second, before, after
    score = automaton.traverse(stream, counts + 1)
    return pa.table({
        "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array((counts + 1).astype(np.int64)), "n_known": pa.array(np.bincount(row, times[stream] > 0, minlength=len(counts)).astype(np.int64)),
        "train_tokens": pa.array(np.full(len(counts), n, np.int64)), "base_score": pa.array(np.bincount(row, np.log10(base)[stream], minlength=len(counts))), "score": pa.array(score),
    })


def _totals(docs: DataFrame) -> tuple[int, int]:
    """(distinct words, words) of all texts: each batch sends its distinct word hashes, so the shuffle has a row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = words_of(batch.column(0))
            unique, times = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(times)], ["word", "times"])

    found = docs.select("text").mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    known, tokens = found.agg(F.count("*"), F.sum("times")).first()
    return int(known), int(tokens or 0)


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of all rows of (doc_id, held_out, text), learnt from those that aren't held out; other columns are ignored.

    A null text is empty: one end.  Null ids are ids like any other.  Without training rows every word is unknown.  Rows may
    repeat, and each repeat counts in training.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums = docs.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), 1).otherwise(0))).first()
    ends = int(sums[1] or 0)
    known, tokens = _totals(docs.where(~F.col("held_out")))
    # Ranges grow with the texts too, so that what a task holds doesn't.
    buckets = max(partitions(spark), -(-ORDER * int(sums[0] or 0) // BUCKET_BYTES))
    bounds = _bounds(buckets)
    # The text is part of the key so that rows of one id don't have to share a bucket.
    bucket = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(buckets)).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select(bucket.alias("bucket"), "doc_id", "held_out", "text").mapInArrow(lambda batches: map(_pack_rows, batches), f"bucket int, {PACKED.format(kind=kind)}")
    # Both uses of the packed texts are in one plan, so that Spark shuffles them once.
    asked = packed.groupBy("bucket").applyInArrow(lambda t: _requests(t, bounds), "range int, bucket int, n int, grams binary, times binary")
    told = asked.groupBy("range").applyInArrow(_answers, "range int, bucket int, n int, times binary")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(left, right, known, tokens, ends)

    return packed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; the tenth by crc32 of its id is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.withColumn("held_out", held_out_is(F.col("doc_id"), 10, 0)))

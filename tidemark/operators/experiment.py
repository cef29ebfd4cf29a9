"""The matched experiment: readouts of graph states against rewired and reweighted graphs and against the inputs alone.

States advance in blocks of whole episodes where the edges that carry anything are few, else by joins.  Features are one row
a sample.  Ridge regression with few features is solved from their sums of products, which tasks add up in one pass; with
many features but at most `MOST_SAMPLES` samples from the inner products of the samples (its dual form), added up from blocks
of nodes; beyond, by conjugate gradients that pass over the samples once a step, while the driver holds a few numbers a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources.shared import cut, small_or_shuffled

#: Samples whose matrix of inner products the driver may hold, side of the tiles in which it is added up, rows of a block.
MOST_SAMPLES, TILE, BLOCK_ROWS = 6000, 1024, 2_000_000
#: Features whose matrix of products a task may hold, edges and nodes that each task may hold, numbers of a block of states.
MOST_NODES, MOST_EDGES, BLOCK_VALUES = 2048, 200_000, 1 << 18


def encode(edges: DataFrame, samples: DataFrame, inputs: DataFrame, decay: float, input_scale: float) -> DataFrame:
    """(sample_id, node, value): the state of every node that anything has reached when each sample is read.

    samples(sample_id, episode_id, place), places from 0 in each episode; inputs(sample_id, node, input).  A state goes on
    from the sample before in its episode: decay * old + (1 - decay) * tanh(incoming + input_scale * input); each episode
    starts at 0.  Inputs of nodes outside of the graph are ignored.
    """
    drive = driven(cut(gathered(edges, samples, inputs), "samples"))
    reach = reached(edges, drive)
    return _long(states(cut(carrying(edges, reach), "edges"), reach, drive, decay, input_scale))


def gathered(edges: DataFrame, samples: DataFrame, inputs: DataFrame) -> DataFrame:
    """`samples` with `entries`, an array of (node, input, known): known where the node is in the graph.  A null input is none."""
    given = inputs.where("input is not null")
    asked = small_or_shuffled(cut(given.select("node").distinct(), "asked"))
    known = small_or_shuffled(cut(graph.nodes(edges).join(asked, "node", "left_semi").withColumn("known", F.lit(True)), "known"))
    entry = F.struct("node", F.col("input").cast("double").alias("input"), F.col("known").isNotNull().alias("known"))
    entries = given.join(known, "node", "left").groupBy("sample_id").agg(F.collect_list(entry).alias("entries"))
    none = F.array().cast(entries.schema["entries"].dataType)
    return samples.join(entries, "sample_id", "left").withColumn("entries", F.coalesce("entries", none))


def driven(samples: DataFrame) -> DataFrame:
    """Gathered samples with `nodes` and `values` of the inputs inside of the graph."""
    known = samples.withColumn("entries", F.filter("entries", lambda e: e["known"]))
    return known.withColumn("nodes", F.col("entries.node")).withColumn("values", F.col("entries.input")).drop("entries")


def reached(edges: DataFrame, drive: DataFrame) -> DataFrame:
    """(node): only nodes that inputs drive or edges reach ever have a state."""
    return cut(drive.select(F.explode("nodes").alias("node")).union(edges.select("dst")).where("node is not null").distinct(), "reached")


def carrying(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Edges between nodes that can have a state; those of other sources carry nothing."""
    return edges.where("dst is not null").join(small_or_shuffled(reach), F.col("src") == F.col("node"), "left_semi").select("src", "dst", "weight", "sign")


def states(edges: DataFrame, reach: DataFrame, drive: DataFrame, decay: float, input_scale: float) -> DataFrame:
    """`drive` without episode_id and place, its inputs replaced by the states: `nodes` and `values` of each sample."""
    few = all(df.limit(MOST_EDGES + 1).count() <= MOST_EDGES for df in (edges, reach))
    return (_states_in_blocks if few else _states_by_joins)(edges, reach, drive, decay, input_scale)


def _states_in_blocks(edges: DataFrame, reach: DataFrame, drive: DataFrame, decay: float, input_scale: float) -> DataFrame:
    """Blocks of whole episodes pass through tasks as streams sorted by place; a task holds the edges and one block's last states."""
    ids = np.sort(reach.toPandas()["node"].to_numpy())
    known = edges.select("src", "dst", (F.col("weight") * F.col("sign")).cast("double").alias("w")).where("w is not null").orderBy("dst", "src").toPandas()
    src, dst, weight = np.searchsorted(ids, known["src"].to_numpy()), np.searchsorted(ids, known["dst"].to_numpy()), known["w"].to_numpy()[:, None]
    width, kept = len(ids), [c for c in drive.columns if c not in ("episode_id", "place", "nodes", "values")]
    size = drive.agg(F.count("*").alias("samples"), F.count_if(F.col("place") == 0).alias("episodes")).first()
    least, entries = drive.sparkSession.sparkContext.defaultParallelism, _entries(ids)
    blocks = max(least, -(-size.episodes // min(512, max(1, BLOCK_VALUES // max(1, width)))))
    tasks = max(least, -(-size.samples // 20_000))

    def advance(old: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        n = len(old)
        row, node, given = entries(batch)
        incoming = np.ascontiguousarray(np.bincount(row * width + node, input_scale * given, minlength=n * width).reshape(n, width).T)
        values, step = np.ascontiguousarray(old.T), max(1, (1 << 20) // n)
        for low in range(0, len(src), step):
            some = slice(low, low + step)
            ends, first = np.unique(dst[some], return_index=True)
            incoming[ends] += np.add.reduceat(values[src[some]] * weight[some], first)
        return decay * old + (1 - decay) * np.tanh(incoming.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, now = None, {}, np.zeros((0, width))
        for batch in batches:
            at = np.column_stack([batch.column("block").to_numpy(), batch.column("place").to_numpy()])
            turns = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for low, high in pairwise([0, *turns.tolist(), len(at)] if len(at) else []):
                part = batch.slice(low, high - low)
                if at[low, 0] != block:
                    block, rows, now = at[low, 0], {}, np.zeros((0, width))
                here = np.array([rows.setdefault(e, len(rows)) for e in part.column("episode_id").to_pylist()])
                now = np.concatenate([now, np.zeros((len(rows) - len(now), width))])
                now[here] = new = advance(now[here], part)
                filled = new != 0
                ends = np.concatenate([[0], filled.sum(1).cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, ids[np.nonzero(filled)[1]]), pa.ListArray.from_arrays(ends, new[filled])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *lists], [*kept, "nodes", "values"])

    placed = drive.withColumn("block", F.pmod(F.xxhash64("episode_id"), F.lit(blocks))).repartition(tasks, "block").sortWithinPartitions("block", "place")
    return placed.mapInArrow(run, _kinds(drive, [*kept, "nodes", "values"]))


def _states_by_joins(edges: DataFrame, reach: DataFrame, drive: DataFrame, decay: float, input_scale: float) -> DataFrame:
    """All episodes advance together, one join and one aggregation a place, so rounds are as many as the longest episode has samples."""
    samples, given = drive.select("sample_id", "episode_id", "place"), _long(drive, "sample_id", "episode_id", "place")
    rounds = int(samples.agg(F.max("place")).first()[0] or 0) + 1
    zero, state, out = F.lit(0.0), None, None
    for place in range(rounds):
        here = samples.where(F.col("place") == place).select("sample_id", "episode_id")
        parts = given.where(F.col("place") == place).select("episode_id", "node", zero.alias("value"), (F.col("value") * input_scale).alias("incoming"))
        if state is not None:
            old = state.join(here.select("episode_id"), "episode_id", "left_semi")
            incoming = edges.join(old, F.col("src") == F.col("node")).select("episode_id", F.col("dst").alias("node"), zero.alias("value"), (F.col("value") * F.col("weight") * F.col("sign")).alias("incoming"))
            parts = parts.unionByName(old.withColumn("incoming", zero)).unionByName(incoming)
        summed = parts.groupBy("episode_id", "node").agg(F.sum("value").alias("value"), F.sum("incoming").alias("incoming"))
        state = cut(summed.select("episode_id", "node", (decay * F.col("value") + (1 - decay) * F.tanh("incoming")).alias("value")), "states")
        read = state.join(here, "episode_id").select("sample_id", "node", "value")
        out = read if out is None else out.unionByName(read)
    return _wide(drive.drop("episode_id", "place", "nodes", "values"), out)


def _long(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, node, value) of rows with `nodes` and `values`."""
    columns = columns or ("sample_id",)
    return rows.select(*columns, F.explode(F.arrays_zip("nodes", "values")).alias("z")).select(*columns, F.col("z.nodes").alias("node"), F.col("z.values").alias("value"))


def _wide(rows: DataFrame, features: DataFrame) -> DataFrame:
    """`rows` with their features (sample_id, node, value) as `nodes` and `values`."""
    lists = features.groupBy("sample_id").agg(F.collect_list(F.struct("node", "value")).alias("z"))
    joined = rows.join(lists, "sample_id", "left").withColumn("z", F.coalesce("z", F.array().cast(lists.schema["z"].dataType)))
    return joined.withColumn("nodes", F.col("z.node")).withColumn("values", F.col("z.value")).drop("z")


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _entries(ids: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gives row, place in `ids` and value of each entry of a batch with `nodes` and `values`."""

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("nodes")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        return row, np.searchsorted(ids, lists.flatten().to_numpy()), batch.column("values").flatten().to_numpy()

    return entries


def inner_products(features: DataFrame, n: int) -> np.ndarray:
    """The n x n matrix of inner products of the samples' features (i, node, value), i from 0.  Blocks of nodes become dense
    matrices; their products are added up tile by tile, the upper triangle only."""
    rows = features.count()
    blocks = max(features.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS))
    edges = np.arange(0, n + TILE, TILE)

    def multiply(table: pa.Table) -> pa.Table:
        i = table.column("i").to_numpy()
        _, node = np.unique(table.column("node").to_numpy(), return_inverse=True)
        width = int(node.max(initial=-1)) + 1
        total = {}
        for low in range(0, width, 512):
            some = (node >= low) & (node < low + 512)
            dense = np.zeros((n, min(512, width - low)))
            np.add.at(dense, (i[some], node[some] - low), table.column("value").to_numpy()[some])
            for a in range(len(edges) - 1):
                for b in range(a, len(edges) - 1):
                    product = dense[edges[a] : edges[a + 1]] @ dense[edges[b] : edges[b + 1]].T
                    total[a, b] = total[a, b] + product if (a, b) in total else product
        return pa.table({"a": pa.array([k[0] for k in total], pa.int32()), "b": pa.array([k[1] for k in total], pa.int32()), "raw": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    tiles = features.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).groupBy("block").applyInArrow(multiply, _TILES)
    out = np.zeros((n, n))
    for t in _added(tiles).toLocalIterator():
        a, b = slice(edges[t.a], min(edges[t.a + 1], n)), slice(edges[t.b], min(edges[t.b + 1], n))
        tile = np.frombuffer(t.raw).reshape(a.stop - a.start, b.stop - b.start)
        out[a, b], out[b, a] = tile, tile.T
    return out


_TILES = "a int, b int, raw binary"


def _added(tiles: DataFrame) -> DataFrame:
    """Tiles of the same place as one, their sum."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r.as_py()) for r in table.column("raw"))
        return pa.table({"a": table.column("a").slice(0, 1), "b": table.column("b").slice(0, 1), "raw": pa.array([total.tobytes()], pa.binary())})

    return tiles.groupBy("a", "b").applyInArrow(add, _TILES)


def ridge_predictions(features: DataFrame, target: np.ndarray, train: np.ndarray, l2: float, dense: bool | None = None) -> np.ndarray:
    """Predictions for all samples of ridge regression with a free intercept, fitted on those in `train` (booleans).

    features(i, node, value), i from 0; absent ones are 0.  With centred targets y and a = (K + l2)^-1 y over the centred
    inner products K of the training samples, a prediction is the mean target plus its centred products with a.
    """
    n, mean = len(target), target[train].mean()
    if dense is None:
        dense = n <= MOST_SAMPLES
    if not dense:
        known = features.sparkSession.createDataFrame(pd.DataFrame({"sample_id": np.arange(n), "target": target, "partition": np.where(train, "train", "test")}))
        rows = cut(_wide(known, features.withColumnRenamed("i", "sample_id")), "features")
        got, out = _scored(rows, *_by_scans(rows.where("partition = 'train'"), _all_nodes(rows), l2)).toPandas(), np.zeros(n)
        out[got["sample_id"].to_numpy(np.int64)] = got["predicted"]
        return out
    y = target[train] - mean
    products = inner_products(features, n)
    own = products[np.ix_(train, train)]
    own = own - own.mean(0) - own.mean(1)[:, None] + own.mean()
    # Without regularisation the smallest solution is taken.
    a = np.linalg.solve(own + l2 * np.eye(len(y)), y) if l2 else np.linalg.pinv(own) @ y
    spread = np.zeros(n)
    spread[train] = a - a.mean()
    scores = products @ spread
    return mean + scores - scores[train].mean()


def ridge_heldout(rows: DataFrame, l2: float) -> DataFrame:
    """(sample_id, predicted, target, partition) of the rows that aren't in `train`: ridge regression with a free intercept,
    fitted on those that are.  rows(sample_id, target, partition, nodes, values); absent nodes are 0."""
    train, held = rows.where("partition = 'train'"), rows.where("partition <> 'train'")
    ids = _all_nodes(rows, MOST_NODES + 1)
    if len(ids) <= MOST_NODES:
        return _scored(held, *_by_sums(train, ids, l2))
    if rows.count() > MOST_SAMPLES:
        return _scored(held, *_by_scans(train, _all_nodes(rows), l2))
    known = rows.select("sample_id", "target", "partition").toPandas()
    number = rows.sparkSession.createDataFrame(pd.DataFrame({"sample_id": known["sample_id"], "i": np.arange(len(known))}))
    features = cut(_long(rows).join(F.broadcast(number), "sample_id").select("i", "node", "value"), "numbered")
    fitted = (known["partition"] == "train").to_numpy()
    out = known.assign(predicted=ridge_predictions(features, known["target"].to_numpy(), fitted, l2, True))[~fitted]
    columns = ["sample_id", "predicted", "target", "partition"]
    return rows.sparkSession.createDataFrame(out[columns], _kinds(rows.withColumn("predicted", F.lit(0.0)), columns))


def _all_nodes(rows: DataFrame, most: int | None = None) -> np.ndarray:
    found = rows.select(F.explode("nodes").alias("node")).distinct()
    return np.sort((found if most is None else found.limit(most)).toPandas()["node"].to_numpy())


def _by_sums(train: DataFrame, ids: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, weights, intercept) from the sums of products of (1, features, target): one pass, one small matrix a task."""
    n, entries = len(ids) + 2, _entries(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for low in range(0, batch.num_rows, step := max(1, (1 << 20) // n)):
                part = batch.slice(low, step)
                row, node, value = entries(part)
                z = np.bincount(row * n + node + 1, value, minlength=part.num_rows * n).reshape(-1, n)
                z[:, 0], z[:, -1] = 1, part.column("target").to_numpy(zero_copy_only=False)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([0] * n, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["a", "b", "raw"])

    sums = np.zeros((n, n))
    for r in _added(train.select("target", "nodes", "values").mapInArrow(run, _TILES)).collect():
        sums[r.a] = np.frombuffer(r.raw)
    means = sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - sums[0, 0] * np.outer(means, means)
    own, y = centred[:-1, :-1], centred[:-1, -1]
    weights = np.linalg.solve(own + l2 * np.eye(n - 2), y) if l2 else np.linalg.pinv(own, hermitian=True) @ y
    return ids, weights, float(means[-1] - means[:-1] @ weights)


def _by_scans(train: DataFrame, ids: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, weights, intercept) by conjugate gradients: each step is one pass over the rows and a sum for each node."""
    n, entries, given = len(ids), _entries(ids), train.select("target", "nodes", "values")
    count, target = given.agg(F.count("*"), F.avg("target")).first()

    def scan(weigh: Callable[..., np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                row, node, value = entries(batch)
                total += np.bincount(node, value * weigh(batch, row, node, value)[row], minlength=n)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "x"])

        got, out = given.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas(), np.zeros(n)
        out[got["i"].to_numpy(np.int64)] = got["x"]
        return out

    def apply(w: np.ndarray) -> np.ndarray:
        middle = means @ w
        return scan(lambda batch, row, node, value: np.bincount(row, value * w[node], minlength=batch.num_rows) - middle) + l2 * w

    means = scan(lambda batch, *_: np.ones(batch.num_rows)) / count
    weights = _conjugate_gradients(apply, scan(lambda batch, *_: batch.column("target").to_numpy(zero_copy_only=False) - target))
    return ids, weights, float(target - means @ weights)


def _scored(rows: DataFrame, ids: np.ndarray, weights: np.ndarray, intercept: float) -> DataFrame:
    """(sample_id, predicted, target, partition) of rows with `nodes` and `values`."""
    entries = _entries(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, node, value = entries(batch)
            predicted = intercept + np.bincount(row, value * weights[node], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(predicted), batch.column("target"), batch.column("partition")], ["sample_id", "predicted", "target", "partition"])

    given = rows.select("sample_id", "target", "partition", "nodes", "values")
    return given.mapInArrow(run, f"{_kinds(rows, ['sample_id'])}, predicted double, {_kinds(rows, ['target', 'partition'])}")


def _conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], y: np.ndarray, tolerance: float = 1e-9, most: int = 500) -> np.ndarray:
    x, r = np.zeros(len(y)), y.copy()
    p, rr = r.copy(), float(r @ r)
    goal = tolerance**2 * rr
    for _ in range(most):
        if rr <= goal:
            return x
        q = apply(p)
        step = rr / float(p @ q)
        x, r = x + step * p, r - step * q
        p, rr = r + float(r @ r) / rr * p, float(r @ r)
    raise ArithmeticError("conjugate gradients didn't converge")


def run_experiment(edges: DataFrame, samples: DataFrame, inputs: DataFrame, decay: float = 0.9, input_scale: float = 1.0, l2: float = 1.0, seed: int = 7, least_train: int = 4) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions) of five models on the same samples.

    edges(ordinal, src, dst, weight, sign); samples(sample_id, episode_id, observed_us, target, partition), where partition is
    train, validation or test; inputs(sample_id, node, input).  The models are the graph, its targets shuffled, its weights
    drawn anew, `no_state` (all inputs) and `ordinary` (the mean of a sample's inputs).  metrics(model, status, reasons,
    train_count, heldout_count, mae); predictions(model, sample_id, predicted, target, partition) of the held-out samples.
    With fewer than `least_train` training samples or none held out the status is waiting and nothing is fitted.
    """
    spark = edges.sparkSession
    order = Window.partitionBy("episode_id").orderBy("observed_us", "sample_id")
    placed = cut(samples.where(F.col("partition").isin("train", "validation", "test")).select("sample_id", "episode_id", F.col("target").cast("double").alias("target"), "partition", (F.row_number().over(order) - 1).alias("place")), "placed")
    train, held = placed.agg(F.count_if(F.col("partition") == "train"), F.count_if(F.col("partition") != "train")).first()
    metric_kinds = "model string, status string, reasons array<string>, train_count long, heldout_count long, mae double"
    prediction_kinds = f"model string, {_kinds(placed, ['sample_id'])}, predicted double, target double, partition string"
    missing = [r for r, lacks in (("insufficient_qualified_train_examples", train < least_train), ("no_heldout_examples", not held)) if lacks]
    if missing:
        return spark.createDataFrame([(None, "waiting", missing, train, held, None)], metric_kinds), spark.createDataFrame([], prediction_kinds)

    whole = cut(gathered(edges, placed, inputs), "samples")
    drive, known = driven(whole), whole.select("sample_id", "target", "partition", F.col("entries.node").alias("nodes"), F.col("entries.input").alias("values"))
    # Both controls keep the nodes of either end, so the same nodes are driven and reached in all three graphs.
    reach = reached(edges, drive)
    encoded = lambda e: cut(states(cut(e, "edges"), reach, drive, decay, input_scale), "features")
    mean = F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.size("values")
    models = {
        "graph": lambda: encoded(carrying(edges, reach)),
        "shuffled_wiring": lambda: encoded(carrying(graph.shuffled_targets(edges, seed, reach), reach)),
        "random_weights": lambda: encoded(carrying(graph.random_weights(edges, seed), reach)),
        "no_state": lambda: known,
        "ordinary": lambda: known.withColumn("nodes", F.when(F.size("nodes") > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))).withColumn("values", F.when(F.size("values") > 0, F.array(mean)).otherwise(F.array().cast("array<double>"))),
    }
    metrics, predictions = [], spark.createDataFrame([], prediction_kinds)
    for name, features in models.items():
        out = cut(ridge_heldout(features(), l2).select(F.lit(name).alias("model"), "sample_id", "predicted", "target", "partition"), "predictions")
        predictions = predictions.unionByName(out)
        metrics.append((name, "completed", [], train, held, out.agg(F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0]))
    return spark.createDataFrame(metrics, metric_kinds), predictions

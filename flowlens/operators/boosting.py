"""Gradient-boosted trees grown over blocks of binned rows (M7).

The trees are those of Spark ML's `GBTClassifier` (regression trees on the
gradients of the logistic loss, variance gain, its split candidates), and the
result is a Spark ML model. Rows are kept as arrays of bin numbers with the
label and the margin, 10 bytes a row and one a feature, in a persisted RDD;
a level of a tree is one job (few rows are trained in one task): every task sums the gradients of its rows by
(node, feature, bin), the driver picks the splits. Margins of a tree are added
in the job of the next tree's first level. A lost block is computed again
from the stored rows, or from the last checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BINS = 32  # of Spark ML by default; a sample larger than expected gives one or two more
MAX_DEPTH = 8  # a node's place in its level is kept in a byte
BLOCK_ROWS = 1 << 16
PARTITION_ROWS = 1 << 22
ONE_TASK_ROWS = 1 << 19  # a pass over so few takes less time than a job
CHECKPOINT_EVERY = 20  # trees; cuts the lineage of the margins
TREE_REDUCE_FROM = 64  # tasks; from there on their sums are merged before they reach the driver
SAMPLE_ROWS = 10_000  # Spark ML's number of rows for split candidates
EPSILON = 2.0 ** -52
# as they are: the other level would compress the blocks, and every pass expand them
KEPT = StorageLevel.MEMORY_AND_DISK_DESER

# a level of a tree: (node's place in the level, feature, last bin of the left side)
Level = list[tuple[int, int, int]]


# ---------------------------------------------------------------- split candidates
def thresholds(weights: dict[float, float], expected: float, n_rows: int, most: int) -> np.ndarray:
    """Spark ML's candidates of one feature: midpoints of neighbouring values,
    all of them if at most `most`, else those closest to equal shares of the
    weight. `weights` has the weight of each value but 0, whose weight is what
    is missing to `expected`."""
    found = sum(weights.values())
    if expected - found > EPSILON * n_rows * 100:
        weights = weights | {0.0: expected - found}
    values = np.array(sorted(weights))
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2.0
    out, stride = [], expected / (most + 1)
    target, so_far = stride, weights[values[0]]
    for a, b in zip(values[:-1], values[1:]):
        before, so_far = so_far, so_far + weights[b]
        if abs(before - target) < abs(so_far - target):
            out.append((a + b) / 2.0)
            target += stride
    return np.array(out)


def split_candidates(df: DataFrame, features: list[str], weight_col: str | None, seed: int,
                     n_rows: int, weight: float) -> list[np.ndarray]:
    """Candidates per feature from the rows that Spark ML takes for it: all, or
    its seeded sample of about SAMPLE_ROWS. Training itself reads all rows."""
    spark = df.sparkSession
    cols = df.select(*features, F.col(weight_col).cast("double").alias("_w") if weight_col else F.lit(1.0).alias("_w"))
    share = min(1.0, max(MAX_BINS * MAX_BINS, SAMPLE_ROWS) / n_rows)
    if share < 1.0:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = cols._jdf.toJavaRDD().sample(False, share, draw)
        cols = DataFrame(spark._jsparkSession.createDataFrame(rows, cols._jdf.schema()), spark)
    rows = cols.collect()
    most = min(MAX_BINS, n_rows) - 1
    out = []
    for i in range(len(features)):
        weights: dict[float, float] = {}
        for r in rows:
            if r[i] != 0.0:
                weights[r[i]] = weights.get(r[i], 0.0) + r["_w"]
        out.append(thresholds(weights, share * weight, n_rows, most))
    return out


# ---------------------------------------------------------------- blocks of rows
def _blocks(cuts: list[np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (features, label, weight) as blocks of BLOCK_ROWS: bins by feature,
    labels, weights."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def block() -> pa.RecordBatch:
        bins, y, w = (np.concatenate(x, axis=-1) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y, w)],
                                          ["bins", "y", "w"])
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            if n + part.num_rows > BLOCK_ROWS:
                yield block()
                held, n = [], 0
            columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            held.append((np.stack([np.searchsorted(t, c).astype(np.uint8) for t, c in zip(cuts, columns)]),
                         np.where(columns[len(cuts)] > 0, 1, -1).astype(np.int8),
                         columns[len(cuts) + 1] if len(columns) > len(cuts) + 1 else np.empty(0)))
            n += part.num_rows
    if n:
        yield block()


def _arrays(row) -> tuple:
    """A block as (bins, labels of -1 and 1, weights or None, margins)."""
    y = np.frombuffer(row["y"], np.int8)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, len(y))
    return bins, y, np.frombuffer(row["w"]) if len(row["w"]) else None, np.zeros(len(y))


# ---------------------------------------------------------------- work on a block
def _places(bins: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Place of every row in the level below `levels`. A leaf's rows go left."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level in levels:
        down = at + at
        for node, feature, last in level:
            right = bins[feature] > last
            right &= at == node
            down |= right.view(np.uint8)
        at = down
    return at


def _gradients(y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to: the labels, then minus the gradient of the loss."""
    if first:
        return y.astype(np.float64)
    s = y.astype(np.float64)
    return 4.0 * s / (1.0 + np.exp(np.minimum(2.0 * s * margin, 700.0)))


def _sums(n_bins: int, levels: list[Level], first: bool, squares: bool, blocks: Iterable[tuple]) -> Iterator[list[np.ndarray]]:
    """Per (node, feature, bin) of the level below `levels`: rows, weight,
    gradient, squared gradient (by node alone unless `squares`). Two features
    share a pass over the rows, as cells of both bin numbers."""
    nodes, pair = 1 << len(levels), n_bins * n_bins
    total: list | None = None
    n_features = 0
    for bins, y, w, margin in blocks:
        n_features, n = bins.shape
        g = _gradients(y, margin, first)
        at = _places(bins, levels)
        base = at.astype(np.int64)
        base *= pair
        wg = g if w is None else g * w
        weights = [None, *([w] if w is not None else []), wg, *([wg * g] if squares else [])]
        key, cell = np.empty(n, np.int64), np.empty(n, np.uint16)  # one of each for all pairs: memory stays in the cache
        got = []
        for i in range(0, n_features, 2):
            np.multiply(bins[i], np.uint16(n_bins), out=cell)
            if i + 1 < n_features:
                cell += bins[i + 1]
            np.add(base, cell, out=key)
            got += [np.bincount(key, x, nodes * pair) for x in weights]
        if not squares:
            got.append(np.bincount(at, wg * g, nodes))
        if total is None:
            total = got
        else:
            for a, b in zip(total, got):
                a += b
    if total is None:
        return
    kinds = (len(total) - (not squares)) // ((n_features + 1) // 2)
    by_bin = [[] for _ in range(kinds)]
    for i in range(0, n_features, 2):
        for kind in range(kinds):
            cells = total[i // 2 * kinds + kind].reshape(nodes, n_bins, n_bins)
            by_bin[kind] += [cells.sum(axis=2), cells.sum(axis=1)][:n_features - i]
    yield [np.stack(x, axis=1) for x in by_bin] + ([] if squares else [total[-1]])


def _add_tree(levels: list[Level], values: np.ndarray, block: tuple) -> tuple:
    """Margins with the leaf values of a tree added."""
    bins, y, w, margin = block
    return bins, y, w, margin + values[_places(bins, levels)]


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


# ---------------------------------------------------------------- trees
class Tree:
    """Nodes by heap place (root 1, children 2i and 2i + 1): [rows, weight, sum,
    sum of squares, gain, feature, last bin], feature -1 at a leaf."""

    def __init__(self, max_depth: int):
        self.max_depth = max_depth
        self.nodes: dict[int, list] = {}
        self.levels: list[Level] = []

    def grow_all(self, sums_of, weighted: bool, candidates: list[int]) -> None:
        """Level by level, out of `sums_of(levels, squares)`."""
        grown = True
        while grown and len(self.levels) < self.max_depth:
            squares = len(self.levels) == self.max_depth - 1
            grown = self.grow(sums_of(self.levels, squares), weighted, squares, candidates)

    def grow(self, sums: list[np.ndarray], weighted: bool, squares: bool, candidates: list[int]) -> bool:
        """The next level out of its sums; False if no node is split."""
        depth = len(self.levels)
        live = [k for k in range(1 << depth) if depth == 0 or (1 << depth) + k in self.nodes]
        rows, weight = sums[0], sums[1] if weighted else sums[0].astype(np.float64)
        grad, square = sums[-2], sums[-1]
        level: Level = []
        n, s, c = (np.cumsum(x, axis=2) for x in (weight, grad, rows))
        q = np.cumsum(square, axis=2) if squares else None
        in_use = np.arange(rows.shape[2] - 1)[None, :] < np.array(candidates)[:, None]
        for k in live:
            all_c, all_n, all_s = c[k, 0, -1], n[k, 0, -1], s[k, 0, -1]
            all_q = q[k, 0, -1] if squares else square[k]
            node = [int(all_c), float(all_n), float(all_s), float(all_q), -1.0, -1, -1]
            self.nodes[(1 << depth) + k] = node
            impurity = (all_q - all_s * all_s / all_n) / all_n if all_n > 0 else 0.0
            if abs(impurity) < EPSILON:
                continue
            left_n, left_s, left_c = n[k, :, :-1], s[k, :, :-1], c[k, :, :-1]
            right_n, right_s = all_n - left_n, all_s - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                share = [np.where(x > 0, y * y / x, 0.0) for x, y in ((left_n, left_s), (right_n, right_s))]
                gain = (share[0] + share[1] - all_s * all_s / all_n) / all_n
            gain = np.where(in_use & (left_c > 0) & (left_c < all_c), gain, -1.0)
            # the first of equal gains, however their sums were rounded
            best = int(np.argmax(gain >= gain.max() - 1e-12 * abs(impurity)))
            feature, last = divmod(best, in_use.shape[1])
            if not gain[feature, last] > 4 * EPSILON * abs(impurity):
                continue
            node[4:] = [float(gain[feature, last]), feature, last]
            level.append((k, feature, last))
            at = 2 * ((1 << depth) + k)
            for child, sign in ((at, 1), (at + 1, -1)):
                side = [x[k, feature, last] for x in (c, n, s)]
                side.append(q[k, feature, last] if squares else np.nan)  # known one level further down
                whole = (all_c, all_n, all_s, all_q)
                a = side if sign == 1 else [y - x for x, y in zip(side, whole)]
                self.nodes[child] = [int(a[0]), *map(float, a[1:]), -1.0, -1, -1]
        if level:
            self.levels.append(level)
        return bool(level)

    def values(self) -> np.ndarray:
        """Leaf values by the place that `_places` gives below all levels."""
        depth = len(self.levels)
        out = np.zeros(1 << depth)
        for at, node in self.nodes.items():
            if node[5] < 0:
                level = at.bit_length() - 1
                out[(at - (1 << level)) << (depth - level)] = node[2] / node[1] if node[1] else 0.0
        return out


def _saved_nodes(tree: Tree, cuts: list[np.ndarray]) -> Iterator[tuple]:
    """Nodes as Spark ML saves them: numbered from 0, a parent before its left
    side before its right side."""
    size: dict[int, int] = {}
    for at in sorted(tree.nodes, reverse=True):
        size[at] = 1 + (0 if tree.nodes[at][5] < 0 else size[2 * at] + size[2 * at + 1])
    todo = [(1, 0)]
    while todo:
        at, number = todo.pop()
        count, n, s, q, gain, feature, last = tree.nodes[at]
        value, impurity = (s / n, (q - s * s / n) / n) if n else (0.0, 0.0)
        left, right, split = -1, -1, (-1, [], -1)
        if feature >= 0:
            left, right = number + 1, number + 1 + size[2 * at]
            split = (feature, [float(cuts[feature][last])], -1)
            todo += [(2 * at + 1, right), (2 * at, left)]
        yield number, value, impurity, [n, s, q], count, gain, left, right, split


def _model(estimator: GBTClassifier, spark, trees: list[Tree], rates: list[float],
           cuts: list[np.ndarray]) -> GBTClassificationModel:
    """The trees as Spark ML's model, handed over in its file format (one call
    of the JVM per node takes longer than many a training)."""
    from flowlens.session import Scratch
    sc, disk = spark.sparkContext, Scratch(spark, "gbt-model")
    ml = sc._jvm.org.apache.spark.ml
    leaf = ml.tree.LeafNode(0.0, 0.0, sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(
        sc._gateway.new_array(sc._jvm.double, 3), 0))
    one = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, 1)
    one[0] = ml.regression.DecisionTreeRegressionModel(leaf, len(cuts))
    made = ml.classification.GBTClassificationModel(estimator.uid, one, sc._gateway.new_array(sc._jvm.double, 1),
                                                    len(cuts), 2)
    # an empty model has the parameters and the layout of this Spark version
    empty, full = disk.path("empty"), disk.path("full")
    estimator._to_java().copyValues(made, ml.param.ParamMap()).save(empty)
    about = json.loads(spark.read.text(f"{empty}/metadata").first()[0]) | {"numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{full}/metadata")
    of_trees = spark.read.parquet(f"{empty}/treesMetadata")
    about_tree = of_trees.first()[1]
    spark.createDataFrame([(i, about_tree, rate) for i, rate in enumerate(rates)], of_trees.schema).coalesce(1) \
        .write.parquet(f"{full}/treesMetadata")
    nodes = [(i, node) for i, tree in enumerate(trees) for node in _saved_nodes(tree, cuts)]
    spark.createDataFrame(nodes, spark.read.parquet(f"{empty}/data").schema).coalesce(1).write.parquet(f"{full}/data")
    model = GBTClassificationModel.load(full)
    disk.drop("empty", "full")
    return model


# ---------------------------------------------------------------- training
def _layout(df: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """Rows on as many tasks as have a block of work, and the number of tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = 1 if n_rows <= ONE_TASK_ROWS else min(max(cores, -(-n_rows // PARTITION_ROWS)), -(-n_rows // BLOCK_ROWS))
    return (df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df), tasks


def _forget(spark, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fit(estimator: GBTClassifier, rows: DataFrame, features: list[str]) -> GBTClassificationModel:
    """`estimator` fitted to all of `rows`: finite doubles `features`, the label
    (0 or 1), the weight if the estimator names one."""
    from flowlens.session import ensure_checkpoint_dir
    if not features:
        raise ValueError("no feature to train on")
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    get = estimator.getOrDefault
    label, max_depth, rounds = get("labelCol"), get("maxDepth"), get("maxIter")
    weight_col = get("weightCol") if estimator.isDefined("weightCol") else None
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    n_rows, weight, bad = rows.agg(F.count(F.lit(1)), F.sum(w), F.count_if(
        ~F.coalesce(F.col(label).isin(0, 1) & (w >= 0) & (w < float("inf")), F.lit(False)))).first()
    if bad:
        raise ValueError(f"{bad} rows have a label other than 0 and 1 or a weight that is no finite number from 0 on")
    cuts = split_candidates(rows, features, weight_col, get("seed"), n_rows, weight)
    candidates = [len(c) for c in cuts]
    n_bins = max(2, max(candidates) + 1)

    columns = [*features, F.col(label).cast("double"), *([F.col(weight_col).cast("double")] if weight_col else [])]
    laid, tasks = _layout(rows.select(*columns), n_rows)
    state: RDD = laid.mapInArrow(partial(_blocks, cuts), "bins binary, y binary, w binary").rdd.map(_arrays)
    if state.getNumPartitions() > tasks:
        state = state.coalesce(tasks)
    rates = [1.0] + [get("stepSize")] * (rounds - 1)
    plan = (n_bins, candidates, weight_col is not None, max_depth, rates)
    if tasks == 1:
        trees = state.mapPartitions(partial(_trained, *plan)).collect()
    else:
        trees = _trained_by_jobs(state.persist(KEPT), tasks, *plan)
    return _model(estimator, spark, trees, rates, cuts)


def _trained(n_bins: int, candidates: list[int], weighted: bool, max_depth: int, rates: list[float],
             blocks: Iterable[tuple]) -> Iterator[Tree]:
    """All trees out of the blocks of one task."""
    blocks = list(blocks)
    for m, rate in enumerate(rates):
        tree = Tree(max_depth)
        tree.grow_all(lambda levels, squares: next(_sums(n_bins, levels, m == 0, squares, blocks)),
                      weighted, candidates)
        yield tree
        blocks = [_add_tree(tree.levels, rate * tree.values(), b) for b in blocks]


def _trained_by_jobs(state: RDD, tasks: int, n_bins: int, candidates: list[int], weighted: bool, max_depth: int,
                     rates: list[float]) -> list[Tree]:
    """All trees, a job a level. `state` is persisted, and is not when this ends."""
    trees: list[Tree] = []
    spark = SparkSession.active()
    old, kept = None, None  # what the state's first job still reads

    def sums_of(levels: list[Level], squares: bool) -> list[np.ndarray]:
        nonlocal old, kept
        sums = state.mapPartitions(partial(_sums, n_bins, levels, not trees, squares))
        found = sums.treeReduce(_merged) if tasks > TREE_REDUCE_FROM else _total(sums.collect())
        if old is not None:
            old.unpersist()
            old = None
            if state.isCheckpointed():
                _forget(spark, kept)
                kept = state.getCheckpointFile()
        return found

    for m, rate in enumerate(rates):
        tree = Tree(max_depth)
        tree.grow_all(sums_of, weighted, candidates)
        trees.append(tree)
        if m + 1 < len(rates):
            old = state
            state = state.map(partial(_add_tree, tree.levels, rate * tree.values())).persist(KEPT)
            if (m + 1) % CHECKPOINT_EVERY == 0:
                state.checkpoint()
    state.unpersist()
    _forget(spark, kept)
    return trees


def _total(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    out = parts[0]
    for p in parts[1:]:
        out = _merged(out, p)
    return out

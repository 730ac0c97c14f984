"""Importances of Spark ML's random forest, with the trees grown inside tasks.

Spark ML puts every tree together on the driver and reads all rows once for each group of nodes. Here it fits
the top of the trees only; below, a task grows a whole node from the binned rows of its bag, and returns nothing
but the gains by feature. Bins, bags and the choice of splits are Spark ML's, so the importances are those of its
full fit. Where sums of the target are rounded, two splits of equal gain may be taken the other way round; Spark ML
adds in no fixed order either.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a task grows whole trees; beyond, Spark ML splits the top until nodes have about so many rows.
TASK_ROWS = 1 << 20
#: Levels the top may have: its nodes come to the driver.
TOP_LEVELS = 10
#: Whole trees that a task grows from one copy of the rows.
BLOCK = 10
#: Rows from which Spark ML chooses its bins.
BIN_ROWS = 10_000


class Node(NamedTuple):
    """A node of the top of a tree: a split (feature, bin, children), or, with feature -1, a unit of work."""

    feature: int
    cut: int
    left: int
    right: int
    unit: int


class Unit(NamedTuple):
    """What a task grows from one set of rows: some trees, below nodes of one depth."""

    group: int
    trees: tuple[int, ...]
    levels: int


def importances(
    groups: Sequence[DataFrame], sizes: Sequence[int], columns: Sequence[str], target: str,
    fit: Callable[[DataFrame, int], tuple[RandomForestRegressor, object]], max_depth: int,
) -> list[np.ndarray]:
    """Importance of each column for each of the ``groups``, which hold ``columns`` and ``target`` as doubles.

    The groups are read several times, with rows in the same places: they must be read from files. ``fit`` returns
    the estimator and its model, fitted to a depth.
    """
    spark, k = groups[0].sparkSession, len(columns)
    units: list[Unit] = []
    dealt, sums, counts = None, [], []
    for g, (rows, n) in enumerate(zip(groups, sizes)):
        levels = min(max_depth, math.ceil(math.log2(n / TASK_ROWS))) if n > TASK_ROWS else 0
        edges, top = None, None
        while top is None:
            forest, model = fit(rows, levels)
            edges = edges or _edges(rows.select(*columns), n, forest.getMaxBins(), forest.getSeed())
            top = _Top(model, edges)
            if top.largest > 2 * TASK_ROWS and levels < min(max_depth, TOP_LEVELS):
                top, levels = None, min(levels + 2, max_depth, TOP_LEVELS)
        sums.append(top.sums)
        counts.append(top.counts)
        sent = _deal(_bagged(rows.select(target, *columns), edges, forest), top.plan(g, units, max_depth), k, len(top.sums))
        dealt = sent if dealt is None else dealt.unionAll(sent)
    volume = sum(n * (k + 8 + BLOCK) * -(-len(s) // BLOCK) for n, s in zip(sizes, sums))
    parts = min(len(units), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * BLOCK, volume >> 25))
    placed = dealt.repartitionById(parts, (F.col("unit") % parts).cast("int")).sortWithinPartitions("unit")
    found = placed.mapInArrow(_grower(units, k), "g int, tree int, weight double, gains array<double>")
    by_tree = found.groupBy("g", "tree").agg(
        F.sum("weight").alias("weight"), *[F.sum(F.col("gains")[f]).alias(f"f{f}") for f in range(k)]
    )
    # one row for each group and tree
    for row in by_tree.collect():
        if row.weight != counts[row.g][row.tree]:
            raise RuntimeError("the bags of the tasks are not those of the forest")
        counts[row.g][row.tree] = 0.0
        sums[row.g][row.tree] += np.array([row[f"f{f}"] for f in range(k)])
    if any(c.any() for c in counts):
        raise RuntimeError("a tree was not grown")
    return [_normalised(s) for s in sums]


def _normalised(sums: np.ndarray) -> np.ndarray:
    """Gains by tree and feature to importances that add to 1; a tree without a split has none."""
    by_tree = sums.sum(axis=1, keepdims=True)
    total = np.divide(sums, by_tree, out=np.zeros_like(sums), where=by_tree != 0).sum(axis=0)
    return total / total.sum() if total.sum() else total


# -- bins and bags ---------------------------------------------------------------------------------


def _edges(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each column but the last, as Spark ML's findSplits chooses them.

    It looks at a sample by place; the same sample is drawn here, about ``BIN_ROWS`` rows at most.
    """
    bins, fraction = min(max_bins, n), min(1.0, max(max_bins**2, BIN_ROWS) / n)
    if fraction < 1.0:
        spark, java = rows.sparkSession, rows.sparkSession._jvm
        draw = java.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        some = rows._jdf.toJavaRDD().sample(False, fraction, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark)
    seen = rows.toPandas().to_numpy(dtype=float)
    return [column_edges(seen[:, f], fraction * n, bins - 1) for f in range(seen.shape[1])]


def column_edges(seen: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most about ``most`` bounds between the distinct values; zeros are as many as are missing to ``expected``."""
    values, weights = np.unique(seen[seen != 0], return_counts=True)
    if not len(values):
        return values
    zeros = expected - weights.sum()
    if zeros > sys.float_info.epsilon * weights.sum() * 100:
        at = int(np.searchsorted(values, 0.0))
        values, weights = np.insert(values, at, 0.0), np.insert(weights.astype(float), at, zeros)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = expected / (most + 1)
    chosen, until, goal = [], float(weights[0]), stride
    for i in range(1, len(values)):
        before, until = until, until + float(weights[i])
        if abs(before - goal) < abs(until - goal):
            chosen.append(i - 1)
            goal += stride
    return middles[chosen]


def _bagged(rows: DataFrame, edges: list[np.ndarray], forest: RandomForestRegressor) -> DataFrame:
    """One binary value for each row: Spark ML's BaggedPoint of the target and the bins, as Java writes it.

    The number of times a row is in the bag of a tree depends on its partition and place there alone.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out = np.empty((batch.num_rows, 8 + len(edges)), np.uint8)
            out[:, :8] = np.ascontiguousarray(target, "<f8").view(np.uint8).reshape(-1, 8)
            for f, (e, v) in enumerate(zip(edges, values)):
                out[:, 8 + f] = np.searchsorted(e, v)
            yield pa.RecordBatch.from_arrays([_binary(out)], names=["value"])

    spark = rows.sparkSession
    java = spark._jvm.org.apache.spark
    packed = getattr(rows.mapInArrow(pack, "value binary")._jdf, "as")(java.sql.Encoders.BINARY()).rdd()
    bags = java.ml.tree.impl.BaggedPoint
    points = bags.convertToBaggedRDD(
        packed, forest.getSubsamplingRate(), forest.getNumTrees(), forest.getBootstrap(),
        getattr(bags, "convertToBaggedRDD$default$5")(), forest.getSeed(),
    )
    kind = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(bags._fqn)
    return DataFrame(spark._jsparkSession.createDataset(points, java.sql.Encoders.javaSerialization(kind)).toDF(), spark)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _unpack(values: pa.Array, k: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Target and bins as bytes, and the counts by tree, of values that :func:`_bagged` made.

    Each of the two arrays stands behind 19 bytes that name its kind, and its length. What follows the second is the
    unused rest of a buffer.
    """
    wide = values.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    all_bytes = np.frombuffer(wide.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    width, own = int(ends[1] - ends[0]), 8 + k
    if not (np.diff(ends) == width).all():
        raise RuntimeError("bagged rows differ in length")
    table = all_bytes.reshape(-1, width)
    packed = _array(table, table[0].tobytes().find(b"ur\x00\x02[B"), b"ur\x00\x02[B", own, 1)
    counts = _array(table, packed[1], b"ur\x00\x02[I", trees, 4)
    return packed[0], counts[0].view(">i4").astype(np.uint8)


def _array(table: np.ndarray, at: int, kind: bytes, n: int, size: int) -> tuple[np.ndarray, int]:
    """Bytes of the array of ``n`` items at a place of each row, and the place behind it."""
    head = table[:, at : at + 23] if at >= 0 else table[:, :0]
    if not (head == head[0]).all() or not head[0].tobytes().startswith(kind) or head[0, 19:].tobytes() != n.to_bytes(4, "big"):
        raise RuntimeError("bagged rows are laid out otherwise")
    end = at + 23 + n * size
    return np.ascontiguousarray(table[:, at + 23 : end]), end


# -- the top of the trees --------------------------------------------------------------------------


class _Top:
    """The trees that Spark ML has fitted so far: their gains by feature, and the nodes still to be grown."""

    def __init__(self, model, edges: list[np.ndarray]):
        roots = [t._call_java("rootNode") for t in model.trees]
        self.edges, self.largest = edges, 0.0
        self.sums = np.zeros((len(roots), len(edges)))
        self.counts = np.array([r.impurityStats().count() for r in roots], dtype=float)
        self.trees = [self._tree(t, r, model.getMaxDepth()) for t, r in enumerate(roots)]

    def _tree(self, t: int, root, depth: int) -> list[tuple]:
        """Nodes as (feature, cut, left, right, level); a leaf has feature -1."""
        nodes, waiting = [None], [(0, root, 0)]
        while waiting:
            i, node, level = waiting.pop()
            if node.getClass().getSimpleName() != "InternalNode":
                nodes[i] = (-1, 0, 0, 0, level)
                # other leaves have no split
                self.largest = max(self.largest, node.impurityStats().count() if level == depth else 0.0)
                continue
            f, bound = node.split().featureIndex(), node.split().threshold()
            cut = int(np.searchsorted(self.edges[f], bound))
            if cut == len(self.edges[f]) or self.edges[f][cut] != bound:
                raise RuntimeError("the bins are not those of the forest")
            self.sums[t, f] += node.gain() * node.impurityStats().count()
            left, right = len(nodes), len(nodes) + 1
            nodes += [None, None]
            nodes[i] = (f, cut, left, right, level)
            waiting += [(left, node.leftChild(), level + 1), (right, node.rightChild(), level + 1)]
        return nodes

    def plan(self, group: int, units: list[Unit], max_depth: int) -> list[tuple[tuple[int, ...], list[Node]]]:
        """Trees that share their rows, and their nodes. New units are added to ``units``."""
        if all(len(t) == 1 for t in self.trees):
            every = range(len(self.trees))
            shared = [(tuple(every[i : i + BLOCK]), self.trees[i]) for i in every[::BLOCK]]
        else:
            shared = [((t,), nodes) for t, nodes in enumerate(self.trees)]
        plan = []
        for trees, nodes in shared:
            placed = []
            for f, cut, left, right, level in nodes:
                placed.append(Node(f, cut, left, right, len(units) if f < 0 else -1))
                if f < 0:
                    units.append(Unit(group, trees, max_depth - level))
            plan.append((trees, placed))
        return plan


def _deal(bagged: DataFrame, plan: list[tuple[tuple[int, ...], list[Node]]], k: int, trees: int) -> DataFrame:
    """Rows of each unit as bytes: target and bins of all rows, then their counts in the unit's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed, counts = _unpack(batch.column(0), k, trees)
            ids, blobs = [], []
            for own, nodes in plan:
                mine = np.ascontiguousarray(counts[:, list(own)])
                for unit, rows in _leaves(packed[:, 8:], np.flatnonzero(mine.any(axis=1)), nodes):
                    ids.append(unit)
                    blobs.append(packed[rows].tobytes() + mine[rows].tobytes())
                if sum(map(len, blobs)) > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["unit", "rows"])
                    ids, blobs = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["unit", "rows"])

    return bagged.mapInArrow(run, "unit int, rows binary")


def _leaves(bins: np.ndarray, rows: np.ndarray, nodes: list[Node]) -> Iterator[tuple[int, np.ndarray]]:
    """Unit and rows of each leaf of a top that has rows."""
    waiting = [(0, rows)]
    while waiting:
        i, some = waiting.pop()
        if not len(some):
            continue
        node = nodes[i]
        if node.feature < 0:
            yield node.unit, some
        else:
            right = bins[some, node.feature] > node.cut
            waiting += [(node.left, some[~right]), (node.right, some[right])]


# -- the rest of the trees -------------------------------------------------------------------------


def _grower(units: list[Unit], k: int):
    """Rows sorted by unit to the weight and the gains of each tree of a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if unit != at and held:
                    yield grown(at, held)
                    held = []
                at = unit
                held.append(blob.as_py())
        if held:
            yield grown(at, held)

    def grown(at: int, held: list[bytes]) -> pa.RecordBatch:
        unit = units[at]
        packed, counts = _joined(held, k, len(unit.trees))
        target = np.ascontiguousarray(packed[:, :8]).view("<f8")[:, 0]
        which, bins = _distinct(packed[:, 8:])
        weights, gains = [], []
        for t in range(len(unit.trees)):
            w = counts[:, t].astype(float)
            sums = [np.bincount(which, x, bins.shape[1]) for x in (w, w * target, w * target * target)]
            weights.append(sums[0].sum())
            drawn = np.flatnonzero(sums[0])
            gains.append(grown_gains(np.ascontiguousarray(bins[:, drawn]), np.stack(sums)[:, drawn], unit.levels))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([unit.group] * len(weights), pa.int32()),
                pa.array(unit.trees, pa.int32()),
                pa.array(weights, pa.float64()),
                pa.array([g.tolist() for g in gains], pa.list_(pa.float64())),
            ],
            names=["g", "tree", "weight", "gains"],
        )

    return run


def _joined(held: list[bytes], k: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    packed, counts = [], []
    for blob in held:
        n = len(blob) // (8 + k + trees)
        flat = np.frombuffer(blob, np.uint8)
        packed.append(flat[: n * (8 + k)].reshape(n, 8 + k))
        counts.append(flat[n * (8 + k) :].reshape(n, trees))
    return np.concatenate(packed), np.concatenate(counts)


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct row for each row, and the distinct rows by column. No tree tells equal rows apart."""
    n, k = bins.shape
    words = np.zeros((n, -(-k // 8) * 8), np.uint8)
    words[:, :k] = bins
    keys = words.view("<u8")
    order = np.lexsort(keys.T)
    new = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)] if n else np.zeros(0, bool)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return which, np.ascontiguousarray(bins[order[new]].T)


def _variance(w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (q - (s * s) / w) / w


def grown_gains(bins: np.ndarray, sums: np.ndarray, levels: int) -> np.ndarray:
    """Gain times weight by feature of the regression tree over distinct rows, grown level by level.

    ``bins`` has a row for each feature; ``sums`` has the weight, the sum and the sum of squares of the target.
    A split must gain; of equal ones the first feature and the lowest bin win. While nodes are large, the sums of a
    feature are counted into a table of nodes and bins. Then it gets an order of the rows by node and bin, which a
    level only takes apart, and which loses the rows of nodes that the feature does not tell apart.
    """
    k, n = bins.shape
    gains, widths = np.zeros(k), [int(b.max()) + 1 if n else 1 for b in bins]
    orders: list[np.ndarray | None] = [None] * k
    every, node, total = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), sums.sum(axis=1)[:, None]
    while levels > 0 and len(every):
        levels -= 1
        m = total.shape[1]
        here_sums, at = sums.take(every, axis=1), node.take(every).astype(np.int64)
        impurity = _variance(*total)
        best, feature, cut, left = np.zeros(m), np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros((3, m))
        for f in range(k):
            rows, width = orders[f], widths[f]
            if rows is None and m * width <= len(every) // 2:
                key = at * width
                key += bins[f].take(every)
                table = np.stack([np.bincount(key, x, m * width) for x in here_sums])
                cell = np.flatnonzero(table[0])
                running, of = table.take(cell, axis=1), cell // width
                bin_of = cell - of * width
            else:
                if rows is None:
                    orders[f] = rows = every.take(np.argsort((at << 8) | bins[f].take(every), kind="stable"))
                key = node.take(rows) << 8
                key |= bins[f].take(rows)
                cell = _starts(key)
                of = key.take(cell) >> 8
                told = np.zeros(m, bool)
                told[of[1:][of[1:] == of[:-1]]] = True
                keep = told[of]
                if not keep.all():
                    lengths = np.diff(cell, append=len(rows))
                    orders[f] = rows = rows.take(np.flatnonzero(np.repeat(keep, lengths)))
                    key, of, lengths = key[cell][keep], of[keep], lengths[keep]
                    cell = np.cumsum(lengths) - lengths
                else:
                    key = key[cell]
                bin_of = key & 255
                running = np.stack([np.add.reduceat(x.take(rows), cell) if len(cell) else x[:0] for x in sums])
            inner = np.flatnonzero(of[1:] == of[:-1])
            if not len(inner):
                continue
            _run_within(running, of)
            here = of.take(inner)
            start = _starts(here)
            own = here[start]
            w, s, q = running.take(inner, axis=1)
            total_w, total_s, total_q = total.take(here, axis=1)
            rest = total_w - w
            gain = (
                impurity.take(here)
                - w / total_w * _variance(w, s, q)
                - rest / total_w * _variance(rest, total_s - s, total_q - q)
            )
            most = np.maximum.reduceat(gain, start)
            better = np.flatnonzero(most > best[own])
            if not len(better):
                continue
            hits = np.flatnonzero(gain == np.repeat(most, np.diff(start, append=len(gain))))
            hits = hits[_starts(here[hits])][better]
            won = own[better]
            best[won], feature[won] = most[better], f
            cut[won] = bin_of[inner[hits]]
            left[:, won] = running[:, inner[hits]]
        split = feature >= 0
        gains += np.bincount(feature[split], (best * total[0])[split], k)
        right = total - left
        side = bins.ravel().take(feature.take(at) * np.int64(n) + every) > cut.take(at)
        sizes = np.bincount(at * 2 + side, minlength=2 * m)
        # a pure node, and one of equal rows, has no split
        with np.errstate(divide="ignore", invalid="ignore"):
            open_left = split & (sizes[::2] > 1) & ~(np.abs(_variance(*left)) < sys.float_info.epsilon)
            open_right = split & (sizes[1::2] > 1) & ~(np.abs(_variance(*right)) < sys.float_info.epsilon)
        # children are numbered left ones first, so that orders stay sorted by node
        lefts = np.where(open_left, np.cumsum(open_left) - 1, -1)
        rights = np.where(open_right, np.cumsum(open_right) - 1 + open_left.sum(), -1)
        node[every] = np.where(side, rights.take(at), lefts.take(at))
        total = np.concatenate([left[:, open_left], right[:, open_right]], axis=1)
        bound = open_left.sum()
        every = every.take(np.flatnonzero(node.take(every) >= 0))
        for f in range(k):
            if (rows := orders[f]) is None:
                continue
            to = node.take(rows)
            going = np.flatnonzero((to >= 0) & (to < bound)), np.flatnonzero(to >= bound)
            orders[f] = rows.take(np.concatenate(going))
    return gains


def _starts(values: np.ndarray) -> np.ndarray:
    """Places where a value other than the one before stands."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _run_within(sums: np.ndarray, of: np.ndarray) -> None:
    """Running sums over the neighbours of one node, in place; no sum takes in another node's rows."""
    step = 1
    while step < len(of):
        same = of[step:] == of[:-step]
        if not same.any():
            return
        for x in sums:
            x[step:] += x[:-step] * same
        step *= 2

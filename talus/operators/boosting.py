"""Second-order gradient boosting of trees over histograms, for any loss that gives two derivatives.

Rows are binned once (at most BINS bins a feature). Where a task can hold all of them (TASK_ROWS
rows of up to WIDE features), they are sent to the executors once and each model (a fold, a weight,
a setting of a search) is trained by a task of its own, from the first tree to the last.

More rows are written out and trained in passes. For each level of a tree every task adds up the
gradients and second derivatives of its rows by model, node, feature and bin, Spark brings the
tasks' histograms of a model and feature together and adds them up, and the driver picks the
splits: what comes to it is the histogram of a level, models x nodes x features x bins cells
whatever the number of rows. Many models are trained in the same passes. Margins are written out
every CUT trees, so that a pass only walks the trees since then; no other trees are sent to the
tasks. Both ways grow the same trees.

A missing feature is 0; rows without a label train nothing and are scored; repeated rows count
each time; an empty table gives models without trees.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.runtime import stage

BINS, CUT = 64, 4

#: A task trains a model alone on up to TASK_ROWS rows of up to WIDE features (72 MB); a task of a pass walks a SHARES-th of as many rows times models.
TASK_ROWS, WIDE, SHARES = 2_000_000, 16, 8


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -60, 60)))


@dataclass(frozen=True)
class Logistic:
    """Log loss, positives weighted."""

    positive: float = 1.0

    @property
    def most(self) -> float:
        """No derivative is greater."""
        return max(1.0, self.positive)

    def derivatives(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = _sigmoid(margin), np.where(y == 1, self.positive, 1.0)
        return w * (p - y), w * p * (1 - p)

    def loss(self, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, self.positive, 1.0) * (np.logaddexp(0, margin) - y * margin)


@dataclass(frozen=True)
class CostSensitive:
    """The cost-weighted loss with smoothed targets: the derivatives that `ml.cost_gradient` gives as columns."""

    cost: float = 5.0
    smoothing: float = 0.01

    @property
    def most(self) -> float:
        return max(1.0, self.cost)

    def derivatives(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = _sigmoid(margin), np.where(y == 1, self.cost, 1.0)
        return w * (p - (y * (1 - self.smoothing) + 0.5 * self.smoothing)), w * p * (1 - p)

    def loss(self, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
        target = y * (1 - self.smoothing) + 0.5 * self.smoothing
        return np.where(y == 1, self.cost, 1.0) * (np.logaddexp(0, margin) - target * margin)


@dataclass(frozen=True)
class Setting:
    """One model to train. fold: rows of that fold are held out and watched for early stopping."""

    objective: Logistic | CostSensitive = Logistic()
    fold: int | None = None
    trees: int = 500
    depth: int = 5
    step: float = 0.05
    gamma: float = 0.0
    l2: float = 1.0
    least_hessian: float = 1.0
    patience: int = 30
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; feature -1 is a leaf, x <= threshold (bin <= cut) goes left, right is left + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def walk(self) -> "Walk":
        feature, cut, left = (np.array(a, np.int32) for a in (self.feature, self.cut, self.left))
        leaf, depth = feature < 0, np.zeros(len(feature), np.int32)
        for node in np.flatnonzero(~leaf):  # children come behind their parents
            depth[left[node] : left[node] + 2] = depth[node] + 1
        return Walk(np.where(leaf, 0, feature), np.where(leaf, BINS, cut), np.where(leaf, np.arange(len(leaf)), left), np.array(self.value), int(depth.max()))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each binned row ends in."""
        return self.walk().leaves(bins)

    def split(self, node: int, feature: int, cut: int, threshold: float, gain: float, sums: tuple[tuple[float, float], tuple[float, float]], setting: Setting) -> tuple[int, int]:
        child = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node], self.left[node], self.gain[node] = feature, cut, threshold, child, gain
        for g, h in sums:
            self.feature.append(-1)
            self.cut.append(0)
            self.threshold.append(0.0)
            self.left.append(0)
            self.value.append(-g / (h + setting.l2) * setting.step)
            self.cover.append(h)
            self.gain.append(0.0)
        return child, child + 1


@dataclass
class Walk:
    """What a task needs of a tree. A leaf leads to itself: no bin is above its cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.int32)
        for _ in range(self.depth):
            at = self.left[at] + (flat[first + self.feature[at]] > self.cut[at])
        return at


def walked(bins: np.ndarray, walks: list[Walk]) -> np.ndarray:
    """The sum of the trees' values for each row."""
    out = np.zeros(len(bins))
    for walk in walks:
        out += walk.value[walk.leaves(bins)]
    return out


@dataclass
class Model:
    setting: Setting
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    watched: list[float] = field(default_factory=list)  # the held-out loss before each tree

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        return walked(bins, self.walks(first))

    def walks(self, first: int = 0) -> list[Walk]:
        return [tree.walk() for tree in self.trees[first:]]


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: quantiles, found by Spark."""
    shares = [(k + 1) / bins for k in range(bins - 1)]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = df.agg(*[F.percentile_approx(value(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in row]


def binned_values(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], side="left")
    return out


def _matrix(column: pa.Array, width: int, dtype=np.uint8) -> np.ndarray:
    """The values of a column of equally long bytes, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = offsets[column.offset], offsets[column.offset + len(column)]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(dtype).reshape(-1, width)


def _packed(matrix: np.ndarray) -> pa.Array:
    """A column of bytes with a row of the matrix each."""
    data, width = np.ascontiguousarray(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def binned(df: DataFrame, key: str, label: str, features: list[str], edges: list[np.ndarray], fold: str | None = None) -> DataFrame:
    """(key, fold, y, u, bins): u is a hash of the key for row sampling, bins a byte a feature."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(width)])
            b = binned_values(x, edges)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "fold", "y", "u")), _packed(b)], [key, "fold", "y", "u", "bins"])

    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select(key, (F.col(fold) if fold else F.lit(None)).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("u"), *xs)
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fold int, y double, u long, bins binary")


def _sampled(u: np.ndarray, setting: Setting, tree: int) -> np.ndarray:
    """Which rows a tree is grown on: by a hash of the row and the tree."""
    if setting.rows >= 1:
        return np.ones(len(u), bool)
    with np.errstate(over="ignore"):
        x = (u.view(np.uint64) ^ np.uint64((setting.seed * 1_000_003 + tree) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < setting.rows


def _unit(rows: int, setting: Setting) -> float:
    """Derivatives are rounded to it, a 2^52nd of all their sum at most, so that sums are exact in any order."""
    return 2.0 ** (math.ceil(math.log2(max(rows, 1) * setting.objective.most)) - 52)


def _derivatives(setting: Setting, margin: np.ndarray, y: np.ndarray, unit: float) -> tuple[np.ndarray, ...]:
    return tuple(np.rint(d / unit) * unit for d in setting.objective.derivatives(margin, y))


def _histograms(rows: DataFrame, models: dict[int, Model], growing: dict[int, Tree], nodes: dict[int, list[int]], tree: int, first: int, width: int, total: int, watch: bool, single: bool, count: int) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
    """For each model (gradients, second derivatives by node, feature and bin; held-out loss and rows)."""
    passed = {k: (m.setting, m.walks(first), growing[k].walk(), np.array(nodes[k])) for k, m in models.items()}
    unit = {k: _unit(count, m.setting) for k, m in models.items()}
    names, kinds = ["model", "feature", "task", "cells", "loss", "held"], "model int, feature int, task int, cells binary, loss double, held double"
    table = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sums = {k: np.zeros((width, 2, len(p[3]) * BINS)) for k, p in passed.items()}
        loss, held = dict.fromkeys(passed, 0.0), dict.fromkeys(passed, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _matrix(batch.column("bins"), width), batch.column("y").to_numpy()
            u, fold = batch.column("u").to_numpy(), batch.column("fold").fill_null(-1).to_numpy()
            margins = _matrix(batch.column("margins"), total, np.float64)
            for k, (s, walks, grown, open_) in passed.items():
                m = margins[:, k] + walked(bins, walks)
                out = fold == s.fold if s.fold is not None else np.zeros(len(y), bool)
                if watch and out.any():
                    loss[k] += s.objective.loss(m[out], y[out]).sum()
                    held[k] += out.sum()
                use = np.flatnonzero(~out & _sampled(u, s, tree))
                slot = np.full(len(grown.feature), -1)
                slot[open_] = np.arange(len(open_))
                slot = slot[grown.leaves(bins[use])]
                live = slot >= 0
                use, slot = use[live], slot[live]
                g, h = _derivatives(s, m[use], y[use], unit[k])
                b = bins[use]
                for f in range(width):
                    cell = slot * BINS + b[:, f]
                    sums[k][f, 0] += np.bincount(cell, g, sums[k].shape[2])
                    sums[k][f, 1] += np.bincount(cell, h, sums[k].shape[2])
        found = [(k, f, task, sums[k][f].tobytes(), loss[k] if f == 0 else 0.0, held[k] if f == 0 else 0.0) for k in passed for f in range(width)]
        yield table(list(zip(*found)))

    def add(group: pa.Table) -> pa.Table:
        """One row of a model's and feature's rows from the tasks, added up in the order of the tasks."""
        group = group.sort_by("task")
        cells = np.zeros(len(group["cells"][0].as_py()) // 8)
        for c in group["cells"]:
            cells += np.frombuffer(c.as_buffer(), np.float64)
        one = [(group["model"][0].as_py(), group["feature"][0].as_py(), 0, cells.tobytes(), sum(group["loss"].to_pylist()), sum(group["held"].to_pylist()))]
        return pa.Table.from_batches([table(list(zip(*one)))])

    found = rows.mapInArrow(run, kinds)
    if not single:  # of one task there is nothing to add up
        found = found.groupBy("model", "feature").applyInArrow(add, kinds)
    out = {}
    for k in models:
        shape = (len(nodes[k]), width, BINS)
        out[k] = [np.zeros(shape), np.zeros(shape), 0.0, 0.0]
    for k, f, _, cells, loss, held in zip(*(c.to_pylist() for c in found.toArrow().columns)):
        g, h = np.frombuffer(cells, np.float64).reshape(2, -1, BINS)
        for i, v in enumerate((loss, held), 2):
            out[k][i] += v
        out[k][0][:, f] += g
        out[k][1][:, f] += h
    return {k: tuple(v) for k, v in out.items()}


def best_splits(g: np.ndarray, h: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, gain, gradients and second derivatives up to the cut) of each node's histogram, the first of equal ones; feature -1 if nothing gains."""
    gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    total_g, total_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    gr, hr = total_g - gl, total_h - hl
    gain = 0.5 * (gl**2 / (hl + setting.l2) + gr**2 / (hr + setting.l2) - total_g**2 / (total_h + setting.l2)) - setting.gamma
    gain[(hl < setting.least_hessian) | (hr < setting.least_hessian)] = -np.inf
    gain = np.where(np.isfinite(gain), np.round(gain, 9), -np.inf).reshape(len(g), -1)
    at, node = np.argmax(gain, axis=1), np.arange(len(g))
    best, (f, cut) = gain[node, at], np.divmod(at, gl.shape[2])
    return np.where(best > 1e-9, f, -1), cut, best, gl[node, f, cut], hl[node, f, cut]


def _columns(setting: Setting, tree: int, width: int) -> np.ndarray:
    """The features that a tree may split by."""
    order = np.random.default_rng([setting.seed, tree]).permutation(width)
    return np.sort(order[: max(1, round(width * setting.columns))])


def _grow(model: Model, tree: Tree, nodes: list[int], g: np.ndarray, h: np.ndarray, allowed: np.ndarray) -> list[int]:
    """Split the nodes of a level, by histograms of the allowed features; the nodes of the next one that can be split."""
    setting, after = model.setting, []
    if nodes[0] == 0:
        tree.cover[0] = float(h[0, 0].sum())
        tree.value[0] = float(-g[0, 0].sum() / (tree.cover[0] + setting.l2) * setting.step)
    found = [a.tolist() for a in best_splits(g, h, setting)]
    for i, (node, f, cut, gain, gl, hl) in enumerate(zip(nodes, *found)):
        if f < 0:
            continue
        sums = ((gl, hl), (float(g[i, f].sum()) - gl, float(h[i, f].sum()) - hl))
        f = int(allowed[f])
        edges = model.edges[f]
        threshold = float(edges[cut]) if cut < len(edges) else float("inf")
        children = tree.split(node, f, cut, threshold, gain, sums, setting)
        # both parts of a node need the least second derivative
        after += [c for c, (_, cover) in zip(children, sums) if cover >= 2 * setting.least_hessian * (1 - 1e-9)]
    return after


@dataclass
class Rows:
    """Binned rows that a task holds, in an order of their own."""

    bins: np.ndarray
    y: np.ndarray
    u: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, width: int) -> "Rows":
        bins = np.concatenate([_matrix(c, width) for c in table["bins"].chunks if len(c)] or [np.zeros((0, width), np.uint8)])
        y, u, fold = table["y"].to_numpy(), table["u"].to_numpy(), pc.fill_null(table["fold"], -1).to_numpy()
        return cls(bins, y, u, fold).part(np.lexsort((*bins.T, fold, y, u)))  # losses don't depend on how the rows came

    def part(self, which: np.ndarray) -> "Rows":
        return Rows(self.bins[which], self.y[which], self.u[which], self.fold[which])


def _alone(rows: Rows, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Train the model; labels and margins, by its best number of trees, of the rows that it held out."""
    s, unit, width = model.setting, _unit(len(rows.y), model.setting), rows.bins.shape[1]
    out = rows.fold == s.fold if s.fold is not None else np.zeros(len(rows.y), bool)
    held, kept = rows.part(out), rows.part(~out)
    watched, margins, turned = np.zeros(len(held.y)), np.zeros(len(kept.y)), np.ascontiguousarray(kept.bins.T)
    best = watched
    for tree in range(s.trees + 1):
        if len(held.y):
            model.watched.append(float(s.objective.loss(watched, held.y).sum()) / len(held.y))
            since = tree - int(np.argmin(model.watched))
            best = watched if since == 0 else best
            if since >= s.patience:
                break
        if tree >= s.trees:
            break
        drawn, allowed = _sampled(kept.u, s, tree), _columns(s, tree, width)
        use, rest = (slice(None), None) if drawn.all() else (np.flatnonzero(drawn), np.flatnonzero(~drawn))
        grown, ends = _grown(model, [turned[f][use] for f in allowed], *_derivatives(s, margins[use], kept.y[use], unit), allowed)
        model.trees.append(grown)
        margins[use] += np.array(grown.value)[ends]
        if rest is not None:
            margins[rest] += walked(kept.bins[rest], [grown.walk()])
        watched = watched + walked(held.bins, [grown.walk()])
    return held.y, best


def _sums(bins: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(gradients and second derivatives, feature, bin)."""
    return np.array([[np.bincount(b, d, BINS) for b in bins] for d in (g, h)])


def _grown(model: Model, bins: list[np.ndarray], g: np.ndarray, h: np.ndarray, allowed: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree of rows that are here, with the bins of each allowed feature; the node that each row ends in.

    Of two children the one with fewer rows is added up; the other's sums are what is left of their parent's.
    """
    tree, nodes, level, ends = Tree(), [0], 0, np.zeros(len(g), np.int64)
    of, rows, sums = dict(zip(allowed.tolist(), bins)), {0: np.arange(len(g))}, {0: _sums(bins, g, h)}
    while nodes:
        after, level = _grow(model, tree, nodes, *np.stack([sums[n] for n in nodes], axis=1), allowed), level + 1
        open_ = set(after) if level < model.setting.depth else set()
        rows_of, sums_of = {}, {}
        for n in nodes:
            if tree.feature[n] < 0:
                ends[rows[n]] = n
                continue
            right = of[tree.feature[n]][rows[n]] > tree.cut[n]
            pair = tree.left[n], tree.left[n] + 1
            rows_of |= zip(pair, (rows[n][~right], rows[n][right]))
            for c in pair:
                if c not in open_:
                    ends[rows_of[c]] = c
            if open_.intersection(pair):
                few, other = sorted(pair, key=lambda c: len(rows_of[c]))
                at = rows_of[few]
                sums_of[few] = _sums([b[at] for b in bins], g[at], h[at])
                sums_of[other] = sums[n] - sums_of[few]
        nodes, rows, sums = [c for c in after if c in open_], rows_of, sums_of
    return tree, ends


def _by_task(labelled: DataFrame, models: list[Model], run: Callable[[Rows, int], pa.RecordBatch], kinds: str, end: Callable[[DataFrame], object]):
    """What `end` makes of run(rows, number) for each model, in a task for each; deep trees first."""
    spark, width = labelled.sparkSession, len(models[0].features)
    shared = spark.sparkContext.broadcast(Rows.of(labelled.toArrow(), width))  # TASK_ROWS rows at most
    order = sorted(range(len(models)), key=lambda k: -models[k].setting.depth)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield run(shared.value, order[i])

    found = end(spark.range(0, len(models), 1, len(models)).mapInArrow(each, kinds))
    shared.destroy()
    return found


def _prepared(df: DataFrame, key: str, label: str, features: list[str], settings: list[Setting], fold: str | None, bins: int) -> tuple[DataFrame, list[Model], int]:
    """(binned rows with a label, models without trees, number of the rows)."""
    if not 2 <= bins <= BINS:
        raise ValueError(f"bins must be from 2 to {BINS}")
    edges, known = bin_edges(df, features, bins), df.where(F.col(label).isNotNull())
    return binned(known, key, label, features, edges, fold), [Model(s, features, edges) for s in settings], known.count()


def _fit_a_task(count: int, models: list[Model]) -> bool:
    return bool(models) and count * max(len(models[0].features), WIDE) <= WIDE * TASK_ROWS


def train(df: DataFrame, key: str, label: str, features: list[str], settings: list[Setting], fold: str | None = None, bins: int = BINS) -> list[Model]:
    """A model for each setting, all trained side by side."""
    labelled, models, count = _prepared(df, key, label, features, settings, fold, bins)
    if _fit_a_task(count, models):

        def run(rows: Rows, k: int) -> pa.RecordBatch:
            _alone(rows, models[k])
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps((models[k].trees, models[k].watched))])], ["model", "found"])

        for k, found in zip(*(c.to_pylist() for c in _by_task(labelled, models, run, "model int, found binary", DataFrame.toArrow).columns)):
            models[k].trees, models[k].watched = pickle.loads(found)
    else:
        _in_passes(labelled, models, count)
    for model in models:
        if model.watched:
            del model.trees[int(np.argmin(model.watched)) :]
    return models


def held_out(df: DataFrame, key: str, label: str, features: list[str], settings: list[Setting], fold: str, bins: int = BINS) -> DataFrame:
    """(model, y, p): what each setting's model gives the rows with a label of the fold that it held out."""
    labelled, models, count = _prepared(df, key, label, features, settings, fold, bins)
    if not _fit_a_task(count, models):
        known = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).withColumn("__y", F.col(label).cast("double"))
        scored = predict(known, key, train(df, key, label, features, settings, fold, bins), ("__y",), fold)
        return stage(scored.select("model", F.col("__y").alias("y"), "p"), "boost-held-out")

    def run(rows: Rows, k: int) -> pa.RecordBatch:
        y, margins = _alone(rows, models[k])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(y), pa.array(_sigmoid(margins))], ["model", "y", "p"])

    return _by_task(labelled, models, run, "model int, y double, p double", lambda found: stage(found, "boost-held-out"))


def _in_passes(labelled: DataFrame, trained: list[Model], count: int) -> None:
    """Train the models on rows that no task holds."""
    models = dict(enumerate(trained))
    width, total, first = len(trained[0].features) if trained else 0, len(trained), 0
    # a pass is short: a task for a share of TASK_ROWS rows times models, as many as there are
    parts = -(-count * total * SHARES // TASK_ROWS)
    rows = stage(labelled.withColumn("margins", F.lit(np.zeros(total).tobytes())).repartition(max(1, parts), "u"), "boost-rows")
    active, tree = dict(models), 0
    most = max((m.setting.trees for m in trained), default=0)
    while active and tree <= most:
        growing = {k: Tree() for k in active}
        nodes = {k: [0] for k in active}
        allowed = {k: _columns(m.setting, tree, width) for k, m in active.items()}
        level = 0
        while nodes:
            open_ = {k: active[k] for k in nodes}
            found = _histograms(rows, open_, growing, nodes, tree, first, width, total, level == 0, parts <= 1, count)
            for k, (g, h, loss, n) in found.items():
                model = active[k]
                if level == 0:
                    if n:
                        model.watched.append(loss / n)
                    stale = n and tree - int(np.argmin(model.watched)) >= model.setting.patience
                    if stale or tree >= model.setting.trees:
                        del active[k]
                        nodes.pop(k)
                        continue
                nodes[k] = _grow(model, growing[k], nodes[k], g[:, allowed[k]], h[:, allowed[k]], allowed[k])
                if not nodes[k] or level + 1 >= model.setting.depth:
                    nodes.pop(k)
            level += 1
        for k in active:
            active[k].trees.append(growing[k])
        tree += 1
        if active and tree % CUT == 0:
            rows, first = _with_margins(rows, models, first, width, total), tree


def _with_margins(rows: DataFrame, models: dict[int, Model], first: int, width: int, total: int) -> DataFrame:
    """The rows with the margins of the trees from `first` on added, written out."""
    walks = {k: m.walks(first) for k, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _matrix(batch.column("bins"), width), _matrix(batch.column("margins"), total, np.float64).copy()
            for k, trees in walks.items():
                margins[:, k] += walked(bins, trees)
            at = batch.schema.get_field_index("margins")
            yield batch.set_column(at, "margins", _packed(margins))

    return stage(rows.mapInArrow(run, rows.schema), "boost-margins")


def predict(df: DataFrame, key: str, models: list[Model], carry: tuple[str, ...] = (), own_fold: str | None = None) -> DataFrame:
    """(key, carried columns, model, p) for each row and model; with own_fold, a model scores the
    rows of the fold that it held out, and rows without a fold are scored by every model."""
    if not models:
        raise ValueError("no models")
    features, edges, width = models[0].features, models[0].edges, len(models[0].features)
    names, walks = [key, *carry], [m.walks() for m in models]
    held = [m.setting.fold for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = binned_values(np.column_stack([batch.column(f"__x{i}").to_numpy() for i in range(width)]), edges)
            fold = batch.column("__fold").to_numpy(zero_copy_only=False)
            for k, trees in enumerate(walks):
                use = np.isnan(fold) | (fold == held[k]) if own_fold else np.ones(len(bins), bool)
                at = pa.array(np.flatnonzero(use))
                p = _sigmoid(walked(bins[use], trees))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(np.full(len(at), k, np.int32)), pa.array(p)], [*names, "model", "p"])

    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(features)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    rows = df.select(*names, (F.col(own_fold) if own_fold else F.lit(None)).cast("double").alias("__fold"), *xs)
    return rows.mapInArrow(run, f"{kinds}, model int, p double")


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], setting: Setting = Setting(), k: int = 5, seed: int = 42) -> tuple[DataFrame, list[Model]]:
    """(key, fold, y, p) as `ml.out_of_fold` gives it, by this learner with early stopping on each fold, and the models."""
    from talus.operators.events import folds

    dealt = folds(df.where(F.col(label).isNotNull()), key, label, k, seed).unionByName(df.where(F.col(label).isNull()).withColumn("fold", F.lit(None).cast("int")))
    dealt = stage(dealt.withColumn("y", F.col(label).cast("int")), "boost-folds")
    models = train(dealt, key, label, features, [replace(setting, fold=f) for f in range(k)], "fold")
    scored = predict(dealt, key, models, ("fold", "y"), "fold")
    return scored.groupBy(key, "fold", "y").agg(F.avg("p").alias("p")), models


def gains(model: Model) -> list[tuple[str, float]]:
    """What each feature's splits gain in all trees."""
    total = dict.fromkeys(model.features, 0.0)
    for tree in model.trees:
        for f, gain in zip(tree.feature, tree.gain):
            if f >= 0:
                total[model.features[f]] += gain
    return list(total.items())



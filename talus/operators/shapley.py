"""Exact Shapley values of trees.

The game of a row: a set S of features is worth the tree's mean output when the features in S
are known, where a split on an unknown feature sends a row both ways in proportion to the
nodes' covers. A leaf of value v whose path asks the features i (each once, conditions merged)
adds v * prod(o_i for i in S) * prod(z_i for i not in S): o_i is 1 if the row meets the path's
conditions on i, z_i the product of the cover shares at the path's splits on i. The Shapley
value of i in such a product game is v (o_i - z_i) times the integral over t in [0, 1] of
prod over the others (z_j (1 - t) + o_j t), a polynomial that Gauss-Legendre nodes sum exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's path: value, features asked, the open-closed interval of each, its cover share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


@dataclass
class Nodes:
    """A tree as arrays: feature (-1 is a leaf), threshold (x <= threshold goes left), children, value, cover."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]


def leaves(tree: Nodes, weight: float = 1.0) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f < 0:
            if path or tree.value[node]:
                bounds = list(path.values())
                out.append(Leaf(weight * tree.value[node], np.array(list(path), np.int64), *(np.array([b[k] for b in bounds], np.float64) for k in range(3))))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        at = tree.threshold[node]
        whole = tree.cover[node]
        for child, lo, hi in ((tree.left[node], low, min(high, at)), (tree.right[node], max(low, at), high)):
            part = tree.cover[child] / whole if whole > 0 else 0.5
            stack.append((child, path | {f: (lo, hi, share * part)}))
    return out


def shapley_values(x: np.ndarray, paths: list[Leaf]) -> tuple[np.ndarray, float]:
    """For each row and feature its Shapley value, and the value of the empty set: rows add up to the output."""
    out, base = np.zeros(x.shape), 0.0
    nodes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for leaf in paths:
        d = len(leaf.features)
        base += leaf.value * float(np.prod(leaf.share))
        if not d:
            continue
        if d not in nodes:  # exact for polynomials of degree d - 1
            t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
            nodes[d] = ((t + 1) / 2, w / 2)
        v = x[:, leaf.features]
        meets = ((v > leaf.low) & (v <= leaf.high)).astype(np.float64)
        part = np.zeros((len(x), d))
        for t, w in zip(*nodes[d]):
            terms = leaf.share * (1 - t) + meets * t
            before = np.cumprod(np.hstack([np.ones((len(x), 1)), terms[:, :-1]]), axis=1)
            after = np.cumprod(np.hstack([np.ones((len(x), 1)), terms[:, :0:-1]]), axis=1)[:, ::-1]
            part += w * before * after
        out[:, leaf.features] += leaf.value * (meets - leaf.share) * part
    return out, base


def shapley_contributions(df: DataFrame, key: str, features: list[str], paths: list[Leaf]) -> DataFrame:
    """(key, margin, base, contributions): base and the features' Shapley values add up to margin.

    A missing feature is 0. The paths are of the size of the model and go to every task.
    """
    shared = df.sparkSession.sparkContext.broadcast(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(f"__x{i}").to_numpy() for i in range(len(features))])
            parts, base = shapley_values(x, shared.value)
            ends = pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32))
            each = pa.StructArray.from_arrays([pa.array(features * len(x), pa.string()), pa.array(parts.ravel())], ["feature", "contribution"])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(base + parts.sum(axis=1)), pa.array(np.full(len(x), base)), pa.ListArray.from_arrays(ends, each)], [key, "margin", "base", "contributions"])

    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(features)]
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *xs).mapInArrow(run, f"`{key}` {kind}, margin double, base double, contributions array<struct<feature:string,contribution:double>>")


def of_boosted(model) -> list[Leaf]:
    """The paths of a model of talus.operators.boosting."""
    out: list[Leaf] = []
    for t in model.trees:
        out += leaves(Nodes(t.feature, t.threshold, t.left, [c + 1 for c in t.left], t.value, t.cover))
    return out


def of_spark(model) -> list[Leaf]:
    """The paths of a fitted GBTClassificationModel of Spark ML, with the rows that trained each node as covers."""
    out: list[Leaf] = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes = Nodes([], [], [], [], [], [])

        def walk(node) -> int:
            at = len(nodes.feature)
            inner = node.subtreeDepth() > 0
            for column, value in zip((nodes.feature, nodes.threshold, nodes.left, nodes.right, nodes.value, nodes.cover), (-1, 0.0, 0, 0, float(node.prediction()), float(node.impurityStats().count()))):
                column.append(value)
            if inner:
                nodes.feature[at], nodes.threshold[at] = int(node.split().featureIndex()), float(node.split().threshold())
                nodes.left[at] = walk(node.leftChild())
                nodes.right[at] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        out += leaves(nodes, float(weight))
    return out

"""Isolation forest: trees on bounded samples of their own, flattened into arrays, scored in Arrow batches.

A point's score is 2 ** (-E[h] / c(n)), h the depth at which a tree isolates
it. Each tree learns from the `sample` rows of least hash under its own seed,
whatever the number of rows, so at most `trees * sample` rows reach the driver.
Scoring is one narrow pass: all rows of a batch go down a tree level by level.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tendril.session import stored

TREES, SAMPLE = 100, 256


def path_constant(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1 and its depth in `value`."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def grown(cls, rows: np.ndarray, rng: random.Random) -> Tree:
        nodes: list[list] = []
        most = math.ceil(math.log2(max(len(rows), 2)))
        waiting = [(rows, 0, None, 0)]  # rows, depth, parent, side
        while waiting:
            own, depth, parent, side = waiting.pop()
            number = len(nodes)
            if parent is not None:
                nodes[parent][side] = number
            spread = np.flatnonzero(own.min(0) < own.max(0)).tolist() if len(own) > 1 else []
            if depth == most or not spread:
                nodes.append([-1, 0.0, 0, 0, depth + (path_constant(len(own)) if len(own) > 1 else 0.0)])
                continue
            k = rng.choice(spread)
            cut = rng.uniform(float(own[:, k].min()), float(own[:, k].max()))
            nodes.append([k, cut, 0, 0, 0.0])
            below = own[:, k] < cut
            waiting += [(own[~below], depth + 1, number, 3), (own[below], depth + 1, number, 2)]
        columns = list(zip(*nodes, strict=True))
        return cls(*(np.array(c, d) for c, d in zip(columns, (np.int32, np.float64, np.int32, np.int32, np.float64), strict=True)))

    def depths(self, x: np.ndarray) -> np.ndarray:
        """The depth of each row's leaf."""
        at = np.zeros(len(x), np.int32)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
        return self.value[at]


def samples(clean: DataFrame, key: str, features: list[str], trees: int, sample: int, seed: int) -> dict[int, np.ndarray]:
    """By tree, the rows of least hash under its seed, in that order; repeated keys count as often as they stand there."""
    n = clean.count()
    if not n:
        return {}
    share = min(1.0, (4.0 * sample + 40) / n)  # about four times the rows of each tree pass, so ranks cost the same at any size
    hashed = lambda tree: F.xxhash64(key, F.lit(seed), tree)
    near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: hashed(tree).cast("double") / 2.0**64 + 0.5 <= share)
    rows = clean.select(key, *features, F.explode(near).alias("_tree"))
    first = Window.partitionBy("_tree").orderBy(hashed(F.col("_tree")), key, *features)
    got = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample).select("_tree", "_rank", *features).orderBy("_tree", "_rank").toArrow()
    tree, x = got.column("_tree").to_numpy(), np.column_stack([got.column(f).to_numpy() for f in features])
    return {k: x[tree == k] for k in np.unique(tree).tolist()}


def isolation_scores(df: DataFrame, key: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """key and anomaly_score in 0 to 1; null features count as 0; fewer than two rows score 0.5.

    The features are stored once, for counting, sampling and scoring each read them.
    """
    clean = stored(df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)), "features")
    learnt = samples(clean, key, features, trees, sample, seed)
    size = max((len(x) for x in learnt.values()), default=0)
    if size < 2:
        return clean.select(key, F.lit(0.5).alias("anomaly_score"))
    grown = [Tree.grown(x, random.Random(seed * 1_000_003 + k)) for k, x in sorted(learnt.items())]
    forest = df.sparkSession.sparkContext.broadcast(grown)  # at most 2 * trees * sample nodes
    scale = max(path_constant(size), 1e-9)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in features]) if batch.num_rows else np.zeros((0, len(features)))
            mean = sum((tree.depths(x) for tree in forest.value), np.zeros(len(x))) / len(forest.value)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(2.0 ** (-mean / scale))], [key, "anomaly_score"])

    return clean.mapInArrow(score, t.StructType([clean.schema[key], t.StructField("anomaly_score", t.DoubleType())]))

"""Isolation forest (Liu, Ting and Zhou 2008) as a Spark job.

Trees are small: each sees at most 256 rows. Rows pick their trees by a seeded hash,
so one pass over the table ships about ``1.5 * trees * sample`` rows, however large the
table is; trees are grown in parallel, one group per tree. The grown forest is bounded
(trees x 2 x sample nodes) and travels to the executors, where Arrow batches of rows
are scored with NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampledger.operators.detectors import RAW
from ampledger.operators.grouped import running_total
from ampledger.session import row_bound, stored

OVERSAMPLE = 1.5
MIN_OVERSAMPLE_ROWS = 64
HASH_RANGE = 1 << 53
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"
EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, features: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree, root first; a leaf's ``depth`` includes the mean path of the
    rows it still holds."""
    nodes: list[list] = []
    stack = [(rows, 0, -1, 0)]
    while stack:
        part, depth, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        low, high = part.min(axis=0), part.max(axis=0)
        usable = features[high[features] > low[features]]
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            nodes.append([me, -1, 0.0, -1, -1, depth + float(average_path(len(part)))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        if cut >= high[feature]:  # rounding must not leave one side empty
            cut = float(low[feature])
        goes_left = part[:, feature] <= cut
        nodes.append([me, feature, cut, -1, -1, float(depth)])
        stack.append((part[~goes_left], depth + 1, me, 1))
        stack.append((part[goes_left], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of one tree's nodes that :func:`depths` follows."""
    return tuple(nodes[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))


def depths(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Path length of each row in one tree; rows go down together."""
    feature, cut, left, right, length = tree
    at = np.zeros(len(x), int)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        here = at[moving]
        lower = x[moving, feature[here]] <= cut[here]
        at[moving] = np.where(lower, left[here], right[here])
        moving = moving[feature[at[moving]] >= 0]
    return length[at]


@dataclass
class ForestModel:
    columns: list[str]
    nodes: pd.DataFrame
    sample_size: int
    invert: bool = True

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``raw_score`` = 2^(-mean depth / c) - 0.5; higher is more anomalous."""
        columns, norm = self.columns, float(average_path(self.sample_size))
        trees = [arrays(g) for _, g in self.nodes.sort_values(["tree", "node"]).groupby("tree")]
        sign = 1.0 if self.invert else -1.0
        shared = df.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in frames:
                x = frame[columns].to_numpy(float)
                depth = np.zeros(len(x))
                for tree in shared.value:
                    depth += depths(x, tree)
                anomaly = np.exp2(-(depth / len(shared.value)) / norm) if norm else np.full(len(x), 0.5)
                yield pd.Series(sign * (anomaly - 0.5))

        # Only the features cross into Python.
        return df.withColumn(RAW, scores(F.struct(*columns)))


@dataclass
class IsolationForest:
    n_trees: int = 100
    sample_size: int = 256
    max_features: float = 1.0
    bootstrap: bool = False
    seed: int = 42
    key: str = "meter_id"
    invert: bool = True

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ForestModel:
        columns, n = list(columns), row_bound(df)
        if n is None:
            n = df.count()
        size = min(self.sample_size, n)
        limit = max(1, math.ceil(math.log2(max(size, 2))))
        sample = self._sample(df.select(self.key, *columns), n, size)
        seed, share, bootstrap = self.seed, self.max_features, self.bootstrap

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            tree = int(frame["tree"].iloc[0])
            rng = np.random.default_rng([seed, tree])
            rows = frame.sort_values("_h")[columns].to_numpy(float)
            if bootstrap:
                rows = rows[rng.integers(0, len(rows), len(rows))]
            used = rng.permutation(len(columns))[: max(1, round(share * len(columns)))]
            nodes = grow(rows, np.sort(used), limit, rng)
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
            out.insert(0, "tree", tree)
            return out

        nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        return ForestModel(columns, nodes, size, self.invert)

    def _sample(self, df: DataFrame, n: int, size: int) -> DataFrame:
        """The ``size`` smallest hashes per tree. Rows whose hash can not be among them
        leave in the map stage. A table of up to the wanted number of rows is taken whole."""
        trees = F.transform(
            F.sequence(F.lit(0), F.lit(self.n_trees - 1)),
            lambda t: F.struct(
                t.cast("int").alias("tree"),
                F.pmod(F.xxhash64(F.lit(self.seed), t, F.col(self.key)), F.lit(HASH_RANGE)).alias("_h"),
            ),
        )
        wanted = OVERSAMPLE * size + MIN_OVERSAMPLE_ROWS
        bound = int(min(1.0, wanted / max(n, 1)) * HASH_RANGE)
        chosen = F.filter(trees, lambda p: p["_h"] < bound)
        picked = df.withColumn("_p", F.explode(chosen)).select("*", "_p.*").drop("_p")
        # a stated number of partitions is not merged, so that trees do grow side by side
        tasks = min(self.n_trees, df.sparkSession.sparkContext.defaultParallelism)
        picked = picked.repartition(tasks, "tree")
        order = Window.partitionBy("tree").orderBy("_h", self.key)
        return picked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= size).drop("_rn")


def permuted(df: DataFrame, columns: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """``key``, ``columns`` and for each ``c`` of them ``c@``: its values dealt out anew.

    Rows are numbered once, by the md5 of seed and key. Column ``i`` of ``d`` takes the value
    of the row that stands ``(i + 1) * n // (d + 1)`` places further on, around the end, so no
    value is lost or doubled. All columns are dealt in one shuffle.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    hashed = df.select(key, *columns).withColumn("_h", digest)
    numbered = stored(running_total(hashed, ["_h", key], name="_no").withColumn("_no", F.col("_no") - 1).drop("_h"))
    n, d = row_bound(numbered), len(columns)
    moved = [
        F.struct(
            F.pmod(F.col("_no") - max(1, (i + 1) * n // (d + 1)), F.lit(max(1, n))).alias("_no"),
            F.lit(i).alias("i"),
            F.col(c).cast("double").alias("v"),
        )
        for i, c in enumerate(columns)
    ]
    dealt = numbered.select(F.explode(F.array(*moved)).alias("m")).select("m.*").groupBy("_no").agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"{c}@") for i, c in enumerate(columns)]
    )
    return numbered.join(dealt, "_no").drop("_no")


def feature_importance(model, df: DataFrame, key: str = "meter_id", seed: int = 42) -> DataFrame:
    """Change of the score variance when one column is permuted, scaled to sum 1.

    The table as it is and with each column permuted are scored in one pass.
    """
    columns = model.columns
    mixed = permuted(df, columns, key, seed)
    variants = [
        F.struct(F.lit(i).alias("_i"), *[F.col(f"`{c}@`" if i == j else c).cast("double").alias(c) for j, c in enumerate(columns)])
        for i in range(-1, len(columns))
    ]
    rows = mixed.select(F.explode(F.array(*variants)).alias("v")).select("v.*")
    found = {r["_i"]: r.v for r in model.score(rows).groupBy("_i").agg(F.var_pop(RAW).alias("v")).collect()}
    changes = [abs(found.get(-1, 0.0) - found.get(i, 0.0)) for i in range(len(columns))]
    whole = sum(changes)
    share = [c / whole if whole > 0 else 1.0 / len(changes) for c in changes]
    return df.sparkSession.createDataFrame(list(zip(columns, share)), "feature string, importance double")

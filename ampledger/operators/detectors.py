"""Detectors: a small protocol, thresholds, distance detectors, evaluation and sweeps."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.functions.columns import finite, is_close, sigmoid, total
from ampledger.operators.grouped import group_quantiles, with_scalars
from ampledger.operators.separation import cluster_quality, silhouette  # noqa: F401  (part of evaluation)
from ampledger.session import no_larger, row_bound, stored

MIN_ROWS = 10
CONTAMINATION = 0.12
EPS = 1e-6
RAW = "raw_score"


class Model(Protocol):
    """A fitted detector."""

    columns: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``raw_score``; higher is more anomalous."""


class Detector(Protocol):
    """What a plug-in has to offer: ``fit`` gives a model that can ``score``."""

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Model: ...


def check_input(df: DataFrame, columns: Sequence[str], min_rows: int = MIN_ROWS) -> int:
    """Rows of a feature table; an error if there are too few, a column is absent or not
    a number, or any value is missing or infinite. One aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [c for c in columns if not isinstance(types.get(c), T.NumericType)]
    if wrong or not columns:
        raise ValueError(f"not numeric feature columns: {wrong}")
    bad = total([F.count_if(finite(F.col(c).cast("double")).isNull()) for c in columns])
    row = df.agg(F.count("*").alias("n"), bad.alias("bad")).first()
    if row.bad:
        raise ValueError(f"{row.bad} missing or infinite values; impute or exclude them first")
    if row.n < min_rows:
        raise ValueError(f"{row.n} rows; at least {min_rows} are needed")
    return row.n


@dataclass
class Fitted:
    """A model with what its training scores say: range, mean and flag threshold.

    ``training`` is the stored training table with its raw scores, so that a run which
    trains and assesses the same meters does not score them twice.
    """

    model: Model
    low: float
    high: float
    mean: float
    threshold: float
    training: DataFrame

    def scores(self, df: DataFrame, batch: bool = False) -> DataFrame:
        """Adds ``raw_score, score, flag``. The score uses the stored training range, so
        one meter alone gets a meaningful score; ``batch`` takes the range of ``df``."""
        scored = self.model.score(df)
        if batch:
            return flag(batch_normalise(scored), "score", self.scaled_threshold())
        return no_larger(self._scaled(scored), df)

    def training_scores(self) -> DataFrame:
        """``raw_score, score, flag`` beside the training rows."""
        return no_larger(self._scaled(self.training), self.training)

    def _scaled(self, scored: DataFrame) -> DataFrame:
        raw = F.col(RAW)
        if self.high > self.low:
            score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - self.low) / (self.high - self.low)))
        else:
            score = F.lit(0.5)
        return flag(scored.withColumn("score", score), RAW, self.threshold)

    def scaled_threshold(self) -> float:
        return (self.threshold - self.low) / (self.high - self.low) if self.high > self.low else 0.5


def fit(
    detector: Detector,
    df: DataFrame,
    columns: Sequence[str],
    contamination: float = CONTAMINATION,
    threshold: float | None = None,
) -> Fitted:
    """Fit on ``df`` and take the (1 - contamination) quantile of the raw training scores
    as threshold, on the same scale as the scores it is compared with."""
    check_input(df, columns)
    model = detector.fit(df, list(columns))
    training = stored(model.score(df))
    stats = training.agg(F.min(RAW).alias("low"), F.max(RAW).alias("high"), F.avg(RAW).alias("mean")).first()
    if threshold is None:
        threshold = score_threshold(training, contamination).first()[0]
    return Fitted(model, stats.low, stats.high, stats.mean, threshold, training)


def score_threshold(scored: DataFrame, contamination: float = CONTAMINATION, raw: str = RAW) -> DataFrame:
    return group_quantiles(scored, [], raw, {"threshold": 1.0 - contamination})


def batch_normalise(scored: DataFrame, raw: str = RAW, output: str = "score") -> DataFrame:
    """Min-max over the batch; a constant batch is 0.5."""
    stats = scored.agg(F.min(raw).alias("a"), F.max(raw).alias("b"))
    low, high = F.col("_g.a"), F.col("_g.b")
    value = F.when(is_close(high, low), F.lit(0.5)).otherwise((F.col(raw) - low) / (high - low))
    return with_scalars(scored, stats).withColumn(output, value).drop("_g")


def flag(scored: DataFrame, column: str, threshold: float) -> DataFrame:
    return scored.withColumn("flag", (F.col(column) > threshold).cast("int"))


def probabilities(scored: DataFrame, temperature: float = 1.0, raw: str = RAW) -> DataFrame:
    """Sigmoid of the distance from the mean score."""
    stats = scored.agg(F.avg(raw).alias("m"))
    return with_scalars(scored, stats).withColumn(
        "probability", sigmoid((F.col(raw) - F.col("_g.m")) / temperature)
    ).drop("_g")


def most_anomalous(scored: DataFrame, n: int, key: str = "meter_id", raw: str = RAW) -> DataFrame:
    """The ``n`` highest scores beside mean and population std of all scores."""
    stats = scored.agg(F.avg(raw).alias("score_mean"), F.stddev_pop(raw).alias("score_std"))
    top = scored.orderBy(F.desc(raw), key).limit(n)
    return with_scalars(top, stats).select(key, raw, "_g.score_mean", "_g.score_std")


# ---- distance detectors ---------------------------------------------------------


@dataclass
class ZScoreModel:
    """Length of the vector of z-scores: one Column expression, no Python per row."""

    columns: list[str]
    centre: list[float]
    spread: list[float]

    def score(self, df: DataFrame) -> DataFrame:
        z = [(F.col(c) - m) / (s + EPS) for c, m, s in zip(self.columns, self.centre, self.spread)]
        return df.withColumn(RAW, F.sqrt(total([x * x for x in z])))


class ZScoreDetector:
    """z-scores by mean and population std of each column."""

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ZScoreModel:
        d = range(len(columns))
        stats = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return ZScoreModel(list(columns), [stats[f"m{i}"] for i in d], [stats[f"s{i}"] for i in d])


@dataclass
class MahalanobisModel:
    """Mahalanobis distance; the quadratic form is a Column."""

    columns: list[str]
    centre: list[float]
    inverse: list[list[float]]

    def score(self, df: DataFrame) -> DataFrame:
        x = [F.col(c) - m for c, m in zip(self.columns, self.centre)]
        m = self.inverse
        terms = [
            x[i] * x[j] * (m[i][j] if i == j else m[i][j] + m[j][i])
            for i, j in itertools.combinations_with_replacement(range(len(x)), 2)
        ]
        return df.withColumn(RAW, F.sqrt(F.greatest(F.lit(0.0), total(terms))))


@dataclass
class MahalanobisDetector:
    """Mahalanobis distance with a ridge on the sample covariance. Means and covariances
    are one aggregate; d x d numbers are inverted."""

    ridge: float = 1e-6

    def fit(self, df: DataFrame, columns: Sequence[str]) -> MahalanobisModel:
        d = len(columns)
        pairs = list(itertools.combinations_with_replacement(range(d), 2))
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        try:
            inverse = np.linalg.inv(cov + self.ridge * np.eye(d))
        except np.linalg.LinAlgError:
            inverse = np.linalg.inv(cov + 10 * self.ridge * np.eye(d))
        return MahalanobisModel(list(columns), [row[f"m{i}"] for i in range(d)], inverse.tolist())


# ---- user detectors -------------------------------------------------------------


@dataclass
class UserModel:
    """Scores by a user's NumPy function, in Arrow batches on the executors."""

    columns: list[str]
    state: object
    function: Callable[[object, np.ndarray], np.ndarray]

    def score(self, df: DataFrame) -> DataFrame:
        columns, state, function = self.columns, self.state, self.function

        @F.pandas_udf("double")
        def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in frames:
                yield pd.Series(np.asarray(function(state, frame[columns].to_numpy(float)), float))

        # Only the features cross into Python.
        return df.withColumn(RAW, scores(F.struct(*columns)))


@dataclass
class UserDetector:
    """Plug-in: ``learn`` reduces the training table to a small state with DataFrame
    operations, ``score`` applies it to a block of rows."""

    learn: Callable[[DataFrame, list[str]], object]
    function: Callable[[object, np.ndarray], np.ndarray]

    def fit(self, df: DataFrame, columns: Sequence[str]) -> UserModel:
        return UserModel(list(columns), self.learn(df, list(columns)), self.function)


#: Partial states that one task merges.
MERGE_FAN = 16


@dataclass
class BlockDetector:
    """Plug-in that learns by plain NumPy, block by block, at any table size.

    ``start()`` gives an empty state, ``add(state, block)`` takes in a block of rows (rows x
    columns), ``merge(a, b)`` joins two states and ``finish(state)`` turns the last one into
    what ``function(state, block)`` scores with. Every task adds up its own rows; states are
    then merged ``MERGE_FAN`` at a time, level by level on the executors, and only the finished
    one reaches the driver and all tasks: a state has to be small. States meet in the order of
    partitions, so the same partitions give the same model. A task that is repeated starts anew.
    """

    start: Callable[[], object]
    add: Callable[[object, np.ndarray], object]
    merge: Callable[[object, object], object]
    function: Callable[[object, np.ndarray], np.ndarray]
    finish: Callable[[object], object] = lambda state: state

    def fit(self, df: DataFrame, columns: Sequence[str]) -> UserModel:
        columns = list(columns)
        start, add, merge = self.start, self.add, self.merge

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, seen = start(), False
            for batch in batches:
                if len(batch):
                    parts = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
                    state, seen = add(state, np.column_stack(parts)), True
            if seen:
                at = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([cloudpickle.dumps(state)])], names=["at", "state"])

        def join(group: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(table.select(["at", "state"]).to_pylist(), key=lambda r: r["at"])
            state = cloudpickle.loads(rows[0]["state"])
            for row in rows[1:]:
                state = merge(state, cloudpickle.loads(row["state"]))
            return pa.table({"at": [group[0].as_py()], "state": [cloudpickle.dumps(state)]})

        states = stored(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(learn, "at long, state binary"))
        while (row_bound(states) or 0) > 1:
            # Places are dense enough: the highest one falls by the fan at each level.
            states = stored(states.groupBy(F.expr(f"at div {MERGE_FAN}").alias("to")).applyInArrow(join, "at long, state binary"))
        row = states.first()
        state = cloudpickle.loads(row["state"]) if row is not None else start()
        return UserModel(columns, self.finish(state), self.function)


# ---- evaluation -----------------------------------------------------------------


def convergence(scored: DataFrame, raw: str = RAW) -> DataFrame:
    """One row: score mean, variance, share that is not zero, and whether they pass."""
    stats = scored.agg(
        F.avg(raw).alias("score_mean"),
        F.var_pop(raw).alias("score_variance"),
        F.avg((F.abs(F.col(raw)) > EPS).cast("int")).alias("nonzero_share"),
    )
    return stats.withColumn(
        "converged", (F.col("score_variance") > EPS) & (F.col("nonzero_share") > 0.01)
    )


def fold_of(key: str, k: int, seed: int = 42) -> Column:
    """Fold 0..k-1 of a row by the md5 of seed and key: stable under any partitioning and
    the same in other engines. A missing key counts as empty text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int")


def train_validation(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    bucket = fold_of(key, 1000, seed)
    return df.where(bucket >= int(share * 1000)), df.where(bucket < int(share * 1000))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    fold = fold_of(key, k, seed)
    return [(df.where(fold != i), df.where(fold == i)) for i in range(k)]


def risk_separation(scored: DataFrame, q: float = 0.9, raw: str = RAW) -> DataFrame:
    """Mean score at or above the q-quantile minus the mean below it; share above."""
    cut = with_scalars(scored, group_quantiles(scored, [], raw, {"cut": q}))
    above = F.col(raw) >= F.col("_g.cut")
    return cut.agg(
        (F.avg(F.when(above, F.col(raw))) - F.coalesce(F.avg(F.when(~above, F.col(raw))), F.lit(0.0))).alias("separation"),
        F.avg(above.cast("int")).alias("share_above"),
    )


# ---- sweeps ---------------------------------------------------------------------


def grid(space: dict[str, Sequence]) -> list[dict]:
    """Every combination, parameters in the order of their names."""
    names = sorted(space)
    return [dict(zip(names, values)) for values in itertools.product(*[space[n] for n in names])]


def draws(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded random combinations."""
    source = random.Random(seed)
    return [{name: source.choice(list(space[name])) for name in sorted(space)} for _ in range(n)]


def threshold_sweep(scored: DataFrame, contaminations: Sequence[float], raw: str = RAW) -> DataFrame:
    """One row per contamination from a single scoring: threshold, flagged meters, rate,
    mean score of the flagged and the others and their difference, best difference first."""
    names = {f"t{i}": 1.0 - c for i, c in enumerate(contaminations)}
    cut = with_scalars(no_larger(scored.select(raw), scored), group_quantiles(scored, [], raw, names))
    x = F.col(raw)
    measures = []
    for t in names:
        hit = x > F.col(f"_g.{t}")
        measures += [
            F.max(f"_g.{t}").alias(f"{t}_cut"),
            F.count_if(hit).alias(f"{t}_n"),
            F.avg(F.when(hit, x)).alias(f"{t}_hi"),
            F.avg(F.when(~hit, x)).alias(f"{t}_lo"),
        ]
    wide = cut.agg(F.count("*").alias("rows"), *measures)
    entries = [
        F.struct(
            F.lit(float(c)).alias("contamination"),
            F.col(f"t{i}_cut").alias("threshold"),
            F.col(f"t{i}_n").alias("n_flagged"),
            (F.col(f"t{i}_n") / F.col("rows")).alias("flag_rate"),
            (F.col(f"t{i}_hi") - F.col(f"t{i}_lo")).alias("separation"),
        )
        for i, c in enumerate(contaminations)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*").orderBy(
        F.desc("separation"), "contamination"
    )


@dataclass
class Tuning:
    """Result of :func:`tune`: the best parameters and all trials, best first."""

    best: dict
    trials: list[tuple[float, dict]] = field(default_factory=list)

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(i + 1, float(v), str(p)) for i, (v, p) in enumerate(self.trials)]
        return df.sparkSession.createDataFrame(rows, "rank int, metric double, parameters string")


def tune(
    combinations: Sequence[dict],
    evaluate: Callable[[dict], float],
    patience: int | None = None,
) -> Tuning:
    """Evaluate parameter sets (each a distributed fit) and keep the best metric; stop
    after ``patience`` sets without an improvement, if given."""
    trials: list[tuple[float, dict]] = []
    best, stale = float("-inf"), 0
    for parameters in combinations:
        value = evaluate(parameters)
        trials.append((value, parameters))
        stale = 0 if value > best else stale + 1
        best = max(best, value)
        if patience is not None and stale >= patience:
            break
    trials.sort(key=lambda t: -t[0])
    return Tuning(trials[0][1], trials)

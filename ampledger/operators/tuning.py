"""Cross-validated choice of detector options, all trials and folds in one pass.

Rows are dealt into folds by a hash of their key. All forests of a round (trials x folds x
trees) are grown from one sample of the table by one keyed job: a row's place in a tree's
sample is the same hash for every trial and fold, so each fold takes the first rows that are
not its own. One pass scores every row by the forests that have not seen it, and one grouped
aggregation measures all trials and folds. Rounds follow successive halving: every trial with
few trees first, the better half with twice as many.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import total
from ampledger.operators.detectors import CONTAMINATION, EPS, RAW, Fitted, Tuning, check_input, fold_of
from ampledger.operators.forest import (
    HASH_RANGE,
    MIN_OVERSAMPLE_ROWS,
    NODE_SCHEMA,
    OVERSAMPLE,
    IsolationForest,
    arrays,
    average_path,
    depths,
    grow,
)
from ampledger.operators.grouped import attach, group_quantiles
from ampledger.operators.separation import silhouette
from ampledger.session import bounded, row_bound, stored

#: Metric: whether more is better, and the value of a fold in which all rows get one label.
METRICS = {
    "separation": (True, None),
    "silhouette": (True, -1.0),
    "silhouette_sq": (True, -1.0),
    "calinski_harabasz": (True, 0.0),
    "davies_bouldin": (False, float("inf")),
}
#: Nodes of forests that are held by a task at once; more trials are scored in portions.
MAX_NODES = 2_000_000
#: Part of the scores that counts as high for ``separation``.
TOP = 0.1

FOREST_OPTIONS = {"n_trees": 100, "sample_size": 256, "max_features": 1.0, "bootstrap": False}
VERSIONS = (
    "model_id string, model_type string, version int, registered_at timestamp, deployment_stage string, "
    "performance_metrics map<string,double>, tags array<string>, parameters string"
)


@dataclass
class CrossValidation(Tuning):
    """Best options, all trials best first, and the metric of every trial and fold."""

    folds: DataFrame | None = None
    metric: str = "separation"


# ---- metrics of many trials at once ----------------------------------------------


def fold_metrics(scored: DataFrame, columns: Sequence[str], metric: str, contamination: dict[int, float]) -> DataFrame:
    """``trial, fold, value`` of ``scored(trial, fold, raw_score, columns)``.

    A row is flagged if its score exceeds the (1 - contamination) quantile of its trial and
    fold; ``separation`` compares the highest tenth with the rest instead. Quantiles are exact.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    keys = ["trial", "fold"]
    shares = [TOP] if metric == "separation" else sorted(set(contamination.values()))
    names = {f"_q{i}": 1.0 - share for i, share in enumerate(shares)}
    cuts = group_quantiles(scored, keys, RAW, names)
    place = {c: i for i, c in enumerate(shares)}
    chosen = F.col("_q0")
    if metric != "separation":
        for trial, share in contamination.items():
            chosen = F.when(F.col("trial") == trial, F.col(f"_q{place[share]}")).otherwise(chosen)
    rows = attach(scored, cuts.select(*keys, chosen.alias("_cut")), keys)
    raw = F.col(RAW)
    if metric == "separation":
        high = raw >= F.col("_cut")
        value = F.avg(F.when(high, raw)) - F.coalesce(F.avg(F.when(~high, raw)), F.lit(0.0))
        return rows.groupBy(*keys).agg(value.alias("value"))
    rows = rows.withColumn("_k", (raw > F.col("_cut")).cast("int"))
    if metric == "silhouette":
        return _silhouettes(rows, columns)
    x = [F.col(c).cast("double") for c in columns]
    d = range(len(x))
    # Centres of both labels, beside each other; then distances of every row to both.
    parts = [F.avg(F.when(F.col("_k") == k, x[i])).alias(f"_c{k}_{i}") for k in (0, 1) for i in d]
    counts = [F.count_if(F.col("_k") == k).cast("double").alias(f"_n{k}") for k in (0, 1)]
    centres = rows.groupBy(*keys).agg(*parts, *counts)
    placed = attach(rows, centres, keys)
    to = [total([(x[i] - F.col(f"_c{k}_{i}")) * (x[i] - F.col(f"_c{k}_{i}")) for i in d]) for k in (0, 1)]
    placed = placed.select(*keys, "_k", "_n0", "_n1", *[t.alias(f"_d{k}") for k, t in enumerate(to)])
    own = F.when(F.col("_k") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    worst = F.lit(METRICS[metric][1])
    both = (F.col("_n0") > 0) & (F.col("_n1") > 0)
    if metric == "silhouette_sq":
        q = placed.groupBy(*keys).agg(*[F.avg(F.when(F.col("_k") == k, F.col(f"_d{k}"))).alias(f"_q{k}") for k in (0, 1)])
        far = attach(placed, q, keys)
        mean = [F.col(f"_d{k}") + F.col(f"_q{k}") for k in (0, 1)]
        first = F.col("_k") == 0
        n = F.when(first, F.col("_n0")).otherwise(F.col("_n1"))
        a = F.when(first, mean[0]).otherwise(mean[1]) * n / F.greatest(n - 1, F.lit(1.0))
        b = F.when(first, mean[1]).otherwise(mean[0])
        each = F.when((n > 1) & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)
        return far.groupBy(*keys).agg(F.when(F.min(both), F.avg(each)).otherwise(worst).alias("value"))
    spreads = [F.avg(F.when(F.col("_k") == k, F.sqrt(own))).alias(f"_s{k}") for k in (0, 1)]
    sums = placed.groupBy(*keys).agg(F.sum(own).alias("_within"), *spreads, F.max("_n0").alias("n0"), F.max("_n1").alias("n1"))
    gap = total([(F.col(f"_c0_{i}") - F.col(f"_c1_{i}")) * (F.col(f"_c0_{i}") - F.col(f"_c1_{i}")) for i in d])
    joined = sums.join(centres.select(*keys, gap.alias("_gap")), keys)
    n = F.col("n0") + F.col("n1")
    if metric == "davies_bouldin":
        value = F.when(F.col("_gap") > 0, (F.col("_s0") + F.col("_s1")) / F.sqrt("_gap")).otherwise(F.lit(0.0))
    else:
        between = F.col("n0") * F.col("n1") / n * F.col("_gap")
        inner = (F.col("_within") > 0) & (n > 2)
        value = F.when(inner, between / (F.col("_within") / F.greatest(n - 2, F.lit(1.0)))).otherwise(F.lit(1.0))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    return joined.select(*keys, F.when(both, value).otherwise(worst).alias("value"))


def _silhouettes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The silhouette by Euclidean distances, one walk for each trial and fold."""
    rows = stored(rows.select("trial", "fold", "_k", *columns))
    groups = rows.select("trial", "fold").distinct().collect()  # trials x folds
    values = []
    for trial, fold in groups:
        part = rows.where((F.col("trial") == trial) & (F.col("fold") == fold))
        values.append((trial, fold, float(silhouette(part, "_k", columns).first()[0])))
    return rows.sparkSession.createDataFrame(values, "trial int, fold int, value double")


def _ranked(found: DataFrame, trials: dict[int, dict], metric: str) -> list[tuple[float, int]]:
    """``(mean over folds, trial)``, best first; ties keep the order of trials."""
    rows = found.groupBy("trial").agg(F.avg("value").alias("value")).collect()  # one per trial
    more = METRICS[metric][0]
    return sorted(((r.value, r.trial) for r in rows), key=lambda v: (-v[0] if more else v[0], v[1]))


# ---- isolation forests -----------------------------------------------------------


def _forests(df: DataFrame, columns: list[str], key: str, variants: list[tuple], trees: list[int], folds: int, seed: int) -> DataFrame:
    """Nodes ``variant, fold, tree, ...`` of all forests. ``df`` has a column ``fold``."""
    n = row_bound(df)
    largest = min(max(v[0] for v in variants), n)
    most = max(trees)
    every = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"), F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(HASH_RANGE)).alias("_h")),
    )
    wanted = OVERSAMPLE * largest * folds / (folds - 1) + MIN_OVERSAMPLE_ROWS
    bound = int(min(1.0, wanted / max(n, 1)) * HASH_RANGE)
    picked = df.withColumn("_p", F.explode(F.filter(every, lambda p: p["_h"] < bound))).select("*", "_p.*").drop("_p")
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    picked = picked.withColumn("_for", F.explode(others)).drop("fold").withColumnRenamed("_for", "fold")
    order = Window.partitionBy("fold", "tree").orderBy("_h", key)
    picked = picked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= largest)
    wide = [F.struct(F.lit(i).alias("variant"), F.lit(int(v[0])).alias("size"), F.lit(int(t)).alias("trees")) for i, (v, t) in enumerate(zip(variants, trees))]
    rows = picked.withColumn("_v", F.explode(F.array(*wide))).select("*", "_v.*").drop("_v")
    rows = rows.where((F.col("_rn") <= F.col("size")) & (F.col("tree") < F.col("trees")))
    tasks = max(1, min(most * folds * len(variants), df.sparkSession.sparkContext.defaultParallelism))
    rows = rows.select("variant", "fold", "tree", "_rn", *columns).repartition(tasks, "variant", "fold", "tree")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        variant, fold, tree = (int(frame[c].iloc[0]) for c in ("variant", "fold", "tree"))
        size, share, bootstrap = variants[variant]
        rng = np.random.default_rng([seed, tree, fold, size])
        x = frame.sort_values("_rn")[columns].to_numpy(float)
        limit = max(1, math.ceil(math.log2(max(len(x), 2))))
        if bootstrap:
            x = x[rng.integers(0, len(x), len(x))]
        used = rng.permutation(len(columns))[: max(1, round(share * len(columns)))]
        out = pd.DataFrame(grow(x, np.sort(used), limit, rng), columns=["node", "feature", "cut", "left", "right", "depth"])
        for place, (name, value) in enumerate((("variant", variant), ("fold", fold), ("size", len(x)), ("tree", tree))):
            out.insert(place, name, value)
        return out

    return rows.groupBy("variant", "fold", "tree").applyInPandas(build, f"variant int, fold int, size int, {NODE_SCHEMA}")


def _scored(df: DataFrame, columns: list[str], nodes: pd.DataFrame, trials: dict[int, tuple[int, int]]) -> DataFrame:
    """``trial, fold, raw_score, columns``: each row by the forests of its own fold, which are
    grown without it. ``trials``: number to (variant, number of trees)."""
    forests: dict[tuple[int, int], tuple[float, list]] = {}
    for (variant, fold), part in nodes.sort_values(["variant", "fold", "tree", "node"]).groupby(["variant", "fold"]):
        grown = [arrays(g) for _, g in part.groupby("tree")]
        forests[int(variant), int(fold)] = (float(average_path(part["size"].iloc[0])), grown)
    shared = df.sparkSession.sparkContext.broadcast(forests)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            own = batch.column("fold").to_numpy()
            raw = np.full((len(x), len(trials)), np.nan)
            for fold in np.unique(own).tolist():
                rows = np.flatnonzero(own == fold)
                for variant in {v for v, _ in trials.values()}:
                    norm, grown = shared.value[variant, fold]
                    paths = np.cumsum([depths(x[rows], tree) for tree in grown], axis=0)
                    for place, (v, n) in enumerate(trials.values()):
                        if v == variant:
                            mean = paths[min(n, len(grown)) - 1] / min(n, len(grown))
                            raw[rows, place] = (np.exp2(-mean / norm) if norm else 0.5) - 0.5
            for place, trial in enumerate(trials):
                columns_ = [pa.array(np.full(len(x), trial, np.int32)), batch.column("fold"), pa.array(raw[:, place])]
                yield pa.RecordBatch.from_arrays(
                    columns_ + [pa.array(x[:, i]) for i in range(len(columns))], names=["trial", "fold", RAW, *columns]
                )

    schema = f"trial int, fold int, {RAW} double, " + ", ".join(f"`{c}` double" for c in columns)
    return df.select("fold", *columns).mapInArrow(score, schema)


def tune_forest(
    df: DataFrame,
    columns: Sequence[str],
    combinations: Sequence[dict],
    folds: int = 3,
    metric: str = "separation",
    rounds: int = 2,
    key: str = "meter_id",
    seed: int = 42,
) -> CrossValidation:
    """Isolation forest options (``n_trees, sample_size, max_features, bootstrap,
    contamination``) by the mean of a metric over folds.

    ``rounds`` of halving: the first grows 1 / 2^(rounds - 1) of each trial's trees, every next
    one twice as many for the better half; the last decides. Trials that left earlier follow in
    the order of the round they left in.
    """
    columns = list(columns)
    if folds < 2:
        raise ValueError("at least two folds")
    unknown = {k for c in combinations for k in c} - {*FOREST_OPTIONS, "contamination"}
    if unknown or not combinations:
        raise ValueError(f"no combinations, or unknown options {sorted(unknown)}")
    n = check_input(df, columns, min_rows=2 * folds)
    dealt = stored(df.select(key, *columns, fold_of(key, folds, seed).alias("fold")))
    dealt = bounded(dealt, n)
    options = {i: FOREST_OPTIONS | {"contamination": CONTAMINATION} | c for i, c in enumerate(combinations)}
    contamination = {i: o["contamination"] for i, o in options.items()}
    alive, left, last = list(options), [], None
    for turn in range(rounds):
        share = 2 ** (rounds - 1 - turn)
        found = None
        for portion in _portions(alive, options, folds, share):
            variants = sorted({_variant(options[i]) for i in portion})
            trees = [max(-(-options[i]["n_trees"] // share) for i in portion if _variant(options[i]) == v) for v in variants]
            nodes = _forests(dealt, columns, key, variants, trees, folds, seed).toPandas()  # at most MAX_NODES rows
            trials = {i: (variants.index(_variant(options[i])), -(-options[i]["n_trees"] // share)) for i in portion}
            scored = stored(_scored(dealt, columns, nodes, trials))
            measured = stored(fold_metrics(scored, columns, metric, contamination))
            found = measured if found is None else found.unionByName(measured)
        order = _ranked(found, options, metric)
        keep = len(order) if turn == rounds - 1 else max(1, -(-len(order) // 2))
        left = order[keep:] + left
        alive, last = [t for _, t in order[:keep]], found
    order = [v for v in order if v[1] in alive] + left
    given = list(combinations)
    trials = [(value, dict(given[t])) for value, t in order]
    return CrossValidation(trials[0][1], trials, last, metric)


def _variant(options: dict) -> tuple:
    return (options["sample_size"], options["max_features"], options["bootstrap"])


def _portions(alive: list[int], options: dict[int, dict], folds: int, share: int) -> list[list[int]]:
    """Trials whose forests fit into a task together; trials of one variant share trees."""
    out, held = [], {}
    for i in sorted(alive, key=lambda i: _variant(options[i])):
        v, nodes = _variant(options[i]), 2 * options[i]["sample_size"] * folds * -(-options[i]["n_trees"] // share)
        more = {**held, v: max(held.get(v, 0), nodes)}
        if out and sum(more.values()) <= MAX_NODES:
            out[-1].append(i)
            held = more
        else:
            out.append([i])
            held = {v: nodes}
    return out


# ---- distance detectors ----------------------------------------------------------


def tune_zscore(
    df: DataFrame,
    columns: Sequence[str],
    contaminations: Sequence[float],
    folds: int = 3,
    metric: str = "calinski_harabasz",
    key: str = "meter_id",
    seed: int = 42,
) -> CrossValidation:
    """The contamination of a z-score detector: fitted without each fold, measured on it."""
    columns = list(columns)
    check_input(df, columns, min_rows=2 * folds)
    dealt = stored(df.select(*columns, fold_of(key, folds, seed).alias("fold")))
    training = dealt.withColumn("_for", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))))
    stats = training.groupBy(F.col("_for").cast("int").alias("fold")).agg(
        *[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    placed = attach(dealt, bounded(stats, folds), ["fold"])
    z = [(F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + EPS) for i, c in enumerate(columns)]
    raw = placed.select("fold", *columns, F.sqrt(total([v * v for v in z])).alias(RAW))
    numbers = F.array(*[F.lit(i) for i in range(len(contaminations))])
    scored = stored(raw.withColumn("trial", F.explode(numbers)))
    found = stored(fold_metrics(scored, columns, metric, dict(enumerate(contaminations))))
    order = _ranked(found, {}, metric)
    trials = [(value, {"contamination": contaminations[t]}) for value, t in order]
    return CrossValidation(trials[0][1], trials, found, metric)


# ---- registration ----------------------------------------------------------------


def register(tuned: CrossValidation, fitted: Fitted, folder: str, model_type: str, baselines: DataFrame, stage: str = "staging") -> str:
    """Store the model fitted with the best options and append its version; its id.

    The model is written first, so a version that can be read has its model. The number is one
    more than the highest of its type.
    """
    from ampledger.sources.models import save_fitted

    spark = baselines.sparkSession
    model_id = f"{model_type}-{uuid.uuid4().hex}"
    save_fitted(fitted, baselines, f"{folder}/models/{model_id}")
    known = versions(spark, folder).where(F.col("model_type") == model_type).agg(F.max("version")).first()[0]
    row = spark.range(1).select(
        F.lit(model_id).alias("model_id"),
        F.lit(model_type).alias("model_type"),
        F.lit((known or 0) + 1).alias("version"),
        F.current_timestamp().alias("registered_at"),
        F.lit(stage).alias("deployment_stage"),
        F.create_map(F.lit(f"{tuned.metric}_score"), F.lit(float(tuned.trials[0][0]))).alias("performance_metrics"),
        F.array(F.lit("tuned"), F.lit(tuned.metric)).alias("tags"),
        F.lit(json.dumps(tuned.best, sort_keys=True)).alias("parameters"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return model_id


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions in a folder; none in a new one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(VERSIONS).parquet(f"{folder}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def best_forest(tuned: CrossValidation, df: DataFrame, columns: Sequence[str]) -> Fitted:
    """The best options, fitted on the whole table."""
    from ampledger.operators.detectors import fit

    options = {k: v for k, v in tuned.best.items() if k != "contamination"}
    return fit(IsolationForest(**options), df, columns, tuned.best.get("contamination", CONTAMINATION))

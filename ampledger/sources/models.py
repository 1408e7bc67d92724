"""Fitted detectors as parquet tables: parameters, trees and the transformers' baselines."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ampledger.operators.detectors import Fitted, MahalanobisModel, ZScoreModel
from ampledger.operators.forest import NODE_SCHEMA, ForestModel

KINDS = {"zscore": ZScoreModel, "mahalanobis": MahalanobisModel, "forest": ForestModel}
PARAMETERS = "kind string, state string, low double, high double, mean double, threshold double"


def save_fitted(fitted: Fitted, baselines: DataFrame, folder: str) -> None:
    """Write ``parameters`` (one row), ``baselines`` and, of a forest, ``nodes``."""
    spark, model = baselines.sparkSession, fitted.model
    kind = next((name for name, cls in KINDS.items() if type(model) is cls), None)
    if kind is None:
        raise ValueError(f"a {type(model).__name__} can not be stored; store its state yourself")
    nodes = model.nodes if kind == "forest" else None
    state = {k: v for k, v in vars(model).items() if k != "nodes"} if kind == "forest" else asdict(model)
    row = (kind, json.dumps(state), fitted.low, fitted.high, fitted.mean, fitted.threshold)
    spark.createDataFrame([row], PARAMETERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parameters")
    if nodes is not None:
        spark.createDataFrame(nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{folder}/nodes")
    baselines.write.mode("overwrite").parquet(f"{folder}/baselines")


def load_fitted(spark: SparkSession, folder: str) -> tuple[Fitted, DataFrame]:
    """The detector and the baselines; a loaded detector has no training table."""
    row = spark.read.parquet(f"{folder}/parameters").first()
    state = json.loads(row.state)
    if row.kind == "forest":
        state["nodes"] = spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes").toPandas()  # trees x 2 x sample rows
    fitted = Fitted(KINDS[row.kind](**state), row.low, row.high, row.mean, row.threshold, None)
    return fitted, spark.read.parquet(f"{folder}/baselines")

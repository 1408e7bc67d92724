"""Quality scores from two compression dictionaries, one of good and one of bad texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.llm.common import pieces, remainder_of_id, scratch, unused, worker_cache

#: Texts are compressed in independent pieces of this size: a dictionary helps most at the
#: start of a frame, and so every part of a long text counts alike.
PIECE = 1024
LEVEL = 3
#: Bytes that count as much as the share of good texts: a text of this length is judged half
#: by its compression, an empty one by the share alone.
SMOOTH = 64
SEED = 7
#: Bytes of pieces from which one task trains a dictionary.
GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float


def _compressors(good: bytes, bad: bytes):
    import zstandard

    held = worker_cache("zstd_pairs")
    key = (hash(good), hash(bad))
    if key not in held:
        made = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False
                )
            )
        held.clear()
        held[key] = made
    return held[key]


def evidence(text: bytes, good, bad) -> tuple[float, float]:
    """The whole text's normalised difference and weight; both are 0 for an empty text.

    The difference says how much smaller the text gets with the good dictionary than with
    the bad one, relative to its length; the weight grows with the length from 0 to 1.
    """
    with_good = with_bad = 0
    for i in range(0, len(text), PIECE):
        part = text[i : i + PIECE]
        with_good += len(good.compress(part))
        with_bad += len(bad.compress(part))
    return (with_bad - with_good) / (len(text) + SMOOTH), len(text) / (len(text) + SMOOTH)


def _cut(rows: DataFrame) -> DataFrame:
    """``label, seed, i, piece``: all pieces of the texts of ``rows(label, seed, text)``."""

    def cut(batches):
        for batch in pieces(batches, "text"):
            out: tuple[list, list, list, list] = [], [], [], []
            for label, seed, text in zip(*(batch.column(c).to_pylist() for c in ("label", "seed", "text"))):
                for i in range(0, len(text), PIECE):
                    for column, value in zip(out, (label, seed, i, text[i : i + PIECE])):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["label", "seed", "i", "piece"])

    return rows.select("label", "seed", F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "label int, seed long, i long, piece binary"
    )


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples to train on are used as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\n" * 8


def _dictionaries(rows: DataFrame, size: int) -> dict[int, bytes]:
    """A dictionary for each label from all pieces of ``rows(label, seed, text)``.

    Tasks train on groups of about ``GROUP_BYTES``; if a label has several, the pieces of
    their dictionaries are the samples of the next level, until one is left.
    """

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seed", "ascending"), ("i", "ascending")])
        made = _dictionary(table.column("piece").to_pylist(), size)
        columns = {"label": table.column("label")[:1], "seed": table.column("_part")[:1], "text": pa.array([made], pa.binary())}
        return pa.table(columns)

    while True:
        held = {r.label: r.bytes for r in rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
        groups = {label: max(1, -(-n // GROUP_BYTES)) for label, n in held.items()}
        parts = F.coalesce(*[F.when(F.col("label") == k, F.lit(n)) for k, n in groups.items()], F.lit(1))
        dealt = _cut(rows).withColumn("_part", F.pmod(F.xxhash64("seed", "i"), parts))
        trained = dealt.groupBy("label", "_part").applyInArrow(train, "label int, seed long, text binary")
        if all(n == 1 for n in groups.values()):
            return {r.label: bytes(r.text) for r in trained.collect()}
        rows = scratch(trained, "quality-dictionaries")


def _measured(df: DataFrame, text_col: str, good: bytes, bad: bytes, out: str) -> DataFrame:
    """``df`` with the text's evidence as struct column ``out(x, w)``."""
    kind = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("w", T.DoubleType())])
    schema = T.StructType(df.schema.fields + [T.StructField(out, kind)])

    def run(batches):
        pair = _compressors(good, bad)
        for batch in pieces(batches, text_col):
            found = np.array([evidence(t.encode(), *pair) for t in batch.column(text_col).to_pylist()]).reshape(-1, 2)
            struct = pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "w"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _logistic(design: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float) -> np.ndarray:
    """Coefficients of a weighted logistic curve with a fixed offset, by Newton's method
    with a small penalty."""
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta + offset, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - 1e-4 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    max_rows: int = 3000,
    dictionary_bytes: int = 112 << 10,
) -> Model:
    """Train on the documents that ``labels(id, label)`` marks with 0 or 1.

    A sample of at most ``max_rows`` labels of each kind, the smallest seeded hashes of the
    id, bounds what is read into the model: the sampled ids are broadcast to the documents,
    the whole texts of two thirds of them build the dictionaries, and the whole texts of the
    others fit the calibration curve. Null ids and labels are left out,
    a document with several labels counts for each. Without documents of both labels every
    score is the smoothed share of label 1 (one half if there are no labels).
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(
        "_id is not null and label in (0, 1)"
    )
    hashed = usable.withColumn("_h", F.xxhash64(F.lit(SEED), "_id"))
    chosen = [hashed.where(F.col("label") == k).orderBy("_h").limit(max_rows) for k in (0, 1)]
    ids = chosen[0].unionAll(chosen[1])
    texts = documents.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = scratch(
        texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select(
            "text", "label", F.xxhash64("_h", "text").alias("seed"), F.pmod(F.xxhash64("_h"), F.lit(3)).alias("_part")
        ),
        "quality-sample",
    )
    trained = _dictionaries(held.where("_part < 2").select("label", "seed", "text"), dictionary_bytes)
    good, bad = (trained.get(label) or _dictionary([], dictionary_bytes) for label in (1, 0))
    rest = held.where("_part = 2").select(F.col("text").alias("_text"), "label")
    points = _measured(rest, "_text", good, bad, "_e").select("_e.x", "_e.w", "label").collect()
    x = np.array([(p.x, p.w) for p in points], float).reshape(-1, 2)
    y = np.array([p.label for p in points], float)
    all_rows = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    share = (all_rows.get(1, 0) + 1) / (sum(all_rows.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(good, bad, 0.0, 0.0, prior)
    # Both labels are sampled alike; weights give each its share of all labelled rows.
    n = len(y)
    weight = np.where(y == 1, all_rows[1] / y.sum(), all_rows[0] / (n - y.sum()))
    slope, shift = _logistic(x, y, weight * n / weight.sum(), prior)
    return Model(good, bad, float(slope), float(shift), prior)


def score_column(found: Column, model: Model) -> Column:
    logit = F.lit(model.slope) * found["x"] + F.lit(model.shift) * found["w"] + F.lit(model.prior)
    return 1 / (1 + F.exp(-logit))


def scored(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 as ``score_col``, which must not exist yet.

    Whole texts are compressed. A null or empty text gets the share of label 1 among the
    labelled rows. All rows and all other columns are kept.
    """
    if score_col in df.columns:
        raise ValueError(f"column {score_col} exists")
    found, text = unused(df, "_evidence"), unused(df, "_text")
    rows = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = _measured(rows, text, model.good, model.bad, found)
    return out.withColumn(score_col, score_column(F.col(found), model)).drop(found, text)


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Labels of documents that are not held out: crc32 of the id modulo 5 is not 0."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    return rows.where(remainder_of_id("doc_id", 5) != 0)


def quality(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    rows = documents.select(F.col("doc_id"), F.col("text"))
    return scored(rows, model).select(
        "doc_id",
        (remainder_of_id("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

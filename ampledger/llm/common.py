"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.session import checkpoint_root

#: Rows handed to Python code that works on text are cut into pieces of about this size.
BATCH_BYTES = 8 << 20
#: Bytes of rows from which Spark closes a batch for a Python worker. Batches lie in the executor's
#: memory outside the heap, with buffers of up to twice their size, and in the worker's.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about ``ARROW_BYTES``, not only of
    so many rows: results are the same, what a batch takes does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, a null text read as empty: other columns can not clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder_of_id(id_col: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; one long text may exceed it."""
    for batch in batches:
        texts = batch.column(text_col)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist() if len(texts) else []
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker: loaded models, encoded words."""
    caches = sys.__dict__.setdefault("_ampledger_llm", {})
    return caches.setdefault(name, {})


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

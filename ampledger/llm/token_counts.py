"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces, worker_cache

CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: its library, that library's version and the digest of its
    file. Executors must have the same library as the driver."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as file:
        return f"{library}-{version(library)}-{hashlib.sha256(file.read()).hexdigest()}"


def _counter(path: str):
    """A function from texts to token counts, loaded once per Python worker."""
    held = worker_cache("token_counter")
    if path not in held:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            held[path] = lambda texts: [
                len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            held[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    return held[path]


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that was never written is empty."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer_digest") == tokenizer)


def fill_cache(documents: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode the distinct texts of ``documents(doc_id, text)`` that ``cache`` lacks and
    append their counts."""
    digest_of_tokenizer = tokenizer_digest(tokenizer)
    stored = read_cache(documents.sparkSession, cache, digest_of_tokenizer).select("text_digest").distinct()
    missing = (
        documents.select(F.unhex(F.sha2("text", 256)).alias("text_digest"), "text")
        .join(stored, "text_digest", "left_anti")
        .groupBy("text_digest")
        .agg(F.first("text").alias("text"))
    )

    def encode(batches):
        count = _counter(tokenizer)
        for batch in pieces(batches, "text", 1 << 20):
            n = count(batch.column("text").to_pylist())
            digest = batch.column("text_digest")
            yield pa.RecordBatch.from_arrays(
                [digest, pa.array([digest_of_tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["text_digest", "tokenizer_digest", "n_tokens"],
            )

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(
    df: DataFrame, cache: str, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``cache`` is a parquet folder that all executors share; ``tokenizer`` a ``.json`` file
    (tokenizers) or a ``.model`` file (sentencepiece). Equal texts, in this table or in
    earlier calls, are encoded once per tokenizer version. Two calls that fill one cache at
    the same time may both append a text; the smaller of equal counts is read, so the result
    does not change. A null text is the empty text, null and repeated ids are kept as rows,
    an empty table gives no rows.
    """
    documents = documents_of(df, id_col, text_col)
    fill_cache(documents, cache, tokenizer)
    counts = (
        read_cache(df.sparkSession, cache, tokenizer_digest(tokenizer))
        .groupBy("text_digest")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
    rows = documents.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("text_digest")
    )
    return rows.join(counts, "text_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""From raw documents to packed training sequences, in five stages.

Every stage takes all documents that the one before it kept and returns them with the
columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm import exact_dedup, mixing, near_dedup, packing, quality
from ampledger.llm.common import bound_batches, scratch, table, unused
from ampledger.llm.queries import mix_plan

#: The SQL of another engine can not express compression, sketches or tokenizers.
ORACLE_SQL = None


def _with_keys(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are among ``chosen(doc_id, text_sha256)``; a null id
    equals a null id, a null text an empty one."""
    wanted = chosen.select(F.col("doc_id").alias("_wanted"), F.col("text_sha256").alias("_digest"))
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    same = docs["doc_id"].eqNullSafe(wanted["_wanted"]) & (digest == wanted["_digest"])
    return docs.join(wanted, same, "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3. Null, empty and very short texts get
    about the share of good labels and stay if that is enough; every repeated row is judged
    alike, an empty table stays empty, further columns are kept."""
    bound_batches(spark)
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    score = unused(docs, "_score")
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= 0.3).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; a null text becomes the empty text, a null
    id is the smallest. An empty table stays empty, further columns are kept."""
    bound_batches(spark)
    return exact_dedup.text_owners(docs, keep="largest").select("owner.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id, a null id last; of
    texts that share this id only one. Texts without words are alike only if equal. Rows equal in
    id and text stay or go together (the stage before leaves none). An empty table stays
    empty, further columns are kept."""
    bound_batches(spark)
    return _with_keys(docs, near_dedup.near_duplicates(docs, threshold=0.8, with_digest=True).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the target weights; documents are not repeated, and the
    document in which a budget ends stays whole. Null and empty levels are one value; texts that
    share an id are chosen one by one. An empty table stays empty, further columns are kept."""
    return _with_keys(docs, mixing.mixture(docs, mix_plan(share=0.8, epochs=1), with_digest=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens. A null or empty
    text is one piece of one token; repeated rows are packed each, an empty table gives none."""
    bound_batches(spark)
    return packing.pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm import embeddings, exact_dedup, language, language_model, lexical, licenses, mixing, near_dedup, packing, periodic, personal, quality, token_counts
from ampledger.llm.common import table
from ampledger.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{checkpoint_root(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), cache, public_tokenizers.path("piece_bpe_32k.model")
    )


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.quality(documents, model)


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(language.training_rows(documents)))


#: Which sources belong to which domain, in SQL that both engines read.
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source LIKE '%1' OR source LIKE '%3' THEN 'books' ELSE 'forum' END"
#: Half of the tokens are to come from books, which are too few, so that the others fill up.
MIX_WEIGHTS = {
    "domain": {"crawl": 0.2, "books": 0.5, "forum": 0.3},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
}
MIX_SQL = {"domain": DOMAIN, "lang": "lang", "source": "source"}


def mix_plan(share: float, epochs: int) -> mixing.Plan:
    return mixing.Plan(
        levels={name: F.expr(sql) for name, sql in MIX_SQL.items()},
        weights=MIX_WEIGHTS,
        share=share,
        epochs=epochs,
        seed=11,
    )


def mix_sql(share: float, epochs: int, documents: str = "documents") -> str:
    plan = mixing.Plan(levels=dict.fromkeys(MIX_SQL), weights=MIX_WEIGHTS, share=share, epochs=epochs, seed=11)
    return mixing.oracle(MIX_SQL, plan, documents)


@query("op1_mixing", mix_sql(0.8, 2))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), mix_plan(0.8, 2))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_language_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.periodic_runs(table(spark, sf_dir, "documents"), arrange=periodic.planted_order)
    return periodic.summary(runs)


#: Terms of a text in DuckDB: A-Z lower-cased, then runs of letters, digits and non-ASCII characters.
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_ranked_search",
    f"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents WHERE text IS NOT NULL
    ), c AS (SELECT count(*) AS n_all, sum(len(terms))::BIGINT AS l_all FROM d WHERE len(terms) > 0),
    tf AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
    ), w AS (
        SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, c GROUP BY term, n_all
    ), i AS (
        SELECT k, item_id, term, count(*) AS q
        FROM (SELECT k, item_id, unnest(terms) AS term
              FROM (SELECT row_number() OVER () AS k, item_id, {TERMS} AS terms
                    FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL))
        GROUP BY k, item_id, term
    ), s AS (
        SELECT k, item_id, d.r, doc_id,
               sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * len(terms) * n_all) // l_all)))))::BIGINT AS score
        FROM i JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.r = tf.r, c
        GROUP BY k, item_id, d.r, doc_id
    )
    SELECT item_id, (row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.summary(personal.personal_data(table(spark, sf_dir, "documents")))

"""Budgets along the tree, token prefixes, SQL of the corpus queries, the pipeline."""

import random
from collections import Counter

import pytest
from conftest import words
from oracle import compare, connect
from pyspark.sql import functions as F

from ampledger.llm import mixing, queries


class Entry:
    def __init__(self, name):
        self.build, self.sql = queries.QUERIES[name], queries.SQL.get(name)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert compare(spark, connect(folder), Entry(name), folder) == ""


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, tokens long")


def plan(weights, **options):
    return mixing.Plan({"domain": F.col("domain"), "lang": F.col("lang")}, weights, **options)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 100), ("b", "x", 100), ("b", "y", 100)]
    got = mixing.leaf_budgets(leaves(spark, rows), plan({}, tokens=120)).collect()
    # a and b get 60 each; x of a has 10 only, so that y of a gets 50 and b is untouched.
    assert {(r.domain, r.lang): r.budget for r in got} == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 30, ("b", "y"): 30}
    rows = [("a", "x", 10), ("a", "y", 20), ("b", "x", 100), ("b", "y", 100)]
    got = mixing.leaf_budgets(leaves(spark, rows), plan({}, tokens=120)).collect()
    # All of a is 30, the other 30 go to b.
    assert {(r.domain, r.lang): r.budget for r in got} == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 45, ("b", "y"): 45}


def test_weights_epochs_and_zero_weight(spark):
    rows = [("a", "x", 10), ("a", "y", 100), ("b", "x", 100)]
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"y": 0}}
    got = mixing.leaf_budgets(leaves(spark, rows), plan(weights, tokens=100, epochs=4)).collect()
    assert {(r.domain, r.lang): r.budget for r in got} == {("a", "x"): 40, ("b", "x"): 60}
    full = mixing.leaf_budgets(leaves(spark, rows), plan({}, share=9.0)).collect()
    assert [r.budget == r.tokens for r in full] == [True] * 3
    assert mixing.leaf_budgets(leaves(spark, rows).where("false"), plan({})).count() == 0


def test_prefix_takes_the_budget_exactly(spark, make, monkeypatch):
    texts = [" ".join(["w"] * (i % 9)) for i in range(400)]
    df = make(texts, clash=True)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    results = []
    for size in (7, 100_000):
        monkeypatch.setattr(mixing, "RANGE_ROWS", size)
        got = mixing.mixture(df, mixing.Plan(levels, tokens=2345, epochs=2)).collect()
        results.append(sorted((r.doc_id, r.epoch, r.taken) for r in got))
        assert sum(r.taken for r in got) == 2345
        assert sum(r.taken < r.n_tokens for r in got) <= 1
    assert results[0] == results[1]
    assert max(Counter(d for d, _, _ in results[0]).values()) == 2


def test_mixture_of_odd_rows(odd, nothing):
    levels = {"lang": F.col("lang"), "source": F.lit(None)}
    got = mixing.mixture(odd, mixing.Plan(levels, share=1.0)).collect()
    assert len(got) == odd.count() and {r.source for r in got} == {""}
    assert mixing.mixture(nothing, mixing.Plan(levels)).count() == 0
    assert mixing.mixture(odd.where("text IS NULL"), mixing.Plan(levels)).count() == 0


def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline as pipeline

    from ampledger.llm.common import scratch, table

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    names, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        after = scratch(stage(spark, docs, folder), name)
        assert after.columns == names and after.dtypes == docs.dtypes
        assert after.exceptAll(docs).count() == 0  # rows of the input, unchanged
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 300
    assert docs.count() == docs.select("text").distinct().count()
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert pipeline.run(spark, folder).count() == packed.count()


def test_pipeline_of_odd_rows(spark, odd, nothing):
    import corpus_pipeline as pipeline

    from ampledger.llm.common import scratch

    for start in (odd, nothing):
        docs = start
        for name, stage in pipeline.STAGES:
            docs = scratch(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert "sequence_id" in docs.columns
        assert docs.count() > 0 or start is nothing


def test_pipeline_decides_by_id_and_text(spark, make):
    """Rows that share an id, or have none, are kept and dropped one by one."""
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    base = words(rng, 80)
    rows = [(7, " ".join(base)), (7, " ".join([*base[:-1], "end"])), (None, " ".join(["start", *base[1:]]))]
    rows += [(i % 3 or None, " ".join(words(rng, 40, 10**6))) for i in range(60)]
    docs = make(rows, clash=True)
    near = pipeline.near_copies(spark, docs, "")
    assert near.columns == docs.columns and near.count() == 61
    assert near.where("doc_id = 7").count() == 1
    mixed = pipeline.mix_sources(spark, near, "")
    chosen = mixing.mixture(near, queries.mix_plan(share=0.8, epochs=1))
    assert mixed.columns == docs.columns and mixed.count() == chosen.count() < 61


@pytest.mark.parametrize("stage", ["quality_classifier", "exact_dedup", "near_dedup", "packing"])
def test_batches_of_stages_are_bounded(spark, nothing, stage):
    """Long texts reach Python in batches of some MB, whatever their number of rows."""
    import pyarrow as pa

    import corpus_pipeline as pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], names=["n", "bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(pipeline.STAGES)[stage](spark, nothing, "/root/testdata/sf0.001")
    rows = spark.range(0, 6000, 1, 1).select(F.expr("repeat(concat(id, ' word '), 400)").alias("text"))
    got = rows.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).first()
    assert got.n == 6000 and got.bytes < 5 << 20


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before kept, against plain Python and DuckDB."""
    import duckdb
    import public_tokenizers
    from test_exact_and_counts import check_sequences
    from test_similarity import exact_classes
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline
    from ampledger.llm.common import scratch, table

    folder = "/root/testdata/sf0.001"
    kept = [table(spark, folder, "documents")]
    for name, stage in pipeline.STAGES:
        kept.append(scratch(stage(spark, kept[-1], folder), f"brute-{name}"))
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    good = {r.doc_id for r in queries.QUERIES["op7_quality"](spark, folder).where("predicted = 1").collect()}
    assert ids[1] == good
    largest = {}
    for r in kept[1].collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert ids[2] == set(largest.values())
    rows = sorted((r.doc_id, r.text) for r in kept[2].collect())
    classes = exact_classes([t for _, t in rows])
    assert ids[3] == {rows[k][0] for k in set(classes)}
    con = duckdb.connect()
    con.register("remaining", kept[3].toPandas())
    mixed = con.sql(queries.mix_sql(0.8, 1, "remaining")).df()
    assert ids[4] == set(mixed.doc_id)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[4].collect()}
    packed = kept[5].collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    assert check_sequences(packed, 2048) <= 1.1 * sum(want.values()) / 2048 + 1

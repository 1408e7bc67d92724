"""Ranked search against SQL and against a plain loop."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ampledger.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def loop(docs, items, k=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_all, l_all = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(items):
        scores = []
        for key, bag, n in bags:
            m = 100 - 75 + (75 * n * n_all) // l_all
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in terms(text)
                if t in bag
            )
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, r + 1, None if null else key, -s) for r, (s, null, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (3, docs[7][1]), (900, None), (901, " .,;")]
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(40)] + [(7, "w1 w1 w1 w2"), (7, "w1 w1 w1 w2"), (50, None), (51, "?"), (52, "unheard of")]
    items.append((53, docs[7][1]))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_against_a_loop(spark, corpus):
    want = loop(*corpus)
    docs, items = frames(spark, *corpus)
    assert got(lexical.ranked_search(docs, items)) == want
    # Equal documents, a null id among them, tie: the smallest ids come first.
    tied = [r for r in want if r[0] == 53]
    assert [r[2] for r in sorted(tied, key=lambda r: r[1])] == [3, 7, *range(400, 408)]


def test_several_blocks_of_small_trees(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(lexical, "TREE_BYTES", 1 << 16)
    docs, items = frames(spark, *corpus)
    assert got(lexical.ranked_search(docs, items, k=3)) == loop(*corpus, k=3)


def test_integers_beyond_doubles_agree(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 0)
    docs, items = frames(spark, *corpus)
    assert got(lexical.ranked_search(docs, items)) == loop(*corpus)


def test_walk_leaves_pairs_out():
    """Two topics: documents of the other topic are not scored, and the result is whole."""
    rng = np.random.default_rng(2)
    topic = np.repeat([0, 1], 512)
    vectors = np.where(np.arange(64) // 32 == topic[:, None], rng.integers(0, 1000, (1024, 64)), 0).astype(float)
    items = lexical.Items(pa.array([" ".join(f"t{j}" for j in range(32)), " ".join(f"t{j}" for j in range(32, 64))]))
    items.grow(np.ones(64, np.int64))
    best = lexical.Best(items, 5, np.ones(2))
    scored = lexical.search(items, list(range(1024)), vectors, best)
    assert scored < 2 * 1024 * 0.75
    whole = items.counts @ vectors.T
    for i, found in enumerate(best.rows):
        assert [-s for s, _, _ in found] == sorted(whole[i], reverse=True)[:5]


def test_odd_rows(spark, odd, nothing, make):
    items = make([(1, "PLAIN words übung"), (2, None), (3, "日本語")], clash=True).withColumnRenamed("doc_id", "item_id")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(lexical.ranked_search(odd, items)) == loop(rows, [(1, "PLAIN words übung"), (2, None), (3, "日本語")])
    assert lexical.ranked_search(nothing, items).collect() == []
    assert lexical.ranked_search(odd, nothing.withColumnRenamed("doc_id", "item_id")).collect() == []

"""Periodic runs against a scan of every period, and extensions against a scan of symbols."""

import hashlib
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ampledger.llm import queries
from ampledger.llm.periodic import find_runs, periodic_runs
from ampledger.llm.recompression import common_extensions, mirrored, recompress

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scan(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start and period: each period on its own."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(24, 3 * p):
                found.setdefault((start, i - start + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 3, 50]))), max_size=150))
    for _ in range(draw(st.integers(0, 3))):
        if words:
            a = draw(st.integers(0, len(words) - 1))
            p = draw(st.integers(1, max(1, len(words) // 3)))
            for i in range(a, draw(st.integers(a, len(words)))):
                words[i] = words[a + (i - a) % p]
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences(), min_size=1, max_size=5))
def test_runs_equal_a_scan(docs):
    got = find_runs(np.array([w for d in docs for w in d], np.int64), np.cumsum([0, *map(len, docs)]))
    assert [tuple(r) for r in got.tolist()] == [(d, *run) for d, words in enumerate(docs) for run in scan(words)]


def test_pairs_in_several_portions(monkeypatch):
    from ampledger.llm import periodic

    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(0, 9, p), 200 // p + 2) for p in (1, 2, 7, 20, 40)])
    whole = find_runs(words, np.array([0, 300, len(words)]))
    monkeypatch.setattr(periodic, "PAIRS", 5)
    assert len(whole) > 4 and (find_runs(words, np.array([0, 300, len(words)])) == whole).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=100), st.data())
def test_extensions_equal_a_scan(middle, data):
    symbols = np.array([-1, *middle, -2])
    place = st.integers(1, len(middle))
    pairs = [p for p in data.draw(st.lists(st.tuples(place, place), max_size=20)) if p[0] != p[1]]
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    levels = recompress(symbols)
    ahead = common_extensions(levels, a, b)
    behind = common_extensions(mirrored(levels), len(symbols) - 1 - a, len(symbols) - 1 - b)
    for x, y, to_right, to_left in zip(a.tolist(), b.tolist(), ahead.tolist(), behind.tolist()):
        for step, length in ((1, to_right), (-1, to_left)):
            k = 0
            while symbols[x + step * k] == symbols[y + step * k]:
                k += 1
            assert k == length


def test_grammar_is_small_and_expands():
    rng = np.random.default_rng(1)
    for symbols in (rng.integers(0, 1000, 5000), np.zeros(5000, int), np.tile(np.arange(7), 700)):
        levels = recompress(np.concatenate([[-1], symbols, [-2]]))
        assert len(levels) < 80 and len(levels[-1].symbols) == 3
        for below, above in zip(levels, levels[1:]):
            expansion = {}
            for node, symbol in enumerate(above.symbols.tolist()):
                children = tuple(below.symbols[below.first[node] : below.first[node + 1]].tolist())
                assert expansion.setdefault(symbol, children) == children


def by_hand(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = scan(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(), n,
    )


def test_query_against_hand_count(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_odd_rows(odd, nothing, make):
    got = periodic_runs(odd).collect()
    assert len(got) == 13 and all(r.runs == [] for r in got)
    assert sorted(r.n_words for r in got)[-1] == 30_000
    assert periodic_runs(nothing).collect() == []
    run = "x " * 10 + "a\tb\x0bc c " * 20 + "tail of it"
    twice = periodic_runs(make([(None, run), (None, run), (3, " " + run + "\n")])).collect()
    assert [r.runs for r in twice] == [[(10, 60, 3)]] * 3
    assert {r.collapsed for r in twice} == {"x " * 10 + "a b c c tail of it"}

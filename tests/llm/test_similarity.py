"""Near duplicates, vector join and license scan against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import words

from ampledger.llm import embeddings, licenses, near_dedup
from ampledger.llm.words import ALNUM, VISIBLE, labelled, shingles, word_hashes, word_spans


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def test_word_spans_and_hashes():
    texts = ["Hello, World", "", "hello world", "x", "Éa é"]
    hashes, before = word_hashes(pa.array(texts))
    assert before.tolist() == [0, 2, 2, 4, 5, 7]
    assert (hashes[0:2] == hashes[2:4]).all() and hashes[0] != hashes[1]
    data, starts, ends, _ = word_spans(pa.array(texts).slice(2), VISIBLE)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)][:3] == [b"hello", b"world", b"x"]
    assert word_hashes(pa.array([], pa.string()))[1].tolist() == [0]
    assert len(set(labelled(np.array([5, 5, 5, 7], np.uint64)).tolist())) == 4
    assert len(shingles(hashes[:2], 5)) == 1 and len(shingles(hashes[:0], 5)) == 0


def variants(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = words(rng, base_words)
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[f"new{rng.randrange(99)}"], [], ["two", f"more{rng.randrange(99)}"]])
        out.append(" ".join(text))
    return out


def exact_classes(texts):
    hashes, before = word_hashes(pa.array([t or "" for t in texts]))
    labels = [near_dedup.kmers(hashes[before[i] : before[i + 1]]).astype(np.uint32) for i in range(len(texts))]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if (texts[i] or "") == (texts[j] or "") or near_dedup.similarity(labels[i], labels[j], 0.8) >= 0.8
    ]
    return components(len(texts), links)


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_equal_brute_force(make, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STAR", block)
    passage = " ".join(words(random.Random(77), 60))
    texts = variants(1, 120, 40, 6) + variants(2, 40, 20, 2) + variants(3, 300, 20, 14)
    texts += [" ".join(words(random.Random(i), 40)) + " " + passage for i in range(30)]
    texts += ["a b c", "A, b: c!", "a b", "same line\n" * 30, "same line\n" * 30 + "end"]
    random.Random(9).shuffle(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(make(texts, clash=True)).collect()}
    want = exact_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) and got[i].class_size == want.count(want[i]) for i in range(len(texts)))


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.class_id, r.class_size, r.kept))
    assert by_id[7] == {(4, 3, False)} and (4, 3, True) in by_id[4]
    assert by_id[1] == {(1, 3, True)} and by_id[2] == {(1, 3, False)}  # null and empty are equal
    assert by_id[3] == {(3, 1, True)}  # blanks are another text
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_similarity_is_order_sensitive():
    h = word_hashes(pa.array([" ".join(f"a{i}" for i in range(100))]))[0]
    a = near_dedup.kmers(h)
    b = near_dedup.kmers(np.concatenate([h[50:], h[:50]]))
    assert near_dedup.similarity(a, a, 0.8) == 1.0
    assert near_dedup.similarity(a, b, 0.8) < 0.5
    assert near_dedup.similarity(a, a[:0], 0.8) == 0.0


def vectors_fixture(rng, n, dim, groups):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.05, 0.5, (n, 1))
    x[: n // 10] = x[0]
    return x


@pytest.mark.parametrize("dim,groups,threshold", [(3, 5, 0.9), (16, 6, 0.9), (16, 3, 0.5), (1, 2, 0.9)])
def test_vector_join_equals_brute_force(spark, monkeypatch, dim, groups, threshold):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "FAN", 3)
    monkeypatch.setattr(embeddings, "ROW", 2)
    x = vectors_fixture(np.random.default_rng(dim), 300, dim, groups)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, threshold).collect()}
    u = embeddings.unit(x)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    want = components(len(x), zip(*np.nonzero(near)))
    assert [got[i].component_id for i in range(len(x))] == want
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]),
        (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, []), (2, [2.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e299]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "1 AS node", "2 AS n", "3 AS root", "4 AS links")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    linked = [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (None, 5, 1, False), (10, 5, 1, False), (11, 5, 1, False)]
    assert sorted(got, key=str) == sorted(alone + linked, key=str)
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 3")).collect()[0].kept


def test_vectors_of_several_lengths(spark):
    """Each length is compared among itself, also one that few rows have."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for dim, n in ((2, 40), (3, 12), (8, 20), (5, 1)):
        x = rng.normal(0, 1, (n, dim))
        x[1::3] = x[::3][: len(x[1::3])] * 1.5 + 1e-3
        ids = [len(rows) + i for i in range(n)]
        u = embeddings.unit(x)
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        for i, c in enumerate(components(n, zip(*np.nonzero(near)))):
            want[ids[i]] = (int(near[i].sum()), ids[c])
        rows += [(i, v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows + [(900, [0.0, 0.0, 0.0]), (901, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == want | {900: (0, 900), 901: (0, 901)}
    assert sum(links > 0 for links, _ in want.values()) > 30


def test_far_intervals_are_skipped(spark):
    boxes = spark.createDataFrame([(i, [i * 1.0], [i + 0.5]) for i in range(20)], "block long, low array<double>, high array<double>")
    got = sorted((r.a, r.b) for r in embeddings.near_intervals(boxes, 20, 1, 0.6).collect())
    assert got == sorted([(i, i) for i in range(20)] + [(i, i + 1) for i in range(19)])


def written(spark):
    """Bytes of the shuffle files that the session holds."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(d, f)) for top in folders for d, _, files in os.walk(top.getPath()) for f in files)


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """Vectors without structure: all intervals meet, but the disk follows the vectors, not the pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    n, dim = 4000, 64
    x = np.random.default_rng(8).normal(size=(n, dim)).astype(np.float32)
    x[1::50] = x[::50] + np.float32(0.01)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    before = written(spark)
    got = embeddings.near_duplicates(df).collect()
    assert written(spark) - before < 3 * x.nbytes
    assert sum(r.n_links for r in got) == 2 * n // 50 and sum(r.kept for r in got) == n - n // 50


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_join_in_many_dimensions(spark, monkeypatch, kind):
    """Sketches of a part of the axes lose no pair at the threshold; crowded and sparse pieces, copies in several batches."""
    monkeypatch.setattr(embeddings, "BLOCK", 96)
    monkeypatch.setattr(embeddings, "PIECE", 32)
    monkeypatch.setattr(embeddings, "TASK", 2)
    monkeypatch.setattr(embeddings, "EDGES", 40)
    rng = np.random.default_rng(6)
    n, dim = 900, 64
    x = rng.normal(size=(n, dim))
    u = embeddings.unit(x)
    for i in range(0, 300, 2):  # cosines just above and below the threshold
        aside = u[i + 1] - (u[i + 1] @ u[i]) * u[i]
        cosine = 0.9 + rng.choice([-1, 1]) * 10 ** rng.uniform(-6, -2)
        x[i + 1] = cosine * u[i] + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
    x[300:420] = x[300] + rng.normal(size=(120, dim)) * 0.1
    x[420:480] = x[420]
    x = x.astype(np.float32 if kind == "float" else float)
    x[480], x[481], x[480, 3], x[481, 3] = x[482], x[482], 0.0, -0.0
    order = rng.permutation(n)
    rows = [(int(i), x[i].tolist()) for i in order]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(7)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    u = embeddings.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(n, zip(*np.nonzero(near)))
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(n)}
    axes, spread = embeddings.principal_axes(df, dim)
    assert embeddings.sketch_axes(spread, np.sqrt(0.2)) < dim and np.allclose(axes.T @ axes, np.eye(dim))


def test_crowded_pieces_are_stars():
    rng = np.random.default_rng(3)
    for share in (0.002, 0.01, 0.1, 1.0):
        near = rng.random((60, 45)) < share
        rows, columns = embeddings._stars(near)
        want = components(105, [(i, 60 + j) for i, j in zip(*np.nonzero(near))])
        assert rows.tolist() == want[:60]
        assert [c for c, any_ in zip(columns, near.any(axis=0)) if any_] == [w for w, any_ in zip(want[60:], near.any(axis=0)) if any_]
        assert (columns[~near.any(axis=0)] == 60).all() and (rows + 10**12).max() >= 10**12


def test_license_spans(make, odd, nothing):
    notice, grant = licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["MIT-grant"]
    changed = grant.replace("free of charge,", "at no cost").replace("copies of the", "copies of")
    rows = ["x y " + notice + " z", "é " + grant.upper() + "\n" + notice, "pre " + changed, "released the", notice * 2, "Released under a MIT License"]
    got = licenses.scan(make(rows)).collect()
    found = {}
    for r in got:
        part = rows[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        found.setdefault((r.doc_id, r.template), []).append((r.coverage, part))
    assert found[0, "MIT-notice"] == [(1.0, notice[:-1])]
    assert found[1, "MIT-grant"] == [(1.0, grant.upper()[:-1])] and found[1, "MIT-notice"][0][0] == 1.0
    assert 0.9 < found[2, "MIT-grant"][0][0] < 1
    assert len(found[4, "MIT-notice"]) == 2
    assert (3, "MIT-notice") not in found and found[5, "MIT-notice"][0][0] == pytest.approx(0.8)
    assert licenses.scan(odd).count() == licenses.scan(nothing).count() == 0


def test_license_spans_with_words_put_in(make):
    rows = ["Released under the terms of the MIT License", "Licensed under the terms of the Apache License, Version 2.0", "Released under our MIT License"]
    got = {r.doc_id: (r.template, r.coverage, r.first_word, r.last_word) for r in licenses.scan(make(rows)).collect()}
    assert got == {0: ("MIT-notice", 1.0, 0, 7), 1: ("Apache-2.0-notice", 1.0, 0, 10), 2: ("MIT-notice", 0.8, 0, 4)}


def plain_alignment(template, words):
    """Most template words in order in ``words``: matches, first and last place; of equal
    alignments the shortest and then the earliest."""
    best = {}
    for i in range(len(template)):
        new = {}
        for j in [j for j in range(len(words)) if words[j] == template[i]]:
            n, first = max((x for last, x in best.items() if last < j), default=(0, j))
            new[j] = max(best.get(j, (0, -1)), (n + 1, first))
        best |= new
    n, span, first = max(((n, first - last, -first) for last, (n, first) in best.items()), default=(0, 0, 0))
    return n, -first, -first - span


@pytest.mark.parametrize("coverage", [0.7, 1.0])
def test_license_places_equal_unbanded_alignment(coverage):
    """All windows aligned without a band against the spans of the scan."""
    rng = random.Random(7)
    templates = {"a": "p q r s q", "b": "q t u p q v w p", "c": "t", "d": "u v"}
    index = licenses.Index(templates, coverage)
    texts = [" ".join(rng.choice("pqrstuvwxyz") for _ in range(rng.randrange(40))) for _ in range(200)]
    hashes, before = word_hashes(pa.array(texts))
    want = []
    for i in range(len(texts)):
        words_of = hashes[before[i] : before[i + 1]]
        for t, template in enumerate(index.words):
            most, found, taken = 2 * len(template), set(), set()
            for start in range(len(words_of)):
                for end in range(start + 1, min(len(words_of), start + most) + 1):
                    n, first, last = plain_alignment(template, words_of[start:end])
                    if n >= index.need[t]:
                        found.add((-n, last - first, start + first, start + last))
            for n, _, first, last in sorted(found):
                if not taken & set(range(first, last + 1)):
                    taken |= set(range(first, last + 1))
                    want.append((i, t, -n, int(before[i]) + first, int(before[i]) + last))
    assert len(want) > 20 and sorted(index.matches(hashes, before)) == sorted(want)


def whole_alignment(index, hashes, before):
    """The spans that an alignment of whole texts without a band finds."""
    want = set()
    for i in range(len(before) - 1):
        part = hashes[before[i] : before[i + 1]]
        for t, template in enumerate(index.words):
            taken = set()
            found = licenses.align(template, part, index.need[t], 2 * len(template))
            for n, first, last in sorted(found, key=lambda s: (-s[0], s[2] - s[1], s[1])):
                if not taken & set(range(first, last + 1)):
                    taken |= set(range(first, last + 1))
                    want.add((i, t, n, int(before[i]) + first, int(before[i]) + last))
    return want


@pytest.mark.parametrize("coverage", [0.2, 0.4, 0.8])
def test_license_places_lose_no_span_at_any_coverage(coverage):
    rng = random.Random(11)
    index = licenses.Index({"a": "p q r s q", "b": "q t u p q v w p", "c": "t", "d": "u v"}, coverage)
    texts = [" ".join(rng.choice("pqrstuvwxyz") for _ in range(rng.randrange(60))) for _ in range(200)]
    hashes, before = word_hashes(pa.array(texts))
    want = whole_alignment(index, hashes, before)
    assert len(want) > 20 and set(index.matches(hashes, before)) == want


def test_license_places_of_edited_templates_equal_whole_alignment():
    """Long templates, cut, worn and filled with their own and other words."""
    index = licenses.Index(licenses.TEMPLATES, 0.8)
    assert {licenses.fingerprints(w, n)[0] for w, n in zip(index.words, index.need)} == {licenses.GRAM}
    assert any(len(licenses.fingerprints(w, n)[1]) < len(w) - 1 for w, n in zip(index.words, index.need))
    rng, texts = random.Random(3), []
    for _ in range(150):
        words_of = rng.choice(list(licenses.TEMPLATES.values())).split()
        drop, put = rng.choice([0, 0.1, 0.2]), rng.choice([0, 0.2, 0.5, 0.9])
        text = [rng.choice(["x", "the", "of"]) for _ in range(rng.randrange(9))]
        for w in words_of:
            text += [w] * (rng.random() >= drop) + [rng.choice(["x", "y", *words_of])] * (rng.random() < put)
        texts.append(" ".join(text))
    hashes, before = word_hashes(pa.array(texts))
    want = whole_alignment(index, hashes, before)
    assert len(want) > 80 and set(index.matches(hashes, before)) == want


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(8)
    for _ in range(200):
        t, w = rng.integers(0, 5, rng.integers(1, 8)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64)
        table = np.zeros((len(t) + 1, len(w) + 1), int)
        for i in range(len(t)):
            for j in range(len(w)):
                table[i + 1, j + 1] = max(table[i, j] + (t[i] == w[j]), table[i, j + 1], table[i + 1, j])
        found = licenses.align(t, w, 1, len(w))
        n, first, last = max(found, key=lambda s: (s[0], s[1] - s[2], -s[1]), default=(0, 0, 0))
        assert n == table[-1, -1] and (n, first, last) == plain_alignment(t, w)
        assert n == 0 or (0 <= first <= last < len(w))


def test_winnowing_keeps_common_runs():
    rng = np.random.default_rng(1)
    run = rng.integers(1, 2**60, licenses.GRAM + licenses.WINDOW - 1).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(1, 2**60, 9).astype(np.uint64), run, rng.integers(1, 2**60, 9).astype(np.uint64)]) for _ in range(2))
        prints = [set(licenses.grams(x)[licenses.winnow(licenses.grams(x))].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]
    assert ALNUM[ord("z")] and not ALNUM[ord("_")]


def test_near_duplicates_without_ids_or_with_one_id(spark, make, monkeypatch):
    """Texts without an id are joined to their own rows only; of texts with one id one is kept."""
    rng = random.Random(12)
    base = words(rng, 60)
    rows = [(None, " ".join(words(rng, 20, 10**6))) for _ in range(300)]
    rows += [(5, " ".join(base)), (5, " ".join([*base[:-1], "end"])), (6, " ".join(["start", *base[1:]]))]
    rows += [(None, " ".join([*base, "more"])), (5, "quite another text that has nothing near")]
    got = near_dedup.near_duplicates(make(rows), with_digest=True).collect()
    assert len(got) == len(rows)
    near = [r for r in got if r.class_size == 4]
    assert len(near) == 4 and {r.class_id for r in near} == {5} and sum(r.kept for r in near) == 1
    assert sum(r.kept for r in got) == 302
    assert [r.class_size for r in got if r.doc_id == 5 and r.kept] in ([4, 1], [1, 4])
    frame = near_dedup.documents_of(make(rows)).withColumn("digest", near_dedup.F.sha2("text", 256))
    signed = near_dedup._signatures(frame).selectExpr("monotonically_increasing_id() AS node", "doc_id", "digest", "text_class")
    assert near_dedup._kmers_of(frame, signed).count() == len(rows)


def test_blocks_meet_each_other_only_across():
    """A pair inside a block belongs to the group of the block with itself, not to all its groups."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, 60).astype(np.uint32)
    other = rng.integers(0, 2**32, 60).astype(np.uint32)
    texts = [base, base[1:], other, base[2:], other[:-1], other[1:]]
    sides = [False, False, False, True, True, True]
    everything = near_dedup.spanning_links(list(range(6)), list(range(6)), texts, 0.8)
    across = near_dedup.spanning_links(list(range(6)), list(range(6)), texts, 0.8, sides)
    assert {(a, b) for a, b in everything} == {(0, 1), (0, 3), (2, 4), (2, 5)}
    assert across == [(0, 3), (1, 3), (2, 4), (2, 5)]

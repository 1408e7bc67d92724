"""Language, quality and language model: held-out accuracy, defined edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from ampledger.llm import language, language_model, quality, queries
from ampledger.llm.common import table

SF = "/root/testdata/sf0.01"


def held(i, modulus):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == 0


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language"](spark, SF)
    both = got.join(table(spark, SF, "documents"), "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in both]) > 0.98
    assert all(0 <= r.score <= 1 for r in both)
    assert got.count() == table(spark, SF, "documents").count()


def test_language_edges(spark, odd, nothing):
    train = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)],
        "doc_id long, text string, lang string",
    )
    model = language.fit(train)
    assert model.languages == ["de", "en", "fr"]
    assert model.predict("The dog")[0] == "en" and model.predict("hundkatze")[0] == "de"
    assert model.predict(None) == ("und", 0.0) == model.predict("123 ... _")
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {str(r.doc_id) for r in got if r.lang_pred == "und"} == {"1", "2", "3", "9", "None"}
    empty = language.fit(train.where("false"))
    assert empty.predict("the cat") == ("und", 0.0)
    assert language.identify(nothing, model).count() == 0


def test_language_of_few_rows(spark):
    """A language with a thousandth of the rows is learned and takes no texts of others."""
    rng = random.Random(8)
    text = lambda kind: " ".join(f"{kind}{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('aeiou')}{kind}" for _ in range(30))
    rows = [(i, text("x" if i % 2 else "z"), "xx" if i % 2 else "zz") for i in range(4000)]
    rows += [(5000 + i, text("qv"[i % 2]), "qv"[i % 2] * 2) for i in range(8)] + [(None, text("x"), "xx")] * 200
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=60)
    assert all(model.predict(text(kind))[0] == kind * 2 for kind in "xzqv" for _ in range(20))


def test_language_without_counts_is_not_favoured():
    counts = np.array([[1 + i % 3, 0] for i in range(1000)] + [[600_000, 0]], float)
    own = language._log_frequencies(counts)[0]
    assert own[1] - own[0] < 1


def plain_language(train, probe):
    """Word-first backoff by dictionaries of counts, text by text."""
    languages = sorted({x for _, x in train})
    split = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = {"w": {}, "g": {}}
    for text, lang in train:
        for w in split(text):
            tables["w"].setdefault(w, Counter())[lang] += 1
            for n in (1, 2, 3, 4):
                for g in grams(w, n):
                    tables["g"].setdefault(g, Counter())[lang] += 1
    score = {}
    for kind, rows in tables.items():
        everything = sum(sum(c.values()) for c in rows.values())
        of = {x: sum(c[x] for c in rows.values()) for x in languages}
        for key, c in rows.items():
            add = 0.1 * len(rows) * sum(c.values()) / everything
            raw = [math.log(c[x] + add) - math.log(of[x] + 0.1 * len(rows)) for x in languages]
            score[kind, key] = [r - sum(raw) / len(raw) for r in raw]
    out = []
    for text in probe:
        total = [math.log(sum(y == x for _, y in train) / len(train)) for x in languages]
        for w in split(text):
            rows = [score["w", w]] if ("w", w) in score else []
            for n in (4, 3, 2, 1):
                rows = rows or [score["g", g] for g in grams(w, n) if ("g", g) in score]
            for r in rows:
                total = [a + b / len(rows) for a, b in zip(total, r)]
        best = max(range(len(languages)), key=total.__getitem__)
        share = 1 / sum(math.exp(x - total[best]) for x in total)
        out.append((languages[best], share) if split(text) else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    """Every word and n-gram of the sampled texts counts, none is cut off as too rare."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows if not held(r.doc_id, 5) and r.lang is not None]
    want = plain_language(train, [r.text for r in rows])
    got = {r.doc_id: r for r in queries.QUERIES["op6_language"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r, (lang, share) in zip(rows, want):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(share, abs=1e-6)


def test_language_backs_off_by_length():
    model = language.Model(["a", "b"], np.zeros(2), {}, {"^ab": 0, "b": 1}, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert model.grams_known("abc") == [0]
    assert model.grams_known("xb") == [1]
    assert model.grams_known("zz") == []


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op7_quality"](spark, sf).where("held_out")
    rows = got.join(table(spark, sf, "labels"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.98
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark, odd, nothing):
    rng = random.Random(4)
    good = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(80)), 1) for i in range(60)]
    bad = [(i + 100, "".join(rng.choices("#$%&*!", k=400)), 0) for i in range(60)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, text string, label int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    probe = spark.createDataFrame([(1, good[0][1]), (2, bad[0][1]), (3, ""), (4, None)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in quality.quality(probe, model).collect()}
    assert score[1] > 0.9 and score[2] < 0.1 and score[3] == score[4] == pytest.approx(0.5, abs=0.01)
    got = quality.scored(odd, model, score_col="quality_score")
    assert got.columns == [*odd.columns, "quality_score"] and got.count() == odd.count()
    with pytest.raises(ValueError):
        quality.scored(odd, model)
    assert quality.quality(nothing, model).count() == 0
    one_kind = quality.fit(df.select("doc_id", "text"), df.where("label = 1").select("doc_id", "label"))
    assert {round(r.score, 6) for r in quality.quality(probe, one_kind).collect()} == {round(61 / 62, 6)}
    untrained = quality.fit(df.select("doc_id", "text"), df.where("false").select("doc_id", F.lit(None).cast("int").alias("label")))
    assert {r.score for r in quality.quality(probe, untrained).collect()} == {0.5}


def test_quality_equals_brute_force(spark, monkeypatch):
    """Dictionaries and curve of the operator, sizes and probabilities by plain Python."""
    import zstandard

    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    model = quality.fit(docs, quality.training_labels(labels))
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        good, bad = (sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for c in pair)
        logit = model.slope * (bad - good) / (len(data) + 64) + model.shift * len(data) / (len(data) + 64) + model.prior
        score = 1 / (1 + math.exp(-logit))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9)
        assert got[r.doc_id].predicted == (score >= 0.3) and got[r.doc_id].held_out == held(r.doc_id, 5)


def test_quality_reads_all_pieces_of_sampled_texts(spark, make, monkeypatch):
    """Each piece is a sample once, in groups on the executors, whatever their number."""
    texts = ["".join(chr(97 + (i * j) % 26) for j in range(1, 3500 + i)) for i in range(30)] + ["", "short"]
    df = make(texts).selectExpr("1 AS label", "doc_id AS seed", "text")
    cut = quality._cut(df).collect()
    whole = {}
    for r in sorted(cut, key=lambda r: (r.seed, r.i)):
        whole[r.seed] = whole.get(r.seed, b"") + bytes(r.piece)
    assert [whole.get(i, b"").decode() for i in range(len(texts))] == texts
    one = quality._dictionaries(df, 2048)
    monkeypatch.setattr(quality, "GROUP_BYTES", 20_000)
    many = quality._dictionaries(df, 2048)
    assert list(one) == list(many) == [1] and 0 < len(many[1]) <= 2048


def base_of(rows, modulus=10):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    out = [held(i, modulus) for i, _ in rows]
    c = Counter(x for t, h in zip(tokens, out) if not h for x in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t) for t in tokens]
    return [(len(t), sum(c[x] > 0 for x in t), n, b, h) for t, b, h in zip(tokens, base, out)]


@pytest.mark.parametrize("bucket", [200, 3_000_000])
def test_language_model_counts(odd, nothing, bucket, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(language_model, "COMMON", 20)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted((n, k, t, round(b, 6), h) for n, k, t, b, h in base_of(rows))
    got = language_model.scores(odd).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == want
    assert all(r.score < 0 and r.perplexity >= 1 for r in got)
    same = {round(r.score, 9) for r in got if r.doc_id in (4, 7) and r.n_tokens == 7}
    assert len({round(r.score, 9) for r in got if r.doc_id == 4 and r.n_tokens == 7}) == 1 and same
    assert language_model.scores(nothing).count() == 0


def test_language_model_beats_its_base(spark):
    got = language_model.scores(table(spark, SF, "documents")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.95
    assert np.mean([r.score > r.base_score for r in got]) > 0.95


def test_score_hardly_depends_on_buckets(make, monkeypatch):
    """What follows a common word is one of four rare words, however many buckets there are."""
    monkeypatch.setattr(language_model, "COMMON", 11)
    rng = random.Random(2)
    rows = [" ".join(f"c{(i := rng.randrange(10))} r{i}_{rng.randrange(4)}" for _ in range(200)) for _ in range(60)]
    docs, per_token = make(rows), []
    for bucket in (3_000_000, 150):
        monkeypatch.setattr(language_model, "BUCKET_TOKENS", bucket)
        got = language_model.scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
        per_token.append(got.s / got.n)
    assert per_token[1] == pytest.approx(per_token[0], abs=0.05)


@pytest.mark.parametrize("tallied", [40, 1_000_000])
def test_common_words_do_not_depend_on_partitions(make, monkeypatch, tallied):
    """Words of one text in a partition of its own are no commoner for it."""
    monkeypatch.setattr(language_model, "COMMON", 30)
    monkeypatch.setattr(language_model, "TALLIED", tallied, raising=False)
    rng = random.Random(6)
    texts = [" ".join([f"own{i} own{i} own{i}", *(f"w{rng.randrange(5000)}" for _ in range(3000))]) for i in range(60)]
    counts = Counter(w for t in texts for w in [*t.split(), None])
    rows = make(texts).select("text", F.lit(True).alias("train"))
    found = []
    for n in (1, 60):
        common, tokens = language_model._common_words(rows.repartition(n))
        assert tokens == sum(counts.values())
        found.append((common.words.tolist(), common.endings.tolist()))
    assert found[0] == found[1]
    tokens = language_model.tokens_of(pa.array(texts))
    words, n = np.unique(tokens.word, return_counts=True)
    order = np.lexsort((words.view(np.int64), -n, words != language_model.END_HASH))[:30]
    assert found[0][0] == sorted(words[order].tolist())


def test_bucket_shares_sum_to_one():
    rng = np.random.default_rng(5)
    common = language_model.Common(np.array([3, 4], np.uint64), np.array([7, 7]))
    found = rng.poisson(0.3, (common.codes, 9))
    found[0] = [50, *[0] * 8]
    by_ending = np.zeros((language_model.ENDINGS + 1, 9), int)
    np.add.at(by_ending, common.parent, found)
    types = ((by_ending > 0).sum(axis=1), (found > 0).sum(axis=1))
    shares = language_model.Shares(9, found.sum(axis=0), found.sum(axis=1), types, (0.5, 0.4))
    assert shares.plain.sum() == pytest.approx(1)
    each = np.array([shares.of_bucket(found[:, b], common) for b in range(9)])
    assert each.sum(axis=0) == pytest.approx(np.ones(common.codes))
    assert each[0, 0] > 0.98


def cells_of(rng, rooms=12, words=31, n=600):
    """Rooms below three endings, some tokens at an ending itself."""
    room = np.where(rng.random(n) < 0.7, rng.integers(0, rooms, n), -1)
    ending = np.where(room >= 0, np.maximum(room, 0) % 3, rng.integers(0, 4, n))
    word = (rng.zipf(1.5, n) + np.maximum(room, 0)) % (words - 1)
    (room, ending, word), count = np.unique(np.stack([room, ending, word]), axis=1, return_counts=True)
    return room, ending, word, count


def test_group_probabilities_sum_to_one():
    room, ending, word, count = cells_of(np.random.default_rng(3))
    known = np.unique(word)
    group = language_model.Group(room, ending, word, count * 3, 14, 31, len(known), 1)
    for _ in range(3):
        group.sweep()
        assert (group.t2 >= 1).all() and (group.t2 <= group.c2).all()
        assert (group.t1 >= 1).all() and (group.t1 <= group.c1).all()
        for r, e in ((0, 0), (4, 1), (13, 2), (-1, 1), (-1, 700)):  # room 13 has no customers
            one = np.ones(len(known), int)
            p = group.predict(r * one, e * one, known).sum()
            unseen = group.predict(np.array([r]), np.array([e]), np.array([30]))[0]
            assert p + unseen == pytest.approx(1.0)


def plain_restaurants(customers, d, known, sweeps, seed):
    """Table counts of (room, ending, word) cells, seated customer by customer through all
    three levels; a list of seatings after every sweep."""
    rng = random.Random(seed)
    tables = {2: {}, 1: {}, 0: {}}  # sizes of the tables of each cell
    size = {2: Counter(), 1: Counter(), 0: Counter()}
    n_tables = {2: Counter(), 1: Counter(), 0: Counter()}

    def path(room, ending, word):
        out = [(1, ending, word), (0, 0, word)]
        return [(2, room, word), *out] if room >= 0 else out

    def chance(level, place):
        if level == len(place):
            return 1 / (known + 1)
        at, room, word = place[level]
        up = chance(level + 1, place)
        here = tables[at].get((room, word), [])
        return (sum(here) - d[at] * len(here) + (1 + d[at] * n_tables[at][room]) * up) / (1 + size[at][room])

    def add(level, place):
        if level == len(place):
            return
        at, room, word = place[level]
        here = tables[at].setdefault((room, word), [])
        fresh = (1 + d[at] * n_tables[at][room]) * chance(level + 1, place)
        pick = rng.random() * (sum(here) - d[at] * len(here) + fresh)
        size[at][room] += 1
        for i, k in enumerate(here):
            pick -= k - d[at]
            if pick < 0:
                here[i] += 1
                return
        here.append(1)
        n_tables[at][room] += 1
        add(level + 1, place)

    def remove(level, place):
        if level == len(place):
            return
        at, room, word = place[level]
        here = tables[at][(room, word)]
        i = rng.choices(range(len(here)), weights=here)[0]
        here[i] -= 1
        size[at][room] -= 1
        if not here[i]:
            del here[i]
            n_tables[at][room] -= 1
            remove(level + 1, place)

    for who in customers:
        add(0, path(*who))
    for _ in range(sweeps):
        for who in customers:
            remove(0, path(*who))
            add(0, path(*who))
        yield lambda room, ending, word: chance(0, path(room, ending, word))


def test_group_follows_one_by_one_seating(monkeypatch):
    """Averaged probabilities against a sampler that moves one customer at a time."""
    room, ending, word, count = cells_of(np.random.default_rng(8), rooms=6, words=12, n=300)
    known = len(np.unique(word))
    monkeypatch.setattr(language_model, "SAMPLES", 60)
    group = language_model.Group(room, ending, word, count, 6, 12, known, 4)
    wanted = [(r, r % 3, w) for r in range(6) for w in range(12)] + [(-1, e, w) for e in range(5) for w in range(12)]
    got = group.averaged(*np.array(wanted).T)
    customers = [(int(r), int(e), int(w)) for r, e, w, n in zip(room, ending, word, count) for _ in range(n)]
    total = np.zeros(len(wanted))
    for i, chance in enumerate(plain_restaurants(customers, group.d, known, 70, 5)):
        if i >= 10:
            total += [chance(*x) for x in wanted]
    difference = np.log10(got) - np.log10(total / 60)
    assert abs(difference).max() < 0.15 and abs(difference.mean()) < 0.02 and difference.std() < 0.05


def test_every_context_has_a_room():
    """Dishes of a room sum to one, and what a rare context determines is expected of it."""
    room, dish = (x.ravel() for x in np.mgrid[:50, :20])
    count = np.where(dish == room % 20, 4, 0)
    count[room == 7] = 0
    parent = np.full(1000, 0.05)
    p = language_model.context_rooms(room, count, parent, 50, 1).reshape(50, 20)
    assert p.sum(axis=1) == pytest.approx(np.ones(50))
    assert p[7] == pytest.approx(parent[:20]) and all(p[r, r % 20] > 0.7 for r in range(50) if r != 7)


@pytest.mark.parametrize("bucket", [3_000_000, 500])
def test_rare_contexts_are_learned(make, monkeypatch, bucket):
    """Of held-out texts of words that are all rare, those in training too are told apart."""
    monkeypatch.setattr(language_model, "COMMON", 10)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", bucket)
    rng = random.Random(4)
    texts = [" ".join(words(rng, 60, 2000)) for _ in range(200)]
    inside = [i for i in range(400) if not held(i, 10)][:150]
    outside = [i for i in range(1000) if held(i, 10)][:20]
    rows = [*zip(inside, texts), *[(i, texts[k] if k % 2 else texts[-k - 1]) for k, i in enumerate(outside)]]
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.scores(make(rows)).where("held_out").collect()}
    seen, new = ([got[i] for k, i in enumerate(outside) if k % 2 == side] for side in (1, 0))
    # Nearly all pairs stood once, so the discount is high, and still a pair that stood counts.
    assert min(seen) > max(new) + 1


def test_seating_follows_the_restaurant():
    """Mean number of tables of one dish of c customers, by the exact recursion."""
    d, s, p, c, n = 0.5, 1.0, 0.3, 40, 4000
    exact = {1: 1.0}
    for k in range(1, c):
        after = {}
        for t, q in exact.items():
            fresh = (s + d * t) * p
            chance = fresh / (fresh + k - d * t)
            after[t + 1] = after.get(t + 1, 0) + q * chance
            after[t] = after.get(t, 0) + q * (1 - chance)
        exact = after
    mean = sum(t * q for t, q in exact.items())
    one = np.ones(n, np.int64)
    got = language_model.seat(one * c, np.arange(n), one, one.astype(float), np.full(n, p), d, s, np.random.default_rng(1))
    assert got.mean() == pytest.approx(mean, rel=0.03)
    many = language_model.seat(one * 5000, np.arange(n), one, one.astype(float), np.full(n, p), d, s, np.random.default_rng(1))
    assert (many >= 1).all() and (many <= 5000).all() and many.mean() > got.mean()


def test_tokens_of_texts():
    t = language_model.tokens_of(pa.array(["Ab c", "", " AB  c\n"]))
    assert t.text.tolist() == [0, 0, 0, 1, 2, 2, 2]
    assert t.word[0] == t.word[4] and t.word[1] == t.word[5] and t.word[2] == t.word[3] == language_model.END_HASH
    assert t.previous[0] == t.previous[3] == t.previous[4] == 0 and t.previous[1] == t.word[0]
    assert t.ending[0] == language_model.ENDINGS and t.ending[1] == language_model.ending_of(np.array([ord("b")]), np.array([ord("a")]))[0]

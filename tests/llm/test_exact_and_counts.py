"""Exact duplicates, token counts and packing against brute force."""

import hashlib
import random
import uuid
import zlib

import pytest
from conftest import words
from pyspark.sql import functions as F

from ampledger.llm import exact_dedup, packing, token_counts
from ampledger.session import checkpoint_root

P = pytest.importorskip("public_tokenizers")


def test_trie_numbers_strings():
    rng = random.Random(1)
    trie, want = exact_dedup.Trie(), {}
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(2000)]
    for key in keys:
        assert trie.insert(key, want.get(key, len(want))) == want.setdefault(key, len(want))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [1, 1 << 25])
def test_exact_duplicates_of_odd_rows(odd, keep, budget, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", budget)
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    got = exact_dedup.exact_duplicates(odd, keep=keep).collect()
    assert len(got) == len(rows)
    best = {}
    for i, t in rows:
        old = best.get(t)
        if t not in best or i is not None and (old is None or (i < old if keep == "smallest" else i > old)):
            best[t] = i
    want = sorted(
        (str(i), str(best[t]), sum(x == t for _, x in rows), i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_owners_keep_their_columns(make, nothing):
    df = make([(3, "a"), (9, "a"), (9, "a"), (1, None), (2, "")], clash=True)
    got = exact_dedup.text_owners(df, keep="largest").select("owner.*", "group_size").collect()
    assert sorted((r.doc_id, r.text, r.node, r.group_size) for r in got) == [(2, "", "node!", 2), (9, "a", "node!", 3)]
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_hot_text_over_many_partitions(spark, make):
    rng = random.Random(2)
    texts = ["the hot text"] * 600 + [" ".join(words(rng, 5)) for _ in range(300)]
    df = make(texts).repartition(30)
    got = exact_dedup.exact_duplicates(df, keep="smallest").where("kept").collect()
    assert len(got) == len(set(texts))
    assert next(r for r in got if r.group_size >= 600).doc_id == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, odd, nothing, name):
    path = P.path(name)
    cache = f"{checkpoint_root(spark)}/cache-{uuid.uuid4().hex}"
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    want = sorted((str(i), len(t.encode()), count(t), count(t) > 4096) for i, t in rows)
    for _ in range(2):  # the second call reads the cache
        got = token_counts.token_counts(odd, cache, path).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert spark.read.parquet(cache).count() == len({t for _, t in rows})
    assert token_counts.token_counts(nothing, cache, path).count() == 0
    other = token_counts.read_cache(spark, cache, "another version")
    assert other.count() == 0


def test_only_misses_are_encoded(spark, make, monkeypatch):
    """A second call over old and new texts appends the new ones alone; another version of the
    library finds none of them."""
    path = P.path("piece_bpe_32k.model")
    cache = f"{checkpoint_root(spark)}/cache-{uuid.uuid4().hex}"
    old = [f"old text {i % 40}" for i in range(90)]
    token_counts.token_counts(make(old), cache, path).collect()
    # Counts that the library would not give show that they come from the cache.
    stored = spark.read.parquet(cache)
    marked = f"{cache}-marked"
    stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(marked)
    texts = old + [f"new text {i % 7}" for i in range(20)]
    got = token_counts.token_counts(make(texts), marked, path).collect()
    assert len(got) == 110 and all((r.n_tokens > 1000) == (r.doc_id < 90) for r in got)
    assert spark.read.parquet(marked).count() == 40 + 7
    monkeypatch.setattr(token_counts, "version", lambda library: "another")
    assert all(r.n_tokens < 1000 for r in token_counts.token_counts(make(texts), marked, path).collect())
    assert spark.read.parquet(marked).count() == 2 * 47


def encoder():
    return packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_ids_equal_the_library(odd):
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), encoder()
    texts = [r.text or "" for r in odd.select("text").collect()]
    texts += ["a\n \n b", "  x", "x ", "\nx y\n", "don't they'll  a", "a \tb", "x.y, z. (q)", "é.\nÉ 1,2 v2.0", "<|endoftext|>"]
    for text in texts:
        assert fast(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def check_sequences(rows, width):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(by_sequence)


def test_pieces_are_whole_documents(odd, nothing):
    got = packing.pack(odd, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, width=64).collect()
    check_sequences(got, 64)
    want = []
    fast = encoder()
    for r in odd.select("doc_id", "text").collect():
        ids = [*fast(r.text or "").tolist(), 0]
        at = 0
        first = len(ids) % 64 or 64
        for piece, end in enumerate(range(first, len(ids) + 1, 64)):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at:end])
            want.append((str(r.doc_id), piece, at, end - at, zlib.crc32(raw)))
            at = end
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert packing.pack(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_every_piece_and_fills_exactly():
    rng = random.Random(3)
    for width in (10, 100, 2048):
        counts = {}
        for _ in range(400):
            length = rng.randrange(1, width + 1)
            counts[length] = counts.get(length, 0) + rng.randrange(1, 50)
        plan = packing.plan(counts, width)
        used = {}
        for pattern, times in plan:
            assert sum(pattern) <= width and times > 0
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == counts
        # No fewer sequences than tokens need, nor than pieces longer than half a sequence.
        # Few lengths in lumps can not all be matched.
        least = max(sum(k * v for k, v in counts.items()) / width, sum(v for k, v in counts.items() if 2 * k > width))
        assert sum(n for _, n in plan) <= 1.12 * least + 2
    many = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)]
    plan = packing.plan({k: many.count(k) for k in set(many)}, 2048)
    assert sum(n for _, n in plan) <= 1.001 * sum(many) / 2048 + 1
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [((6, 3, 1), 1)]
    assert packing.plan({7: 2, 1: 6}, 10) == [((7, 1, 1, 1), 2)]


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)
    parts = spark.range(1000).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "if(id % 3 = 0, 7L, 5L) AS length", "id AS ids_crc32", "id AS _copy"
    )
    got = packing.packed(parts, 12).collect()
    assert check_sequences(got, 12) == 334 + (666 - 334) // 2


def test_remembered_words_are_bounded():
    """New words without end, as identifiers are: a worker keeps some of them, the ids stay right."""
    import sys

    text = " ".join(f"{i:x}q" for i in range(300_000))
    encode = encoder()
    encode(text)
    held = encode.words
    assert sys.getsizeof(held) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held.items()) < 24 << 20
    again = "zebra " + text[-200_000:] + " yonder"
    assert encode(again).tolist() == encode.whole.encode(again, add_special_tokens=False).ids


def test_places_start_no_workers(spark):
    """The plan's places come as data, not as rows that Python workers serialise, and stay the same."""
    parts = spark.range(200).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "1 + id % 9 AS length", "id AS ids_crc32", "id AS _copy"
    )
    got = packing.packed(parts, 12)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert check_sequences(got.collect(), 12) == -(-sum(1 + i % 9 for i in range(200)) // 12)
    found = packing.places([((5, 3), 2), ((5,), 1)])
    assert [(r.length, [tuple(p) for p in r.places]) for r in spark.createDataFrame(packing._arrow(found), packing.PLACES).collect()] == list(found.items())

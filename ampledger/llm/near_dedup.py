"""Near duplicates by Order MinHash over words.

A sketch takes several minimal occurrence-labelled k-mers of a text and keeps them in text
order. Texts that share sketches are candidates; a banded alignment of their k-mers decides.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces, scratch
from ampledger.llm.words import labelled, mix, shingles, word_hashes
from ampledger.operators.components import connected_components

K = 5
#: Sketches of a text, and k-mers in a sketch. Two texts of similarity s share a sketch with
#: probability of about s^3: at 0.8 they miss all 16 once in 100,000 times.
SKETCHES = 16
KMERS = 3
#: Texts of one bucket that one task compares with each other; more are split into blocks.
BLOCK = 512
#: Texts compared with one star centre in one group.
STAR = 512
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def kmers(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled k-mers in text order."""
    return labelled(shingles(words, K))


def sketch(labels: np.ndarray) -> np.ndarray:
    """One number for each seed: the text-ordered k-mers with the smallest hashes."""
    out = np.empty(SKETCHES, np.uint64)
    n = len(labels)
    per_round = max(1, 4_000_000 // max(1, n))
    for at in range(0, SKETCHES, per_round):
        ranks = mix(labels[None, :] ^ SEEDS[at : at + per_round, None])
        if n > KMERS:
            places = np.sort(np.argpartition(ranks, KMERS - 1, axis=1)[:, :KMERS], axis=1)
        else:
            places = np.broadcast_to(np.arange(n), (len(ranks), n))
        value = SEEDS[at : at + per_round].copy()
        for i in range(places.shape[1]):
            value = mix(value + labels[places[:, i]])
        out[at : at + per_round] = value
    return out


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Common k-mers that stand in the same order in both texts, by the k-mers of either.

    The alignment is the longest increasing run of matched places. Places may differ by what
    ``threshold`` leaves unmatched in both texts, the band; 0 if the threshold is out of reach.
    """
    if len(a) == 0 or len(b) == 0:
        return 0.0
    reach = threshold / (1 + threshold) * (len(a) + len(b))
    common, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    if len(common) < reach - 1e-9:
        return 0.0
    band = len(a) + len(b) - 2 * reach + 1
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])]
    if len(j) > 1 and (j[1:] < j[:-1]).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        matched = len(tails)
    else:
        matched = len(j)
    return matched / (len(a) + len(b) - matched)


def _signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, text_class, sketches``; equal word sequences have one class, and texts
    without words one for each text. A text without k-mers has no sketches."""

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            hashes, before = word_hashes(batch.column("text"))
            classes, sketches = [], []
            for i in range(len(batch)):
                words = hashes[before[i] : before[i + 1]]
                if len(words):
                    classes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(kmers(words)).view(np.int64))
                else:
                    raw = b"\0" + batch.column("text")[i].as_py().encode()
                    classes.append(hashlib.blake2b(raw, digest_size=16).digest())
                    sketches.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(classes, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "text_class", "sketches"],
            )

    return documents.mapInArrow(run, "doc_id long, digest string, text_class binary, sketches array<long>")


def _kmers_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, kmers`` for ``wanted(node, doc_id, digest, text_class)``: labelled k-mers, 4 bytes
    each. A text is found by id and digest, so that rows without an id are not one key."""

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            hashes, before = word_hashes(batch.column("text"))
            nodes, out = [], []
            for i, (node, known) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text_class").to_pylist())):
                words = hashes[before[i] : before[i + 1]]
                if len(words) and hashlib.blake2b(words.tobytes(), digest_size=16).digest() == known:
                    nodes.append(node)
                    out.append(kmers(words).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "kmers"])

    rows = wanted.withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    same = documents.doc_id.eqNullSafe(rows._doc) & (documents.digest == rows._digest)
    joined = documents.join(rows, same).select("node", "text_class", "text")
    # A repeated row gives its node twice.
    return joined.mapInArrow(run, "node long, kmers binary").dropDuplicates(["node"])


def _stars(buckets: DataFrame) -> DataFrame:
    """``centre, node``: every member of a bucket with the bucket's best known member.

    That is the node whose buckets have the most members, most likely the text that the
    others were made from.
    """
    known = buckets.groupBy("node").agg(F.sum("size").alias("known"))
    ranked = buckets.select("bucket", "node").join(known, "node")
    centres = ranked.groupBy("bucket").agg(F.max_by("node", F.struct("known", -F.col("node"))).alias("centre"))
    return buckets.join(centres, "bucket").where("node != centre").select("centre", "node").distinct()


def _verify_stars(stars: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The ``a, b`` of ``stars(centre, node)`` that are similar. A task holds the k-mers of
    one centre while its nodes stream past; a large star is dealt to several tasks."""
    sizes = stars.groupBy("centre").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    rows = stars.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = rows.select("centre", "part", "node").unionByName(centres.withColumn("node", F.col("centre")))
    shipped = (
        wanted.join(members, "node")
        .select("centre", "part", (F.col("node") != F.col("centre")).alias("other"), "node", "kmers")
        .repartition("centre", "part")
        .sortWithinPartitions("centre", "part", "other")
    )

    def compare(batches):
        own = None
        for batch in batches:
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("centre", "other", "node", "kmers"))
            for centre, other, node, data in zip(*columns):
                found = np.frombuffer(data, np.uint32)
                if not other:
                    own = found
                elif similarity(own, found, threshold) >= threshold:
                    a.append(centre)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return shipped.mapInArrow(compare, "a long, b long")


def spanning_links(
    nodes: list[int], groups: list[int], texts: list[np.ndarray], threshold: float, sides: list[bool] | None = None
) -> list[tuple[int, int]]:
    """Similar pairs that connect different ``groups``, no more than needed to connect all.

    Shared k-mers are counted through an inverted index, which bounds the similarity from
    above; only pairs of groups that are still apart are aligned. With ``sides`` only pairs
    of a text of one side and one of the other count.
    """
    side = np.zeros(len(texts), bool) if sides is None else np.array(sides)
    asking, indexed = (np.arange(len(texts)), ~side) if sides is None else (np.flatnonzero(~side), side)
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    _, term = np.unique(flat, return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    by_term = by_term[indexed[owner[by_term]]]
    posting = owner[by_term]
    first = np.searchsorted(term[by_term], np.arange(term.max() + 2))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    _, group = np.unique(np.array(groups), return_inverse=True)
    out = []
    for x in asking.tolist():
        if (group == group[0]).all():
            break
        terms = term[starts[x] : starts[x + 1]]
        size = first[terms + 1] - first[terms]
        at = np.repeat(first[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        shared = np.bincount(posting[at], minlength=len(texts))
        bound = shared / np.maximum(1, lengths + lengths[x] - shared)
        later = indexed if sides is not None else np.arange(len(texts)) > x
        for y in np.flatnonzero(later & (bound >= threshold - 1e-9) & (group != group[x])):
            if group[y] != group[x] and similarity(texts[x], texts[y], threshold) >= threshold:
                out.append((nodes[x], nodes[y]))
                group[group == group[y]] = group[x]
    return out


def _remaining(buckets: DataFrame, group: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links inside buckets whose members the stars have left in different groups.

    Of buckets with the same members one is enough. A bucket of many texts is split into
    blocks, and each pair of blocks is one task's group.
    """
    rows = buckets.select("bucket", "node").join(group, "node")
    apart = (
        rows.groupBy("bucket")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count("*").alias("size"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s1"),
            F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("s2"),
        )
        .where("low != high")
        .groupBy("size", "s1", "s2")
        .agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = (
        rows.join(apart.select("bucket", blocks.alias("blocks")), "bucket")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q"), "mine", "node", "root")
    )
    shipped = dealt.join(members, "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def compare(batches):
        key, held = None, ([], [], [], [])

        def links():
            # Pairs inside a block are those of the group of the block with itself.
            *texts, sides = held
            sides = sides if key and key[1] != key[2] else None
            found = spanning_links(*texts, threshold, sides) if len(texts[0]) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "p", "q", "mine", "node", "root", "kmers")]
            for bucket, p, q, mine, node, root, data in zip(*columns):
                if (bucket, p, q) != key:
                    yield links()
                    key, held = (bucket, p, q), ([], [], [], [])
                held[0].append(node)
                held[1].append(root)
                held[2].append(np.frombuffer(data, np.uint32))
                held[3].append(mine != p)
        yield links()

    return shipped.select("bucket", "p", "q", "mine", "node", "root", "kmers").mapInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False
) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row of ``df``; on request ``text_sha256``,
    which with the id names a row.

    Classes are the connected components of the texts whose runs of five words have an
    aligned similarity of at least ``threshold`` (:func:`similarity`); ``class_id`` is the
    smallest id of a class. Words are runs of letters and digits, ASCII letters without
    case. Texts of fewer than five words are one run; texts without words, also null and
    empty ones, are alike only if they are equal. Texts with equal words are compared once.
    Rows that repeat an id and a text are in one class; null ids are kept as rows and name a
    class only if no other id is in it. ``kept`` marks the row with the class's id, of several
    texts with that id the one of the smallest digest; rows that repeat it are marked alike.
    An empty table gives no rows, other columns are ignored.
    """
    documents = documents_of(df, id_col, text_col).withColumn("digest", F.sha2("text", 256))
    signed = scratch(_signatures(documents), "signatures")
    # The smallest id, null last, and of its texts the one of the smallest digest.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest"))
    classes = scratch(
        signed.groupBy("text_class")
        .agg(first_row.alias("row"), F.count("*").alias("n"), F.first("sketches").alias("sketches"))
        .select("text_class", "row.doc_id", "row.digest", "n", "sketches")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    exploded = classes.select("node", F.posexplode("sketches").alias("j", "value")).select(
        F.struct("j", "value").alias("bucket"), "node"
    )
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = scratch(exploded.join(sizes, "bucket"), "buckets")
    stars = scratch(_stars(buckets), "stars")
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "digest", "text_class")
    members = scratch(_kmers_of(documents, wanted), "members")
    links = scratch(_verify_stars(stars, members, threshold), "star-links")
    groups = connected_components(links)
    nodes = buckets.select("node").distinct()
    group = nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    more = scratch(_remaining(buckets, group, members, threshold), "more-links")
    roots = connected_components(links.unionByName(more))
    named = classes.join(roots, "node", "left").select(
        "text_class", "doc_id", "digest", "n", F.coalesce("root", "node").alias("root")
    )
    by_root = named.groupBy("root").agg(first_row.alias("first"), F.sum("n").alias("class_size"))
    by_class = named.join(by_root, "root").select("text_class", "first", "class_size")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return signed.join(by_class, "text_class").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        kept.alias("kept"),
        *([F.col("digest").alias("text_sha256")] if with_digest else []),
    )

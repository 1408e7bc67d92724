"""Ranked lexical search of many items at once, by two trees.

Items and documents are vectors over the terms of the items: how often an item holds a term,
and what a document scores for one occurrence. A score is their product. Both sides form
hierarchies whose nodes hold the largest coordinate of what lies below, so the product of two
nodes bounds every score of an item below the one with a document below the other. A pair of
nodes is left out if its bound is below the weakest kth score of the node's items; what is
left is scored exactly. Items go through all documents in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces, scratch
from ampledger.llm.words import ALNUM, word_spans

#: Expected size of a block of items. Its terms, at most half as many as its bytes, and its
#: vectors are what each task is given.
BLOCK_ITEMS, BLOCK_BYTES = 256, 128 << 10
#: Documents below a lowest node, and nodes below a higher one.
LEAF, FAN = 16, 4
#: Bytes of the vectors of the documents that form one tree.
TREE_BYTES = 32 << 20
#: A sum of products is exact in doubles below this.
EXACT = 2**53

VECTORS = "doc_id long, n long, terms binary, counts binary"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, A-Z lower-cased, and how many stand before each text
    (one more entry than texts). Texts must not be null."""
    data, starts, ends, before = word_spans(texts, ALNUM)
    offsets = np.append(0, np.cumsum(ends - starts))
    inside = np.ascontiguousarray(data[ALNUM[data]])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)]
    )
    return words, before


def order_by_heaviest(vectors: np.ndarray) -> np.ndarray:
    """An order in which vectors with the same heaviest coordinates are neighbours."""
    if not vectors.shape[1]:
        return np.arange(len(vectors))
    heaviest = np.argmax(vectors, axis=1)
    return np.lexsort((vectors[np.arange(len(vectors)), heaviest], heaviest))


def maxima(vectors: np.ndarray, width: int) -> np.ndarray:
    """The largest coordinates of every ``width`` vectors in a row."""
    return np.maximum.reduceat(vectors, np.arange(0, len(vectors), width), axis=0)


class Items:
    """A block of items as a tree; ``vocabulary`` are its terms, in the order of coordinates."""

    def __init__(self, texts: pa.Array) -> None:
        words, before = terms_of(texts)
        encoded = words.dictionary_encode()
        self.vocabulary = encoded.dictionary
        vectors = np.zeros((len(texts), len(self.vocabulary)), np.int64)
        rows = np.repeat(np.arange(len(texts)), np.diff(before))
        np.add.at(vectors, (rows, encoded.indices.to_numpy(zero_copy_only=False)), 1)
        self.numbers = order_by_heaviest(vectors)
        self.counts = vectors[self.numbers]
        self.levels: list[np.ndarray] = []

    def grow(self, weights: np.ndarray) -> None:
        """Build the hierarchy, in doubles if all its products stay exact."""
        largest = max((sum(int(c) * int(w) for c, w in zip(row, weights)) for row in self.counts), default=0) * 10**6
        self.levels = [self.counts.astype(np.float64 if largest < EXACT else np.int64)]
        while len(self.levels[-1]) > 1:
            self.levels.append(maxima(self.levels[-1], FAN))


@dataclass
class Corpus:
    """What a score needs besides the document: number of documents with a term, all their
    terms, and the weight of each term of the block."""

    documents: int
    length: int
    weights: np.ndarray

    def vectors(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, dtype: type) -> np.ndarray:
        if self.documents * 75 * int(n.max(initial=0)) < 2**63:
            middle = 25 + (75 * n * self.documents) // self.length
        else:
            middle = np.array([25 + 75 * int(x) * self.documents // self.length for x in n], np.int64)
        out = np.zeros((len(n), len(self.weights)), dtype)
        out[row, term] = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * middle[row]))
        return out


class Best:
    """The ``k`` best documents of every item so far; none below ``floor`` is wanted."""

    def __init__(self, items: Items, k: int, floor: np.ndarray) -> None:
        self.k, self.rows = k, [[] for _ in floor]
        self.sizes = [len(level) for level in items.levels]
        self.weakest = [floor.copy()]
        self._climb()

    def _climb(self) -> None:
        del self.weakest[1:]
        for size in self.sizes[1:]:
            below = self.weakest[-1]
            self.weakest.append(np.minimum.reduceat(below, np.arange(0, len(below), FAN)))
            assert len(self.weakest[-1]) == size

    def add(self, items: np.ndarray, ids: list, scores: np.ndarray) -> None:
        """``scores`` of ``items`` (rows) and documents (columns). Ties go to the smaller id,
        a null id comes last."""
        own = self.weakest[0]
        enough = scores >= own[items][:, None]
        rows = np.flatnonzero(enough.any(axis=1))
        for row in rows.tolist():
            item = int(items[row])
            new = [(-int(scores[row, d]), ids[d] is None, ids[d] or 0) for d in np.flatnonzero(enough[row]).tolist()]
            self.rows[item] = sorted(self.rows[item] + new)[: self.k]
            if len(self.rows[item]) == self.k:
                own[item] = max(own[item], -self.rows[item][-1][0])
        if len(rows):
            self._climb()


def search(items: Items, ids: list, vectors: np.ndarray, best: Best) -> int:
    """Add the documents to ``best`` by a walk down both trees; the number of scores taken."""
    order = order_by_heaviest(vectors)
    vectors, ids = vectors[order], [ids[i] for i in order.tolist()]
    levels = [maxima(vectors, LEAF)]
    while len(levels[-1]) > 1:
        levels.append(maxima(levels[-1], FAN))
    promise = [level.sum(axis=1) for level in levels]
    scored = 0
    open_pairs = [(len(levels) - 1, 0, len(items.levels) - 1, np.arange(len(items.levels[-1])))]
    while open_pairs:
        level, node, height, nodes = open_pairs.pop()
        bounds = items.levels[height][nodes] @ levels[level][node]
        nodes = nodes[bounds >= best.weakest[height][nodes]]
        if not len(nodes):
            continue
        if height:
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = below[below < len(items.levels[height - 1])]
        if level:
            children = np.arange(node * FAN, min((node + 1) * FAN, len(levels[level - 1])))
            # The most promising is taken first, that is, put on top.
            for child in children[np.argsort(promise[level - 1][children], kind="stable")].tolist():
                open_pairs.append((level - 1, child, max(height - 1, 0), nodes))
        elif height:
            open_pairs.append((0, node, height - 1, nodes))
        else:
            part = slice(node * LEAF, (node + 1) * LEAF)
            best.add(nodes, ids[part], items.levels[0][nodes] @ vectors[part].T)
            scored += len(nodes) * len(ids[part])
    return scored


def term_vectors(docs: DataFrame, vocabulary: pa.Array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its number of terms ``n``, and numbers and counts of those of the
    vocabulary, as 32-bit integers in a row."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in pieces(batches, "text"):
            words, before = terms_of(batch.column("text"))
            number = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), np.diff(before))
            known = number >= 0
            cells, counts = np.unique(row[known] * size + number[known], return_counts=True)
            edges = np.searchsorted(cells, np.arange(len(batch) + 1) * size) * 4
            columns = [(cells % size).astype("<i4").tobytes(), counts.astype("<i4").tobytes()]
            lists = [pa.array([c[a:b] for a, b in zip(edges, edges[1:])], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(before), pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"]
            )

    return documents_of(docs, id_col, text_col).mapInArrow(vectors, VECTORS)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every cell of a batch."""
    lists = [batch.column(c).to_pylist() for c in ("terms", "counts")]
    row = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in lists[0]])
    term, tf = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in lists)
    return row, term, tf


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of a block: added up in tasks, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            df += np.bincount(term, minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], names=["term", "df"])

    rows = vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for term, df in rows.collect():  # at most as many as terms in a block
        out[term] = df
    return out


def _candidates(vectors: DataFrame, items: Items, corpus: Corpus, k: int, floor: np.ndarray, first_only: bool) -> DataFrame:
    """The best documents of each item in each task, none below ``floor``; of the first tree
    of each task alone if so wished."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((items, corpus, floor))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, floor = shared.value
        best = Best(items, k, floor)
        dtype = items.levels[0].dtype.type
        at_once = max(LEAF, TREE_BYTES // (8 * max(len(corpus.weights), 1)))
        for piece in (b.slice(at, at_once) for b in batches for at in range(0, len(b), at_once)):
            row, term, tf = _unpacked(piece)
            documents = corpus.vectors(piece.column("n").to_numpy(), row, term, tf, dtype)
            search(items, piece.column("doc_id").to_pylist(), documents, best)
            if first_only:
                break
        rows = [(int(items.numbers[i]), None if null else key, -s) for i, found in enumerate(best.rows) for s, null, key in found]
        columns = zip(*rows) if rows else ([], [], [])
        types = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "doc_id", "score"])

    found = vectors.where(F.length("terms") > 0).mapInArrow(find, "item int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: pa.Array, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """``item`` (place in the block), ``doc_id``, ``score``, ``rank`` of one block of items."""
    items = Items(texts)
    if not len(items.vocabulary):
        return None
    vectors = scratch(term_vectors(docs, items.vocabulary, id_col, text_col), "term-vectors")
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    if not sums["length"]:
        return None
    df = _document_frequencies(vectors, len(items.vocabulary))
    weights = [math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * int(x) + 1))) for x in df]
    corpus = Corpus(sums["documents"], sums["length"], np.array(weights, np.int64))
    items.grow(corpus.weights)
    # The kth score among some documents is a floor for that among all.
    floor = np.ones(len(texts), items.levels[0].dtype)
    place = np.empty(len(texts), np.int64)
    place[items.numbers] = np.arange(len(texts))
    first = _candidates(vectors, items, corpus, k, floor, first_only=True)
    for row in first.where(F.col("rank") == k).collect():  # at most one per item of the block
        floor[place[row["item"]]] = row["score"]
    return _candidates(vectors, items, corpus, k, floor, first_only=False)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item among all documents, with integer scores.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
    lower-cased. The score adds, over the item's terms with repeats, a weight that falls with
    the number of documents holding the term, times a share that rises with its occurrences
    and falls with the document's length. Only scores above 0 count. Equal scores are ranked
    by ascending id, a null id last. The result is exact.

    Items that agree in id and text are one item; the same id with another text is another
    item with ranks of its own. Null, empty and blank items find nothing. Each row of ``docs``
    is a document; null, empty and blank ones are never found and do not count. Repeated rows
    are found as often as they stand there. Other columns are not read. Empty tables give an
    empty result.

    Documents are read once and their vectors scanned three times for each block of about
    256 items.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    results = []
    for number in range(blocks):
        part = (rows.where(block == number) if blocks > 1 else rows).toArrow()
        texts = part.column("text").combine_chunks()
        found = _search_block(docs, texts, k, id_col, text_col) if len(texts) else None
        if found is not None:
            names = pa.table({"item": pa.array(range(len(texts)), pa.int32()), "item_id": part.column("item_id")})
            named = found.join(F.broadcast(spark.createDataFrame(names)), "item")
            results.append(named.select("item_id", "rank", "doc_id", "score"))
    if not results:
        none = rows.where(F.lit(False))
        return none.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    # Blocks are written one by one, so that the plan does not grow with their number.
    out = results[0] if len(results) == 1 else scratch(results[0], "ranked")
    for more in results[1:]:
        out = out.unionByName(scratch(more, "ranked"))
    return out

"""Periodic runs of words: stretches that repeat themselves at least three times.

Every pair of positions ``i, i + p`` on a grid is extended to both sides by longest common
extensions on the grammar of the words. A run of period ``p`` is long enough to hold a pair
of the grid of ``p``, so no run is missed, and the number of pairs is that of a harmonic sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces
from ampledger.llm.recompression import common_extensions, mirrored, recompress

#: A run has at least this many words and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Text that is parsed into one grammar, and pairs of positions that are extended together.
GRAMMAR_BYTES, PAIRS = 2 << 20, 1 << 19

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of (document, start, length, smallest period), in this order, of all runs.

    ``words`` are the numbers of the words of all documents, ``before[d]`` how many stand
    before document ``d`` (one more entry than documents). Starts count from 0 in a document.
    """
    size = np.diff(before)
    n_docs = len(size)
    # A boundary stands before each document and behind the last one.
    place = np.arange(len(words)) + np.repeat(np.arange(1, n_docs + 1), size)
    symbols = np.zeros(len(words) + n_docs + 1, np.int64)
    edges = before + np.arange(n_docs + 1)
    symbols[edges] = -1 - np.arange(n_docs + 1)
    symbols[place] = words
    forward = recompress(symbols)
    backward = mirrored(forward)

    # One row per document and period, then one per pair of positions.
    periods = np.where(size >= LEAST_WORDS, size // LEAST_PERIODS, 0)
    doc = np.repeat(np.arange(n_docs), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    # Inside a run, so many pairs in a row are equal; the grid is as wide.
    wide = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
    pairs = (size[doc] - period + wide - 1) // wide
    total = np.append(0, np.cumsum(pairs))
    found = [np.zeros((0, 4), np.int64)]
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        row = np.repeat(np.arange(at, to), pairs[at:to])
        p = period[row]
        i = edges[doc[row]] + 1 + (np.arange(len(row)) + total[at] - total[row]) * wide[row]
        keep = symbols[i] == symbols[i + p]
        row, i, p = row[keep], i[keep], p[keep]
        after = common_extensions(forward, i, i + p)
        last = len(symbols) - 1
        ahead = common_extensions(backward, last - (i + p - 1), last - (i - 1))
        length = ahead + after + p
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        start = i - ahead - edges[doc[row]] - 1
        found.append(_smallest(np.stack([doc[row], start, length, p], axis=1)[keep]))
        at = to
    return _smallest(np.concatenate(found))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches, the one of the smallest period; by document, start and period."""
    order = np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1))[: len(runs)]
    runs = runs[first]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    arrange: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """All periodic runs of words of each document, and its text without the repeats.

    A run has at least 24 words and three times its smallest period, and no neighbouring word
    continues it. ``collapsed`` holds the words, joined by one space, that no run contains
    after its first period. Words are what stands between ASCII white space.

    ``arrange(id, n)`` may give the order in which the ``n`` words of a document are to be
    read, as word numbers; None leaves them as they are.

    One row per row of ``docs``: rows with a null or repeated id are documents of their own. A
    null, empty or blank text has no words, no runs and an empty collapsed text. Other columns
    are not read. An empty table gives an empty one. Every document is handled whole by one
    task, which needs some 150 bytes for a word of it.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", GRAMMAR_BYTES):
            ids = batch.column("doc_id").to_pylist()
            texts = [text.as_buffer().to_pybytes().split() for text in batch.column("text").cast(pa.large_binary())]
            if arrange is not None:
                for d, (key, text) in enumerate(zip(ids, texts)):
                    order = arrange(key, len(text))
                    if order is not None:
                        texts[d] = [text[i] for i in order.tolist()]
            before = np.cumsum([0, *map(len, texts)])
            flat = pa.array([word for text in texts for word in text], pa.large_binary())
            numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = find_runs(numbers, before)
            lists: list[list[dict]] = [[] for _ in texts]
            drop: dict[int, np.ndarray] = {}
            for d, start, length, period in found.tolist():
                lists[d].append({"start": start, "length": length, "period": period})
                drop.setdefault(d, np.zeros(len(texts[d]), bool))[start + period : start + length] = True
            for d, gone in drop.items():
                texts[d] = [texts[d][i] for i in np.flatnonzero(~gone).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array(lists, pa.list_(RUN)),
                    pa.array([b" ".join(text) for text in texts], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents_of(docs, id_col, text_col).mapInArrow(runs, SCHEMA)


def summary(runs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run that repeats most often, digests.

    Length over period is compared exactly; ties go to the smallest start, then period.
    """
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda old, new: F.when(
            old.isNull() | (new["length"] * old["period"] > old["length"] * new["period"]), new
        ).otherwise(old),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that makes one document in ten periodic from some word on. A null
    id has no decimal digits and changes nothing."""
    from zlib import crc32

    if doc_id is None or n == 0:
        return None
    g, chosen = divmod(crc32(str(doc_id).encode()), 10)
    if chosen:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order

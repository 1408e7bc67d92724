"""Packing documents into sequences: exact complements first, then best fit.

What is planned are lengths, not documents: the plan sees how many pieces there are of each
length, at most ``width`` numbers whatever the size of the corpus, and says how often each
pattern of lengths is packed. Pieces then find their places by their rank among the pieces
of their length, in a join with that plan.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.llm.common import documents_of, pieces, scratch, worker_cache

END = 0
#: Pieces of one length per hash range; ranks are counted inside ranges and shifted.
RANGE_ROWS = 16_384
#: Words whose ids a Python worker remembers: some 20 MB, held as long as the worker lives.
#: Frequent words come early; remembering 600,000 took no less time.
CACHE_WORDS = 100_000


#: Spacing that is not one space between visible characters or a line end inside a run.
ODD_SPACING = ["  ", " \n", "\n ", "\0", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")]


class Encoder:
    """Ids of whole texts as a ``tokenizers`` file gives them, by words.

    With a rank file of the same vocabulary, runs between single spaces are encoded once and
    remembered: byte-level merges never cross the border before a space that follows a
    visible character. Texts with other spacing are encoded whole, and texts that may hold a
    special string by ``tokenizers`` itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as file:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            self.unit = self.fast._core_bpe.encode_single_piece

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        if not text or text[0] == " " or text[-1] == " " or any(x in text for x in ODD_SPACING):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        keys = text.replace(" ", "\0 ").split("\0")
        found = list(map(self.words.get, keys))
        if None in found:
            word = self._word
            found = [word(key) if ids is None else ids for key, ids in zip(keys, found)]
        return np.frombuffer(b"".join(found), "<u4")

    def _word(self, key: str) -> bytes:
        """Ids of a run without inner spaces. Letters are one unit of the pattern, and so is
        a comma or full stop behind them; merges stay inside units."""
        letters = key[1:] if key[0] == " " else key
        if letters.isalpha():
            ids = self.unit(key.encode())
        elif letters[-1] in ",." and letters[:-1].isalpha():
            ids = self.unit(key[:-1].encode()) + self.unit(letters[-1].encode())
        else:
            ids = self.fast.encode_ordinary(key)
        out = array("I", ids).tobytes()
        if len(self.words) < CACHE_WORDS:
            self.words[key] = out
        return out


def _encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    held = worker_cache("encoder")
    if path not in held:
        held[path] = Encoder(path, ranks, pattern)
    return held[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _copy long"


def cut(
    df: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    width: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``width`` ids of every document, its end id included.

    Only longer documents are cut, so that all pieces but the first have full width.
    ``_copy`` is a hash of the text, to tell rows that repeat an id apart.
    """

    def run(batches):
        encode = _encoder(tokenizer, ranks, pattern)
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "_copy")])
            for doc_id, text, copy in rows:
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                first = len(ids) % width or width
                at = 0
                for number, end in enumerate(range(first, len(ids) + 1, width)):
                    out.append((doc_id, number, at, end - at, zlib.crc32(ids[at:end].tobytes()), copy))
                    at = end
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_copy"],
            )

    rows = documents_of(df, id_col, text_col).withColumn("_copy", F.xxhash64("text"))
    return rows.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fit into ``width``, and how many sequences follow each.

    ``counts`` says how many pieces there are of each length. From the longest length
    down, the gap it leaves is looked up among the single lengths, then among the sums of
    pairs, then of triples; the longest parts come first, and a combination is used as
    often as its lengths are available. What has no exact complement is packed best fit, the
    longest first into the smallest gap that holds it.
    """
    have = np.zeros(width + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    out: Counter = Counter()

    def pair(gap: int) -> tuple[int, int] | None:
        """The pair with the longest part whose sum is ``gap``."""
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        fit = (have[high] > 0) & (have[gap - high] > 0) & ((high * 2 != gap) | (have[high] > 1))
        at = int(fit.argmax()) if len(fit) else 0
        return (int(high[at]), gap - int(high[at])) if len(fit) and fit[at] else None

    def complement(gap: int) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        if have[gap] > 0:
            return (gap,)
        if two := pair(gap):
            return two
        for longest in np.flatnonzero(have[: gap - 1])[::-1]:
            longest = int(longest)
            if longest * 3 < gap:
                return None
            have[longest] -= 1
            two = pair(gap - longest)
            have[longest] += 1
            if two:
                return (longest, *two)
        return None

    left: list[tuple[int, int]] = []
    for length in range(width, 0, -1):
        while have[length] > 0:
            have[length] -= 1
            parts = complement(width - length)
            have[length] += 1
            if parts is None:
                left.append((length, int(have[length])))
                have[length] = 0
                break
            pattern = Counter((length, *parts))
            times = min(int(have[x]) // k for x, k in pattern.items())
            for x, k in pattern.items():
                have[x] -= times * k
            out[length, *parts] += times
    # Best fit: open sequences with the same contents are one entry.
    by_gap: dict[int, dict[tuple[int, ...], int]] = {}
    gaps = np.zeros(width + 1, dtype=bool)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = width - sum(pattern)
        entry = by_gap.setdefault(gap, {})
        entry[pattern] = entry.get(pattern, 0) + times
        gaps[gap] = True

    for length, n in left:
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if not len(fitting):
                # As many to a sequence as fit, the rest opens one more.
                each = width // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = int(fitting[0]) + length
            pattern, times = next(iter(by_gap[gap].items()))
            used = min(times, n)
            if used == times:
                del by_gap[gap][pattern]
                gaps[gap] = bool(by_gap[gap])
            else:
                by_gap[gap][pattern] = times - used
            put((*pattern, length), used)
            n -= used
    for entry in by_gap.values():
        for pattern, times in entry.items():
            out[pattern] += times
    return list(out.items())


PLACES = T.StructType(
    [
        T.StructField("length", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("from", "to", "first", "offset")]))),
    ]
)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: ranks ``from`` to ``to`` go to sequences from ``first`` on, at ``offset``."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def _arrow(found: dict[int, list[tuple[int, int, int, int]]]) -> pa.Table:
    place = pa.struct([(c, pa.int64()) for c in ("from", "to", "first", "offset")])
    spans = [[dict(zip(("from", "to", "first", "offset"), span)) for span in spans] for spans in found.values()]
    return pa.table({"length": pa.array(found, pa.int64()), "places": pa.array(spans, pa.list_(place))})


def ranked(parts: DataFrame) -> DataFrame:
    """``parts(length, ...)`` with ``rank``, from 0 among the pieces of a length.

    Pieces of a length are dealt into hash ranges of some thousand rows, so that a length
    that half of all pieces have is ranked in many tasks.
    """
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "_copy")
    sizes = parts.groupBy("length").agg(F.ceil(F.count("*") / RANGE_ROWS).alias("_ranges"))
    # At most one row for each length.
    dealt = parts.join(F.broadcast(sizes), "length").withColumn("_range", F.pmod(key, F.col("_ranges")))
    counts = dealt.groupBy("length", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "length", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before")
    )
    inside = Window.partitionBy("length", "_range").orderBy("doc_id", "piece", "ids_crc32", "_copy")
    return (
        dealt.withColumn("_at", F.row_number().over(inside))
        .join(shifts, ["length", "_range"])
        .withColumn("rank", F.col("_before") + F.col("_at") - 1)
        .drop("_ranges", "_range", "_before", "_at")
    )


def packed(parts: DataFrame, width: int = 2048) -> DataFrame:
    """Pieces as :func:`cut` gives them with their ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    parts = scratch(parts, "pieces")
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}  # at most width rows
    found = places(plan(counts, width))
    # As Arrow data, since rows of Python objects would start more workers on every executor.
    table = spark.createDataFrame(_arrow(found), PLACES)
    # Bounded by the plan: some places for each of at most width lengths.
    placed = ranked(parts).join(F.broadcast(table), "length")
    place = F.filter("places", lambda p: (F.col("rank") >= p["from"]) & (F.col("rank") < p["to"]))[0]
    return placed.withColumn("_place", place).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_place.first") + F.col("rank") - F.col("_place.from")).alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
    )


def pack(df: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, width: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    A null or empty text is one piece with the end id alone. Null ids are kept; rows that
    repeat an id are packed each for itself, equal rows are interchangeable. An empty table
    gives no sequences. Other columns are ignored.
    """
    return packed(cut(df, tokenizer, ranks, pattern, width), width)

"""Similarity join of vectors by epsilon grid order.

Unit vectors are turned onto the principal axes of their covariance. Distances in the
leading axes never exceed distances in all of them, so two sequence intervals whose boxes in
those axes are farther apart than the radius hold no pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.llm.common import bound_batches, scratch
from ampledger.operators.components import connected_components

#: Principal axes whose grid cells order the vectors, and axes in which boxes are compared.
GRID_AXES = 4
BOX_AXES = 16
#: Vectors of one sequence interval at the lowest level, if they are not longer than ``BLOCK_BYTES``.
BLOCK = 8192
BLOCK_BYTES = 2 << 20
#: Intervals that one interval of the next level holds.
FAN = 8
#: Groups of intervals that are compared as a whole first, and groups on the left side of one job.
GROUPS = 512
ROW = 64
#: Intervals of each side that one task compares.
TASK = 16
#: Rows and columns of a product that is looked at as a whole.
PIECE = 512
#: Links that a task holds before it replaces them by stars.
EDGES = 1 << 20


def usable(embedding: str, dim: int) -> str:
    """SQL condition: as long as the others, without null or non-finite components, not zero."""
    return (
        f"size({embedding}) = {dim} AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x)"
        f" AND abs(x) < double('Infinity')) AND exists({embedding}, x -> x <> 0)"
    )


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column, one per row, as they are stored."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bytes(column: pa.Array, kind: np.dtype, dim: int) -> np.ndarray:
    """Vectors of a binary column, one per row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of every row of an array."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes (columns), the widest first, and the variances along them, from sums
    over all ``vectors(embedding)``."""

    def sums(batches):
        total = np.zeros((dim + 2, dim))
        for batch in batches:
            x = unit(_raw(batch.column("embedding"), dim))
            total[:dim] += x.T @ x
            total[dim] += x.sum(axis=0)
            total[dim + 1] += len(x)
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    rows = vectors.select("embedding").mapInArrow(sums, "cell int, value double")
    found = {r.cell: r.value for r in rows.groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    total = np.zeros((dim + 2, dim))
    for cell, value in found.items():
        total[divmod(cell, dim)] = value
    n = max(1, total[dim + 1, 0])
    covariance = total[:dim] / n - np.outer(total[dim], total[dim]) / n / n
    spread, axes = np.linalg.eigh(covariance)
    return axes[:, ::-1].copy(), np.maximum(0, spread[::-1])


def sketch_axes(spread: np.ndarray, radius: float) -> int:
    """How many leading axes tell nearly all pairs of vectors apart.

    Squared distances along the axes have the mean ``2 s`` and the variance ``8 s s`` each if
    vectors were normal. The number decides about time only, never about a pair.
    """
    for k in range(8, len(spread), 8):
        if 2 * spread[:k].sum() - 3 * math.sqrt(8 * (spread[:k] ** 2).sum()) >= radius**2:
            return k
    return len(spread)


def block_rows(dim: int, kind: np.dtype) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (dim * kind.itemsize)))


def blocks(vectors: DataFrame, axes: np.ndarray, radius: float) -> DataFrame:
    """``vectors(vec_id, embedding)`` cut into intervals of the epsilon grid order.

    One row per interval: ``part``, ``at``, its distinct vectors and numbers of copies as
    bytes, and its box ``low``, ``high``. Vectors of a part are numbered from 0; rows of their
    own, without vectors, say which ``ids`` have which numbers (``seqs``). A vector is shuffled
    once: equal ones of a batch go together, those of several batches meet in the order. Equal
    grid cells are told apart by the first axis and a hash, so that a crowded cell is dealt to
    several tasks. (Equal vectors that are not found equal here are still linked later on.)
    """
    dim = axes.shape[0]
    kind = np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType == T.FloatType() else np.float64)
    grid, box, size = min(GRID_AXES, dim), min(BOX_AXES, dim), block_rows(dim, kind)

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw = _raw(batch.column("embedding"), dim)
            tie = batch.column("tie").to_numpy()
            _, first, of = np.unique(tie, return_index=True, return_inverse=True)
            own = np.where((raw[first[of]] == raw).all(axis=1), first[of], np.arange(len(raw)))
            keep, copies = np.unique(own, return_counts=True)
            ids = batch.column("vec_id").take(pa.array(np.argsort(own, kind="stable")))
            ends = np.concatenate([[0], np.cumsum(copies)]).astype(np.int32)
            raw, tie = raw[keep], tie[keep]
            p = unit(raw) @ axes[:, :grid]
            # Bytes that are ordered like cells, first axis and hash.
            cells = (np.floor(p / radius).astype(np.int32).astype(np.int64) + (1 << 31)).astype(">u4")
            bits = p[:, 0].copy().view(np.uint64)
            bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)).astype(">u8")
            order = [np.ascontiguousarray(c).view(np.uint8).reshape(len(raw), -1) for c in (cells, bits, tie.astype(">i8"))]
            yield pa.RecordBatch.from_arrays(
                [_binary(np.concatenate(order, axis=1)), pa.ListArray.from_arrays(pa.array(ends), ids), _binary(raw)],
                names=["place", "ids", "vector"],
            )

    placed = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("tie")).mapInArrow(
        place, "place binary, ids array<long>, vector binary"
    )
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place").select("ids", "vector")
    names = ["at", "vectors", "copies", "low", "high", "seqs", "ids"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2]

    def cut(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # vectors and copies of whole or begun intervals
        at = waiting = nodes = 0
        last = None

        def row(*values):
            return pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array([v], k) for v, k in zip(values, kinds)], names=names
            )

        def write(end: int):
            nonlocal held, at, waiting
            x, copies = (np.concatenate(c) for c in zip(*held))
            for i in range(0, end, size):
                part = slice(i, min(i + size, end))
                p = unit(x[part]) @ axes[:, :box]
                yield row(at, x[part].tobytes(), copies[part].tobytes(), p.min(axis=0), p.max(axis=0), None, None)
                at += 1
            held, waiting = [(x[end:], copies[end:])], waiting - end

        for batch in batches:
            if not len(batch):
                continue
            x = _bytes(batch.column("vector"), kind, dim)
            lists = batch.column("ids")
            copies = lists.value_lengths().to_numpy().astype(np.int64)
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]).any(axis=1)
            new[0] = last is None or bool((x[0] != last).any())
            last = x[-1].copy()
            seqs = nodes + np.cumsum(new) - 1
            nodes = int(seqs[-1]) + 1
            numbers, values = pa.array(np.repeat(seqs, copies)), lists.flatten()
            ends = pa.array([0, len(values)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (numbers, values)]
            yield row(-1, None, None, None, None, *lists)
            starts = np.flatnonzero(new)
            if not new[0]:
                held[-1][1][-1] += copies[: starts[0] if len(starts) else None].sum()
            if len(starts):
                held.append((x[starts], np.add.reduceat(copies, starts)))
                waiting += len(starts)
            if waiting > size:  # the last vector may have more copies
                yield from write((waiting - 1) // size * size)
        if waiting:
            yield from write(waiting)

    schema = (
        "at int, vectors binary, copies binary, low array<double>, high array<double>, seqs array<long>, ids array<long>"
    )
    return ordered.mapInArrow(cut, schema).withColumn("part", F.spark_partition_id())


def _apart(dims: int) -> str:
    """SQL: squared distance between the boxes of two intervals."""
    return " + ".join(f"pow(greatest(0D, a.low[{k}] - b.high[{k}], b.low[{k}] - a.high[{k}]), 2)" for k in range(dims))


def near_intervals(boxes: DataFrame, count: int, dims: int, radius: float) -> DataFrame:
    """Pairs ``a <= b`` of intervals of ``boxes(block, low, high)`` that may hold pairs.

    The sequence is joined with itself from the top: a pair of intervals is split into the
    pairs of their parts, and pairs whose boxes are provably too far apart go no further.
    """
    spark = boxes.sparkSession
    depth = 0
    while FAN**depth < count:
        depth += 1
    spread = [F.min(F.col("low")[k]).alias(f"l{k}") for k in range(dims)] + [
        F.max(F.col("high")[k]).alias(f"h{k}") for k in range(dims)
    ]
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for level in range(depth - 1, -1, -1):
        level_boxes = (
            boxes.groupBy(F.floor(F.col("block") / FAN**level).alias("i"))
            .agg(*spread)
            .select(
                "i",
                F.array(*[f"l{k}" for k in range(dims)]).alias("low"),
                F.array(*[f"h{k}" for k in range(dims)]).alias("high"),
            )
        )
        parts = F.sequence(F.lit(0), F.lit(FAN - 1))
        children = (
            pairs.withColumn("i", F.explode(parts))
            .withColumn("j", F.explode(parts))
            .select((F.col("a") * FAN + F.col("i")).alias("a"), (F.col("b") * FAN + F.col("j")).alias("b"))
            .where("a <= b")
            .alias("c")
        )
        pairs = (
            children.join(level_boxes.alias("a"), F.col("c.a") == F.col("a.i"))
            .join(level_boxes.alias("b"), F.col("c.b") == F.col("b.i"))
            .where(f"{_apart(dims)} <= {(radius * (1 + 1e-9)) ** 2!r}")
            .select("c.a", "c.b")
        )
    return pairs


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``n`` numbers over the links ``i, j``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_groups(held: DataFrame, total: int, dims: int, radius: float) -> tuple[int, dict[int, list[int]]]:
    """How many intervals a group has, and for every group those that may hold pairs with it."""
    span = FAN
    while math.ceil(total / span) > GROUPS:
        span *= FAN
    count = math.ceil(total / span)
    if count <= 1:
        return span, {0: [0]} if count else {}
    spread = [F.array(*[f(F.col(c)[k]) for k in range(dims)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    boxes = held.groupBy(F.floor(F.col("block") / span).alias("block")).agg(*spread)
    near: dict[int, list[int]] = {}
    for a, b in near_intervals(scratch(boxes, "boxes"), count, dims, radius).collect():  # at most GROUPS squared
        near.setdefault(a, []).append(b)
        if a != b:
            near.setdefault(b, []).append(a)
    return span, near


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row reachable from each row and from each column over the cells of ``near``;
    the number of rows for columns without cells."""
    none = np.int16(len(near))
    rows = np.arange(len(near), dtype=np.int16)
    while True:
        columns = np.where(near, rows[:, None], none).min(axis=0)
        new = np.minimum(rows, np.where(near, columns[None, :], none).min(axis=1))
        if (new == rows).all():
            return rows.astype(np.int64), columns.astype(np.int64)
        rows = new


class _Links:
    """What a task found: links of its nodes, copies counted, and edges that connect the same nodes."""

    def __init__(self):
        self.counts: dict[int, np.ndarray] = {}  # by the first node of an interval
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def count(self, start: int, n: int) -> np.ndarray:
        return self.counts.setdefault(start, np.zeros(n, np.int64))

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.size += len(a)
        if self.size > EDGES:
            self.edges = [self.stars()]
            self.size = len(self.edges[0][0]) // 2  # room for as many more

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """All nodes with edges, in order, and the smallest node that each is connected with."""
        a, b = (np.concatenate(c) for c in zip(*self.edges))
        nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
        return nodes, nodes[_components(len(nodes), of[: len(a)], of[len(a) :])]

    def rows(self):
        if not self.edges:
            return
        nodes, roots = self.stars()
        for start, n in self.counts.items():
            with_links = np.flatnonzero(n)
            own = start + with_links
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(n[with_links]), pa.array(roots[np.searchsorted(nodes, own)])],
                names=["node", "links", "root"],
            )


def linked(left: DataFrame, right: DataFrame, axes: np.ndarray, kind: np.dtype, threshold: float, k: int) -> DataFrame:
    """Links of the vectors of all pairs of an interval of ``left`` and one of ``right`` that may hold any.

    ``node, links, root``: how many vectors (copies counted) a node links to, and the smallest
    node it is connected with, among the intervals that a task compares. At most one row
    per node and task, however many links there are. Each task reads some intervals of both
    sides where they are stored: nothing is shuffled. The first interval of a side brings those of
    the other to Python, all further pairs are numbers. Of two intervals that both sides hold the
    sum of the numbers says on which side either is.

    Vectors are multiplied by their first ``k`` principal coordinates and the length of the rest in
    single precision. By the inequality of Cauchy and Schwarz that is no less than the cosine, so only
    pairs that reach the threshold within rounding are multiplied as a whole in double precision.
    """
    dim = axes.shape[0]
    size = block_rows(dim, kind)
    leading = axes[:, :k].copy()
    slack = 1.2e-7 * (k + 4)
    low = np.float32(threshold - slack)
    reach = 2 - 2 * threshold + 4 * slack + 1e-5
    radius = math.sqrt(2 - 2 * threshold) + 1e-7

    boxed = ["block", "copies", "vectors", "low", "high"]
    sums = "(a.block + b.block) % 2"
    once = f"(a.block = b.block OR (a.block < b.block AND {sums} = 0) OR (a.block > b.block AND {sums} = 1))"
    near = f"{_apart(min(BOX_AXES, dim))} <= {(radius * (1 + 1e-9)) ** 2!r}"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition
    left, right = (df.select(*boxed, first.alias("first")) for df in (left, right))
    brought = [F.expr(f"IF({o}.first, {s}.{c}, NULL) AS {c}_{s}") for s, o in ("ab", "ba") for c in ("copies", "vectors")]
    numbers = [F.expr(e) for e in ("a.block AS block_a", "b.block AS block_b", f"{once} AND {near} AS wanted")]
    either = F.expr(f"a.first OR b.first OR ({once} AND {near})")
    pairs = left.alias("a").join(right.alias("b").hint("shuffle_replicate_nl"), either).select(*numbers, *brought)

    def compare(batches):
        found = _Links()
        held: dict[str, dict[int, tuple]] = {"a": {}, "b": {}}  # one interval of the left, all of the right

        def side(batch, i, name):
            block = batch.column(f"block_{name}")[i].as_py()
            if block not in held[name]:
                raw = np.frombuffer(batch.column(f"vectors_{name}")[i].as_buffer(), kind).reshape(-1, dim).copy()
                copies = np.frombuffer(batch.column(f"copies_{name}")[i].as_buffer(), np.int64).copy()
                p = unit(raw) @ leading
                rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))
                sketch = np.concatenate([p, rest], axis=1).astype(np.float32)
                starts = np.arange(0, len(raw), PIECE)
                boxes = np.minimum.reduceat(sketch, starts), np.maximum.reduceat(sketch, starts)
                if name == "a":
                    held[name].clear()
                held[name][block] = block * size, raw, copies, sketch, *boxes
            return held[name][block]

        def tile(a, b, i, j):
            (first, x, n, u, *_), (other, y, m, v, *_) = a, b
            r, c = slice(i, i + PIECE), slice(j, j + PIECE)
            product = u[r] @ v[c].T
            if product.max() < low:
                return
            same = first == other and i == j
            of, to = np.nonzero(product >= low)
            if len(of) > product.size // 32:
                close = unit(x[r]) @ unit(y[c]).T >= threshold
                close = np.triu(close, 1) if same else close
                if not close.any():
                    return
                weights = close.astype(float)
                mine, others = weights @ m[c], n[r] @ weights
                rows, columns = _stars(close)
                of, to = np.flatnonzero(mine), np.flatnonzero(others)
                found.connect(first + i + of, first + i + rows[of])
                found.connect(other + j + to, first + i + columns[to])
            else:
                if same:
                    of, to = of[of < to], to[of < to]
                step = max(1, BLOCK_BYTES // (8 * dim))
                exact = [
                    np.einsum("ij,ij->i", unit(x[i + of[s : s + step]]), unit(y[j + to[s : s + step]])) >= threshold
                    for s in range(0, len(of), step)
                ]
                if not exact or not (exact := np.concatenate(exact)).any():
                    return
                of, to = of[exact], to[exact]
                mine = np.bincount(of, m[j + to], len(u[r]))
                others = np.bincount(to, n[i + of], len(v[c]))
                found.connect(first + i + of, other + j + to)
            found.count(first, len(x))[r] += mine.astype(np.int64)
            found.count(other, len(y))[c] += others.astype(np.int64)

        for batch in batches:
            for at in range(len(batch)):
                a, b = side(batch, at, "a"), side(batch, at, "b")
                if not batch.column("wanted")[at].as_py():
                    continue
                gap = np.maximum(0, np.maximum(a[4][:, None] - b[5][None], b[4][None] - a[5][:, None]))
                for i, j in np.argwhere((gap * gap).sum(axis=2) <= reach).tolist():
                    if a[0] != b[0] or i <= j:
                        tile(a, b, i * PIECE, j * PIECE)
        yield from found.rows()

    return pairs.mapInArrow(compare, "node long, links long, root long")


def copied(held: DataFrame, size: int) -> DataFrame:
    """``node, links, root`` of the vectors that have copies: each is linked with the others."""

    def count(batches):
        for batch in batches:
            for block, copies in zip(batch.column("block").to_pylist(), batch.column("copies").to_pylist()):
                n = np.frombuffer(copies, np.int64)
                at = np.flatnonzero(n > 1)
                nodes = pa.array(block * size + at)
                yield pa.RecordBatch.from_arrays([nodes, pa.array(n[at] - 1), nodes], names=["node", "links", "root"])

    return held.select("block", "copies").mapInArrow(count, "node long, links long, root long")


def _linked_vectors(good: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``vec_id, n_links, component_id`` of all rows of ``good``, whose vectors have one length.

    What is written follows the rows: every vector once in a shuffle and once in its interval,
    then numbers only.
    """
    spark = good.sparkSession
    bound_batches(spark)
    # Slightly wider than the radius, so that rounding never skips a pair at the threshold.
    radius = math.sqrt(2 - 2 * threshold) + 1e-7
    axes, spread = principal_axes(good, dim)
    cut = blocks(good, axes, radius)
    kind = np.dtype(np.float32 if good.schema["embedding"].dataType.elementType == T.FloatType() else np.float64)
    size, dims = block_rows(dim, kind), min(BOX_AXES, dim)
    held = scratch(cut, "blocks")
    sizes = {r.part: r["count"] for r in held.where("at >= 0").groupBy("part").count().collect()}  # a row per task
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    rows = held.where("at < 0").join(offsets, "part").selectExpr("start", "inline(arrays_zip(seqs, ids))")
    rows = rows.select(F.col("ids").alias("vec_id"), (F.col("start") * size + F.col("seqs")).alias("node"))

    def intervals(first: int, last: int) -> DataFrame:
        """Intervals from ``first`` to ``last`` in as many partitions as tasks of one side are to have."""
        at = [part for part, start in starts if start <= last and start + sizes[part] > first]
        within = held.where(f"at >= 0 AND part BETWEEN {min(at)} AND {max(at)}").join(offsets, "part")
        within = within.withColumn("block", F.col("start") + F.col("at")).where(f"block BETWEEN {first} AND {last}")
        few = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
        return within.coalesce(max(few, math.ceil((last - first + 1) / TASK)))

    links = []
    if total:
        whole = intervals(0, total - 1)
        span, near = near_groups(whole, total, dims, radius)
        k = sketch_axes(spread, radius)
        for row in range(0, max(near) + 1, ROW):
            others = sorted({b for a in range(row, row + ROW) for b in near.get(a, [])})
            left = intervals(row * span, min(total, (row + ROW) * span) - 1)
            right = intervals(others[0] * span, min(total, (others[-1] + 1) * span) - 1)
            right = right.where(F.floor(F.col("block") / span).isin(others))
            links.append(scratch(linked(left, right, axes, kind, threshold, k), "links"))
        links.append(copied(whole, size))
    found = spark.createDataFrame([], "node long, links long, root long")
    for part in links:
        found = found.unionByName(part)
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    counts = counts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = scratch(rows.join(counts, "node", "left").select("vec_id", "n_links", "root"), "marked")
    many = marked.where("root IS NOT NULL")
    names = many.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = marked.where("root IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return alone.unionByName(many.join(names, "root").select("vec_id", "n_links", "component_id"))


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    Two rows are linked if the cosine of their vectors, in double precision, is at least
    ``threshold`` (above 0). Equal vectors are compared once and counted by their number. Only
    vectors of one length have a cosine: every length that two or more rows have is joined on
    its own, one after the other. A vector that is null, zero, or holds null or non-finite
    components has no links; it is its own component. A null id is kept as a row and never
    names a component that has another id; rows that repeat an id are vectors of their own. An
    empty table gives no rows, other columns are ignored.
    """
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding"))
    sizes = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().where("count > 1")
    lengths = sorted(r.d for r in sizes.select("d").collect())  # one row per length
    out, compared = None, F.lit(False)
    for dim in lengths:
        good = rows.where(usable("embedding", dim))
        joined = _linked_vectors(good, dim, threshold)
        # More than one plan of this size would be planned anew for each length.
        joined = scratch(joined, "of-one-length") if len(lengths) > 1 else joined
        out = joined if out is None else out.unionByName(joined)
        compared = compared | F.coalesce(F.expr(usable("embedding", dim)), F.lit(False))
    alone = rows.where(~compared).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = alone if out is None else out.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

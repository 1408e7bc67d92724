"""How well labels separate: silhouette, Davies-Bouldin, Calinski-Harabasz, at any number of
rows and labels.

Rows of a label lie in blocks of at most ``BLOCK`` neighbouring points (Morton order); blocks
form a tree whose nodes know their centre, radius and moments. Label centres form a tree of
their own. Blocks walk down these trees together, one Spark join per level:

* The nearest other label of a point is sought among labels whose lower bound does not exceed
  the least upper bound (mean distance to a label lies between the distance to its centre and
  the root of the mean squared distance).
* For the silhouette, neighbouring rows of whatever labels form large groups. A group walks down
  the trees of its labels and gets the moments of far nodes and the points of near blocks, each
  once for all its rows. Inside a group, halves of its rows meet halves of the points: far ones
  by a Taylor series about both centres, near ones row by row.
* The truncated part of a series is at most ``2 / (2p + 1) * s^(p + 1) / (1 - s)^2`` of the
  distance for order ``p`` and radii / distance ``s``; what is beyond ``TOLERANCE`` is opened.
* The worst partner of a label is sought by bounds on (spread + spread) / distance.

No pair of rows is formed but between near blocks, and no table of labels leaves the executors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import finite, total
from ampledger.operators.grouped import attach, running_total
from ampledger.session import bounded, no_larger, row_bound, stored

#: Points in a block, labels in a block of labels, and nodes below a node.
BLOCK, LABEL_BLOCK, FAN = 128, 16, 16
#: Largest relative error of one distance.
TOLERANCE = 1e-8
#: Rows whose results are sent back together.
PARTS = 256
#: Rows of a group; a table of no more is dealt out in blocks. Labels summed together, and
#: tasks at most that share a group by its labels: it is as many times larger, so what it
#: meets is sent less often and a task has as much to do.
GROUP, COLUMNS, SHARED = 32_768, 32, 4
#: Rows and points in the smallest halves, distances and series held at once.
HALF, SLAB = 256, 1 << 19
MORTON_BITS = 62

NODE = "_l long, level int, idx long, n double, centre array<double>, radius double, low array<double>, high array<double>"


# ---- series of the distance ------------------------------------------------------


def remembered(function: Callable) -> Callable:
    """The function with its results kept. Unlike ``functools.cache`` it travels by value."""
    known: dict = {}

    def call(*key):
        if key not in known:
            known[key] = function(*key)
        return known[key]

    return call


def order_for(dimensions: int) -> int:
    """Order of the series: the more dimensions, the more moments an order costs."""
    return 12 if dimensions <= 2 else 6 if dimensions <= 3 else 4 if dimensions <= 6 else 2


@remembered
def indices(dimensions: int, order: int) -> tuple[tuple[int, ...], ...]:
    """All exponents of at most ``order``, by order."""
    every = itertools.product(range(order + 1), repeat=dimensions) if dimensions <= 6 else _few(dimensions, order)
    return tuple(sorted((a for a in every if sum(a) <= order), key=lambda a: (sum(a), a)))


def _few(dimensions: int, order: int) -> Iterator[tuple[int, ...]]:
    for size in range(order + 1):
        for chosen in itertools.combinations_with_replacement(range(dimensions), size):
            yield tuple(chosen.count(i) for i in range(dimensions))


@remembered
def products(dimensions: int, order: int) -> tuple[np.ndarray, ...]:
    """Places of exponents ``e`` and ``j`` and of ``e + j``, wherever that is of at most
    ``order``, with the binomial ``e + j`` over ``j`` and the sign of ``e``."""
    names = indices(dimensions, order)
    place = {a: i for i, a in enumerate(names)}
    found = []
    for i, e in enumerate(names):
        for k, j in enumerate(names):
            if sum(e) + sum(j) > order:
                break
            both = tuple(a + b for a, b in zip(e, j))
            found.append((i, k, place[both], math.prod(map(math.comb, both, j)), (-1) ** sum(e)))
    return tuple(np.array(c) for c in zip(*found))


def monomials(v: np.ndarray, order: int) -> np.ndarray:
    """All monomials of the rows of ``v``."""
    powers = v[:, :, None] ** np.arange(order + 1)
    names = np.array(indices(v.shape[1], order))
    out = powers[:, 0, names[:, 0]]
    for i in range(1, v.shape[1]):
        out *= powers[:, i, names[:, i]]
    return out


def moments(v: np.ndarray, w: np.ndarray, order: int) -> np.ndarray:
    """Weighted sums of all monomials of the rows of ``v``."""
    return w @ monomials(v, order)


def mover(by: np.ndarray, order: int) -> np.ndarray:
    """The matrix that takes moments to another centre, ``by`` = old centre - new one. Its
    transpose takes a series to a centre that lies at ``by`` from the old one."""
    e, j, both, binomial, _ = products(len(by), order)
    size = len(indices(len(by), order))
    out = np.zeros((size, size))
    out[both, j] = binomial * monomials(by[None, :], order)[0, e]
    return out


def shifted(sums: np.ndarray, by: np.ndarray, order: int) -> np.ndarray:
    """Moments about another centre, ``by`` = old centre - new one."""
    return mover(by, order) @ sums


def series(u: np.ndarray, order: int) -> np.ndarray:
    """Coefficients of ``|u - v|`` in the monomials of ``v``, for each row of ``u``.

    From ``q (v . grad g) = g (v . v - u . v)`` with ``g = sqrt(q)``, ``q = |u - v|^2``:
    ``|u|^2 n a_k = (2n - 3) sum_i u_i a_(k - e_i) - (n - 3) sum_i a_(k - 2 e_i)``.
    """
    names = indices(u.shape[1], order)
    place = {a: i for i, a in enumerate(names)}
    square = (u * u).sum(axis=1)
    out = np.zeros((len(names), len(u)))
    out[0] = np.sqrt(square)
    for k, a in enumerate(names[1:], 1):
        n = sum(a)
        for i, e in enumerate(a):
            if e >= 1:
                out[k] += (2 * n - 3) * u[:, i] * out[place[(*a[:i], e - 1, *a[i + 1 :])]]
            if e >= 2:
                out[k] -= (n - 3) * out[place[(*a[:i], e - 2, *a[i + 1 :])]]
        out[k] /= n * square
    return out.T


# ---- sums inside a group ---------------------------------------------------------


class Halves:
    """Rows halved along their widest axis until no part has more than ``size``. Nodes are
    numbered by level, those below ``i`` are ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, x: np.ndarray, size: int) -> None:
        self.order = np.arange(len(x))
        bounds = [0, len(x)]
        first, last, centre, radius = [], [], [], []
        while True:
            starts = np.array(bounds[:-1])
            rows = x[self.order]
            middle = (np.minimum.reduceat(rows, starts) + np.maximum.reduceat(rows, starts)) / 2
            square = ((rows - np.repeat(middle, np.diff(bounds), axis=0)) ** 2).sum(axis=1)
            first.append(starts)
            last.append(np.array(bounds[1:]))
            centre.append(middle)
            radius.append(np.sqrt(np.maximum.reduceat(square, starts)) * (1 + 1e-12))
            if max(np.diff(bounds)) <= size:
                break
            halved = [0]
            for a, b in itertools.pairwise(bounds):
                part = self.order[a:b]
                axis = np.ptp(x[part], axis=0).argmax()
                middle_row = (b - a) // 2
                self.order[a:b] = part[np.argpartition(x[part, axis], middle_row)]
                halved += [a + middle_row, b]
            bounds = halved
        self.first, self.last, self.centre, self.radius = map(np.concatenate, (first, last, centre, radius))
        self.leaves = len(self.first) - len(starts)  # the first of them
        self.x = x[self.order]


def by_series(radii: np.ndarray, far: np.ndarray, order: int) -> np.ndarray:
    """Where a series about centres at a distance of ``far`` keeps ``TOLERANCE``."""
    s = np.divide(radii, far, out=np.ones_like(far), where=far > radii)
    return (s < 1) & (2 / (2 * order + 1) * s ** (order + 1) <= TOLERANCE * (1 - s) ** 2)


def meetings(a: Halves, centre: np.ndarray, radius: np.ndarray, start: np.ndarray, order: int, b: Halves | None, worth: float):
    """Pairs of nodes of ``a`` and sources that meet by series, and those that meet row by row.

    Sources are the nodes of ``b``, or single nodes if it is None. Nodes of ``b`` with fewer
    than ``worth`` pairs of rows meet row by row, since a series costs more.
    """
    i, j = np.zeros(len(start), np.int64), start
    series_pairs, row_pairs = [], []
    while len(i):
        far = np.sqrt(((a.centre[i] - centre[j]) ** 2).sum(axis=1))
        apart_ = by_series(a.radius[i] + radius[j], far, order)
        bottom_i = i >= a.leaves
        bottom_j = j >= b.leaves if b else np.ones(len(j), bool)
        few = (a.last[i] - a.first[i]) * (b.last[j] - b.first[j]) < worth if b else np.zeros(len(j), bool)
        done = apart_ | few | (bottom_i & bottom_j)
        by = apart_ & ~few
        series_pairs.append((i[by], j[by]))
        row_pairs.append((i[done & ~by], j[done & ~by]))
        i, j, bottom_i, bottom_j = i[~done], j[~done], bottom_i[~done], bottom_j[~done]
        open_i = bottom_j | (~bottom_i & (a.radius[i] >= radius[j]))
        below_i, below_j = 2 * i[open_i] + 1, 2 * j[~open_i] + 1
        i, j = (np.concatenate([below_i, below_i + 1, i[~open_i], i[~open_i]]),
                np.concatenate([j[open_i], j[open_i], below_j, below_j + 1]))
    return [tuple(np.concatenate(c) for c in zip(*pairs)) for pairs in (series_pairs, row_pairs)]


def distance_sums(
    a: Halves, y: np.ndarray, w: np.ndarray, column: np.ndarray, k: int,
    centres: np.ndarray, radii: np.ndarray, columns: np.ndarray, sums: np.ndarray, order: int,
) -> np.ndarray:
    """For each row of ``a`` the weighted sums of its distances to the points ``y`` of each of
    ``k`` columns, and to far nodes given by their moments ``sums``. Rows are in ``a``'s order."""
    n, d = a.x.shape
    e, j, both, binomial, sign = products(d, order)
    size = len(indices(d, order))
    where, factor = np.zeros((size, size), np.int64), np.zeros((size, size))
    where[e, j], factor[e, j] = both, binomial * sign
    out = np.zeros((n, k))
    local = np.zeros((len(a.first), size, k))
    slab = max(1, SLAB // size**2)

    def operators(at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return series(a.centre[at] - centre, order)[:, where] * factor

    if len(centres):
        (i, f), (near_i, near_f) = meetings(a, centres, radii, np.arange(len(centres)), order, None, 0)
        for at in range(0, len(i), slab):
            p, q = i[at : at + slab], f[at : at + slab]
            found = np.matmul(operators(p, centres[q]), sums[q][:, :, None])[:, :, 0]
            np.add.at(local, (p[:, None], np.arange(size), columns[q][:, None]), found)
        for p, q in zip(near_i, near_f):
            rows = slice(a.first[p], a.last[p])
            out[rows, columns[q]] += series(a.x[rows] - centres[q], order) @ sums[q]
    if len(y):
        b = Halves(y, HALF)
        y, w, column = b.x, w[b.order], column[b.order]
        (i, f), (near_i, near_f) = meetings(a, b.centre, b.radius, np.zeros(1, np.int64), order, b, size**2 * (1 + k / 16) / 2)
        _by_series(a, b, w, column, i, f, operators, local, order, slab)
        _by_rows(a, b, w, column, near_i, near_f, out)
    for node in range(len(a.first)):
        if node < a.leaves:
            for below in (2 * node + 1, 2 * node + 2):
                local[below] += mover(a.centre[below] - a.centre[node], order).T @ local[node]
        else:
            rows = slice(a.first[node], a.last[node])
            out[rows] += monomials(a.x[rows] - a.centre[node], order) @ local[node]
    return out


def _by_series(a, b, w, column, i, f, operators, local, order, slab) -> None:
    """Add to ``local`` the series of pairs. Moments of a node of ``b`` are made from those
    below it, and dropped when its pairs are done."""
    by_node = np.argsort(f, kind="stable")
    i, f = i[by_node], f[by_node]
    starts = np.searchsorted(f, np.arange(len(b.first) + 1))
    size, k = local.shape[1:]
    used = np.diff(starts) > 0
    inside = used.copy()
    for node in range(len(used) - 1, 0, -1):
        inside[(node - 1) // 2] |= inside[node]

    def visit(node: int, wanted: bool) -> np.ndarray | None:
        wanted = wanted or bool(used[node])
        if not (wanted or inside[node]):
            return None
        held = None
        if node >= b.leaves:
            rows = slice(b.first[node], b.last[node])
            order_ = np.argsort(column[rows], kind="stable")
            sorted_ = column[rows][order_]
            first = np.flatnonzero(np.diff(sorted_, prepend=-1))
            each = monomials(b.x[rows] - b.centre[node], order) * w[rows][:, None]
            held = np.zeros((size, k))
            held[:, sorted_[first]] = np.add.reduceat(each[order_], first).T
        else:
            below = [(c, visit(c, wanted)) for c in (2 * node + 1, 2 * node + 2)]
            if wanted:
                held = sum(mover(b.centre[c] - b.centre[node], order) @ m for c, m in below)
        for at in range(starts[node], starts[node + 1], slab):
            p = i[at : min(at + slab, starts[node + 1])]
            local[p] += (operators(p, b.centre[node]).reshape(-1, size) @ held).reshape(-1, size, k)
        return held

    visit(0, False)


def _by_rows(a, b, w, column, i, f, out) -> None:
    """Add to ``out`` the distances of all rows of pairs."""
    by_node = np.argsort(i, kind="stable")
    i, f = i[by_node], f[by_node]
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for lo, hi in itertools.pairwise(cuts):
        rows = slice(a.first[i[lo]], a.last[i[lo]])
        at = np.concatenate([np.arange(b.first[x], b.last[x]) for x in f[lo:hi]])
        at = at[np.argsort(column[at], kind="stable")]
        x = a.x[rows]
        step = max(1, SLAB // len(x))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            far = np.zeros((len(x), len(part)))
            for axis in range(x.shape[1]):
                side = x[:, axis, None] - b.x[part, axis]
                side *= side
                far += side
            np.sqrt(far, out=far)
            far *= w[part]
            first = np.flatnonzero(np.diff(column[part], prepend=-1))
            out[rows, column[part][first]] += np.add.reduceat(far, first, axis=1)


# ---- trees -----------------------------------------------------------------------


def _floats(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _node(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, float]:
    n = float(w.sum())
    centre = (w @ x) / n
    return n, centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()) * (1 + 1e-12))


def morton(points: DataFrame, d: int) -> Column:
    """Place of the point ``x`` on a curve that keeps neighbours together."""
    axes = min(d, MORTON_BITS)
    limits = points.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(axes) for n, f in (("a", F.min), ("b", F.max))]).first()
    bits = max(1, MORTON_BITS // axes)
    place = F.lit(0).cast("long")
    for i in range(axes):
        width = limits[f"b{i}"] - limits[f"a{i}"]
        cell = F.least(F.lit(2**bits - 1), F.floor((F.col("x")[i] - limits[f"a{i}"]) / (width or 1.0) * 2**bits)).cast("long")
        for b in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * axes + i))
    return place


def build_tree(points: DataFrame, order: int, size: int, extras: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and blocks of ``points(_l, x, w, e, id)``, unique on ``(_l, x, id)``.

    Nodes carry the range ``low`` to ``high`` of the ``extras`` numbers in ``e`` below them,
    and ``moments`` about their centre. Blocks hold the points of the lowest nodes as bytes.
    """
    d = len(points.first()["x"])
    placed = no_larger(points.withColumn("_m", morton(points, d)), points)
    numbered = running_total(placed, ["_m", "x", "id"], keys=["_l"], name="_no")
    item = F.struct("_no", "x", "w", "e", "id")
    grouped = numbered.groupBy("_l", F.expr(f"(_no - 1) div {size}").alias("idx")).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, idx, items in zip(*[batch.column(c) for c in ("_l", "idx", "items")]):
                fields = items.values
                x, w = _floats(fields.field("x"), d), fields.field("w").to_numpy(zero_copy_only=False).astype(float)
                e = _floats(fields.field("e"), extras) if extras else np.zeros((len(x), 0))
                n, centre, radius = _node(x, w)
                sums = moments(x - centre, w, order)
                ids = fields.field("id").to_numpy(zero_copy_only=False).astype(np.int64)
                rows.append((key.as_py(), 0, idx.as_py(), n, centre, radius, e.min(axis=0), e.max(axis=0), sums.tobytes(),
                             np.column_stack([x, w, e]).tobytes(), ids.tobytes()))
            yield _nodes_batch(rows, True)

    leaves = stored(grouped.mapInArrow(blocks, f"{NODE}, moments binary, points binary, ids binary"))
    level = leaves.drop("points", "ids")
    nodes, height, n_nodes = level, 0, row_bound(leaves)

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                below = row["below"]
                n = np.array([b["n"] for b in below])
                centres = np.array([b["centre"] for b in below])
                centre = (n @ centres) / n.sum()
                radius = max(float(np.linalg.norm(c - centre)) + b["radius"] for c, b in zip(centres, below)) * (1 + 1e-12)
                sums = sum(shifted(np.frombuffer(b["moments"]), c - centre, order) for c, b in zip(centres, below))
                low = np.min([b["low"] for b in below], axis=0)
                high = np.max([b["high"] for b in below], axis=0)
                rows.append((row["_l"], row["level"], row["idx"], float(n.sum()), centre, radius, low, high, sums.tobytes()))
            yield _nodes_batch(rows, False)

    while True:
        # Labels whose nodes are more than one get another level.
        many = level.where("idx > 0").select("_l").distinct()
        wide = level.join(many, "_l", "left_semi")
        height += 1
        below = F.collect_list(F.struct("n", "centre", "radius", "moments", "low", "high")).alias("below")
        above = wide.groupBy("_l", F.expr(f"idx div {FAN}").alias("idx")).agg(below).withColumn("level", F.lit(height))
        level = stored(above.mapInArrow(parents, f"{NODE}, moments binary"))
        if row_bound(level) == 0:
            return bounded(nodes, n_nodes), leaves
        nodes, n_nodes = nodes.unionByName(level), n_nodes + row_bound(level)


def _nodes_batch(rows: list[tuple], leaves: bool) -> pa.RecordBatch:
    numbers = pa.list_(pa.float64())
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), numbers, pa.float64(), numbers, numbers, pa.binary()]
    names = ["_l", "level", "idx", "n", "centre", "radius", "low", "high", "moments"]
    if leaves:
        types, names = [*types, pa.binary(), pa.binary()], [*names, "points", "ids"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _joined(parts: list[Sequence[np.ndarray]], schema: dict[str, str]) -> pa.RecordBatch:
    """One batch from columns in parts."""
    types = {"long": np.int64, "double": np.float64}
    columns = zip(*parts) if parts else [[np.zeros(0)]] * len(schema)
    arrays = [pa.array(np.concatenate(list(c)).astype(types[kind])) for c, kind in zip(columns, schema.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def roots(nodes: DataFrame) -> DataFrame:
    """``_l, level, idx`` of the highest node of each label."""
    return nodes.groupBy("_l").agg(F.max("level").alias("level")).withColumn("idx", F.lit(0).cast("long"))


def apart(a: str, b: str, dimensions: int) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(total([(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(dimensions)]))


def walk(
    frontier: DataFrame, nodes: DataFrame, settle: Callable[[DataFrame], tuple[DataFrame, Column]]
) -> list[DataFrame]:
    """Let blocks walk down trees. ``frontier`` names nodes by ``_l, level, idx`` beside the
    block's columns. ``settle`` gets it with the node's columns and returns what remains and
    which rows are settled; the others go on with the children. The settled rows by level."""
    names = frontier.columns
    done = []
    keys = ["_l", "level", "idx"]
    nodes = no_larger(nodes.drop("moments"), nodes)
    children = no_larger(nodes.select(*keys), nodes)
    while True:
        remains, settled = settle(attach(frontier, nodes, keys, "inner"))
        remains = stored(remains.withColumn("_settled", settled))
        done.append(remains.where("_settled").drop("_settled"))
        open_ = remains.where(~F.col("_settled")).select(*names)
        lower = F.explode(F.sequence(F.col("idx") * FAN, F.col("idx") * FAN + FAN - 1))
        spread = open_.withColumn("level", (F.col("level") - 1).cast("int")).withColumn("idx", lower)
        frontier = stored(attach(spread, children, keys, "inner"))
        if row_bound(frontier) == 0:
            return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- labels ----------------------------------------------------------------------


class Labelled:
    """Rows in blocks by label, and the table of labels: number, size ``n``, ``centre``, mean
    squared distance ``q`` and mean distance ``s`` to it."""

    def __init__(self, df: DataFrame, label: str, columns: Sequence[str], order: int) -> None:
        self.d, self.order = len(columns), order
        x = [F.col(c).cast("double") for c in columns]
        key = F.to_json(F.struct(F.col(label).alias("k")))  # a null label is a label
        rows = df.select(key.alias("_key"), F.array(*x).alias("x")).where(F.forall("x", lambda v: finite(v).isNotNull()))
        points = rows.groupBy("_key", "x").agg(F.count("*").alias("w"))
        points = stored(points)
        keys = stored(points.select("_key").distinct())
        self.count, self.rows = row_bound(keys), row_bound(points)
        self.shared = min(SHARED, -(-self.count // COLUMNS)) if self.rows > GROUP else 1
        if self.count == 0:
            return
        numbers = bounded(running_total(keys, ["_key"], name="_l"), self.count)
        named = attach(points, numbers, ["_key"]).drop("_key")
        self.points = named
        named = named.withColumns({"e": F.array().cast("array<double>"), "id": F.lit(0).cast("long")})
        self.nodes, self.blocks = build_tree(bounded(named, self.rows), order, BLOCK)
        coordinates = [(F.sum(F.col("n") * F.col("centre")[i]) / F.sum("n")).alias(f"c{i}") for i in range(self.d)]
        centres = self.blocks.groupBy("_l").agg(F.sum("n").alias("size"), *coordinates)
        centres = stored(centres.select("_l", "size", F.array(*[f"c{i}" for i in range(self.d)]).alias("middle")))
        self.labels = stored(attach(self._spreads(centres), centres, ["_l"]))

    def _spreads(self, centres: DataFrame) -> DataFrame:
        d = self.d

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for points, middle in zip(batch.column("points"), _floats(batch.column("middle"), d)):
                    p = np.frombuffer(points.as_py()).reshape(-1, d + 1)
                    square = ((p[:, :d] - middle) ** 2).sum(axis=1)
                    sums.append((p[:, d] @ square, p[:, d] @ np.sqrt(square)))
                q, s = zip(*sums) if sums else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column("_l"), pa.array(q, pa.float64()), pa.array(s, pa.float64())], names=["_l", "q", "s"])

        rows = attach(self.blocks.select("_l", "points"), centres.select("_l", "middle"), ["_l"])
        return rows.mapInArrow(spread, "_l long, q double, s double").groupBy("_l").agg(F.sum("q").alias("sq"), F.sum("s").alias("st"))

    def label_tree(self) -> tuple[DataFrame, DataFrame]:
        e = F.array(F.col("sq") / F.col("size"), F.col("st") / F.col("size"), F.col("size"))
        rows = self.labels.select(F.lit(0).cast("long").alias("_l"), F.col("middle").alias("x"), F.lit(1).alias("w"), e.alias("e"), F.col("_l").alias("id"))
        return build_tree(rows, 0, LABEL_BLOCK, 3)

    def groups(self) -> DataFrame:
        """Neighbouring rows of any labels: number ``ti``, label ``t`` (-1: several), centre
        ``tc``, radius ``tr``, all labels ``own``, points and their labels as bytes."""
        d, size = self.d, GROUP * self.shared if self.rows > GROUP else BLOCK
        rows = running_total(no_larger(self.points.withColumn("_m", morton(self.points, d)), self.points), ["_m", "x", "_l"], name="_no")
        gathered = rows.groupBy(F.expr(f"(_no - 1) div {size}").alias("ti")).agg(F.collect_list(F.struct("x", "w", "_l")).alias("items"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(len(batch)):
                    fields = batch.column("items")[at].values
                    x, w = _floats(fields.field("x"), d), fields.field("w").to_numpy(zero_copy_only=False).astype(float)
                    labels = fields.field("_l").to_numpy(zero_copy_only=False).astype(np.int64)
                    _, centre, radius = _node(x, w)
                    own = np.unique(labels).tolist()
                    yield pa.RecordBatch.from_pylist([{
                        "ti": batch.column("ti")[at].as_py(), "t": own[0] if len(own) == 1 else -1, "tc": centre.tolist(), "tr": radius,
                        "own": own, "points": np.column_stack([x, w]).tobytes(), "labels": labels.tobytes(),
                    }], _GROUPS)

        return stored(gathered.mapInArrow(packed, "ti long, t long, tc array<double>, tr double, own array<long>, points binary, labels binary"))

    def candidates(self, groups: DataFrame | None = None) -> DataFrame:
        """``t, ti`` (label and place of a block), other labels ``_l`` that may be the nearest
        to one of its points, with their ``size``, ``middle`` and ``q``: by mean distance or by
        mean squared distance. The same for ``groups`` in place of blocks."""
        nodes, leaves = self.label_tree()
        d = self.d
        blocks = self.blocks.select(F.col("_l").alias("t"), F.col("idx").alias("ti"), F.col("centre").alias("tc"), F.col("radius").alias("tr"))
        if groups is not None:
            blocks = groups.select("t", "ti", "tc", "tr")
        frontier = attach(blocks.withColumn("_l", F.lit(0).cast("long")), roots(nodes), ["_l"], "inner")
        own = Window.partitionBy("t", "ti")
        whole = own.orderBy("_high2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def within_reach(rows: DataFrame, radius: Column, low: Column, high: Column, others: Column) -> DataFrame:
            # Steps of their own, so that a distance is taken once.
            rows = rows.withColumn("_far", apart("tc", "centre", d))
            rows = rows.withColumn("_low", F.greatest(F.lit(0.0), F.col("_far") - F.col("tr") - radius))
            rows = rows.withColumn("_most", F.col("_far") + F.col("tr") + radius)
            rows = rows.withColumns({"_low2": F.col("_low") * F.col("_low") + low, "_high2": F.col("_most") * F.col("_most") + high})
            best = F.min(F.when(others, F.col("_high2"))).over(own)
            if groups is not None:  # of two labels one is not the point's own
                best = F.least(best, F.nth_value("_high2", 2).over(whole))
            rows = rows.withColumn("_best2", best * (1 + 1e-9))
            keep = F.col("_best2").isNull() | (F.col("_low2") <= F.col("_best2")) | (F.col("_low") * F.col("_low") <= F.col("_best2"))
            return rows.where(keep).drop("_far", "_low", "_most", "_low2", "_high2", "_best2")

        def settle(rows: DataFrame) -> tuple[DataFrame, Column]:
            # A node of several labels holds one that is not the block's own.
            kept = within_reach(rows, F.col("radius"), F.col("low")[0], F.col("high")[0], F.col("n") > 1)
            return kept.select("t", "ti", "tc", "tr", "_l", "level", "idx"), F.col("level") == 0

        found = _union(walk(frontier, nodes, settle))

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for idx, points, ids in zip(*[batch.column(c).to_pylist() for c in ("idx", "points", "ids")]):
                    for key, p in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(points).reshape(-1, d + 4).tolist()):
                        rows.append({"idx": idx, "_l": key, "centre": p[:d], "q": p[d + 1], "size": p[d + 3]})
                yield pa.RecordBatch.from_pylist(rows, _OPENED)

        each = leaves.select("idx", "points", "ids").mapInArrow(opened, "idx long, _l long, centre array<double>, q double, size double")
        rows = found.drop("_l", "level").join(stored(each), "idx")
        other = F.col("_l") != F.col("t")
        kept = within_reach(rows, F.lit(0.0), F.col("q"), F.col("q"), other if groups is None else F.lit(False)).where(other)
        return kept.select("t", "ti", "_l", "size", F.col("centre").alias("middle"), "q", "tc", "tr")


_GROUPS = pa.schema([("ti", pa.int64()), ("t", pa.int64()), ("tc", pa.list_(pa.float64())), ("tr", pa.float64()),
                     ("own", pa.list_(pa.int64())), ("points", pa.binary()), ("labels", pa.binary())])
_OPENED = pa.schema([("idx", pa.int64()), ("_l", pa.int64()), ("centre", pa.list_(pa.float64())), ("q", pa.float64()), ("size", pa.float64())])


def _share(own: Column, other: Column, size: Column) -> Column:
    """Silhouette from the mean distances to the own and the nearest other label."""
    larger = F.greatest(own, other)
    return F.when((size > 1) & (larger > 0), (other - own) / larger).otherwise(0.0)


def silhouette(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """One row: the mean silhouette of labelled rows by Euclidean distances.

    A row's value is (b - a) / max(a, b), with ``a`` its mean distance to the other rows of its
    label and ``b`` the least mean distance to the rows of another label; 0 for a label of one
    row, and where both are 0. Distances carry a relative error of ``TOLERANCE`` at most. A
    null label is a label; rows with a missing or infinite coordinate are left out. With fewer
    than two labels the result is -1.
    """
    spark = df.sparkSession
    order = order_for(len(columns))
    data = Labelled(df, label, columns, order)
    if data.count < 2:
        return spark.createDataFrame([(-1.0,)], "silhouette double")
    d, p = data.d, order
    groups = data.groups()
    own = groups.select("t", "ti", F.explode("own").alias("_l"))
    pairs = data.candidates(groups).select("t", "ti", "_l").unionByName(own).distinct()
    shapes = no_larger(groups.select("ti", "tc", "tr"), groups)
    frontier = attach(attach(pairs, shapes, ["ti"]), roots(data.nodes), ["_l"], "inner")

    def settle(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = rows.withColumn("gap", apart("tc", "centre", d) - F.col("tr"))
        far = F.col("gap")
        s = F.try_divide(F.col("radius"), far)
        error = F.lit(2.0 / (2 * p + 1)) * F.try_divide(F.pow(s, F.lit(float(p + 1))), (1 - s) * (1 - s))
        seen_whole = (far > 0) & (s < 1) & (error <= TOLERANCE)
        kept = rows.withColumn("far", F.coalesce(seen_whole, F.lit(False)))
        return kept.select(*frontier.columns, "far"), F.col("far") | (F.col("level") == 0)

    met = _union(walk(frontier, data.nodes, settle)).select("ti", "_l", "level", "idx", "far")
    shape = [F.col("centre"), F.col("radius")]
    near = met.where(~F.col("far")).join(data.blocks.select("_l", "idx", *shape, F.col("points").alias("load")), ["_l", "idx"])
    distant = met.where("far").join(data.nodes.select("_l", "level", "idx", *shape, F.col("moments").alias("load")), ["_l", "level", "idx"])
    sizes = no_larger(data.labels.select("_l", "size"), data.labels)
    loads = attach(near.unionByName(distant, allowMissingColumns=True), sizes, ["_l"])
    # A group's rows come first, then what it meets, some labels at a time. Its labels are
    # dealt out to ``shared`` tasks.
    shared = data.shared
    chunk = F.expr(f"_l div {COLUMNS}")
    columns_ = ["ti", F.pmod(chunk, F.lit(shared)).alias("part"), chunk.alias("chunk"), "_l", "far", "size", "centre", "radius", "load"]
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shared - 1).cast("long"))).alias("part")
    first = groups.select("ti", every_part, F.lit(-1).cast("long").alias("chunk"), F.col("points").alias("load"), F.col("labels"))
    rows = loads.select(*columns_).unionByName(first, allowMissingColumns=True)
    several = () if data.rows <= GROUP else (min(4 * shared * row_bound(groups), 2000),)
    rows = rows.repartition(*several, "ti", "part").sortWithinPartitions("ti", "part", "chunk")

    def summed(size: np.ndarray, inner: np.ndarray, outer: np.ndarray, w: np.ndarray) -> dict[str, list[float]]:
        larger = np.maximum(inner, outer)
        value = np.divide(outer - inner, larger, out=np.zeros(len(w)), where=(size > 1) & (larger > 0))
        return {"value": [float(value @ w)], "n": [float(w.sum())]}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = itertools.chain.from_iterable(batch.to_pylist() for batch in batches)
        for (ti, _), of_group in itertools.groupby(every, key=lambda row: (row["ti"], row["part"])):
            target = next(of_group)
            points = np.frombuffer(target["load"]).reshape(-1, d + 1)
            tree = Halves(points[:, :d], HALF)
            mine, w = np.frombuffer(target["labels"], np.int64)[tree.order], points[tree.order, d]
            size, inner, outer = np.zeros(len(w)), np.zeros(len(w)), np.full(len(w), np.inf)
            for _, part in itertools.groupby(of_group, key=lambda row: row["chunk"]):
                part = list(part)
                names, column = np.unique([row["_l"] for row in part], return_inverse=True)
                count = np.zeros(len(names))
                count[column] = [row["size"] for row in part]
                close = [(np.frombuffer(row["load"]).reshape(-1, d + 1), c) for row, c in zip(part, column) if not row["far"]]
                y = np.concatenate([v for v, _ in close]) if close else np.zeros((0, d + 1))
                owner = np.repeat([c for _, c in close], [len(v) for v, _ in close]).astype(np.int64)
                away = [(row, c) for row, c in zip(part, column) if row["far"]]
                nodes = [np.array([row[c] for row, _ in away]) for c in ("centre", "radius")]
                sums = np.array([np.frombuffer(row["load"]) for row, _ in away])
                found = distance_sums(tree, y[:, :d], y[:, d], owner, len(names), *nodes, np.array([c for _, c in away], np.int64), sums, p)
                at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                is_own = np.flatnonzero(names[at] == mine)
                size[is_own] = count[at[is_own]]
                inner[is_own] = found[is_own, at[is_own]] / np.maximum(size[is_own] - 1, 1)
                found /= count
                found[is_own, at[is_own]] = np.inf
                outer = np.minimum(outer, found.min(axis=1))
            if shared == 1:
                yield pa.RecordBatch.from_pydict(summed(size, inner, outer, w))
                continue
            place = np.argsort(tree.order)
            mine_here = np.flatnonzero(size[place] > 0)
            own_rows = np.column_stack([mine_here, size[place][mine_here], inner[place][mine_here], w[place][mine_here]])
            yield pa.RecordBatch.from_pydict({"ti": [ti], "outer": [outer[place].tobytes()], "own": [own_rows.tobytes()]})

    def merged(table: pa.Table) -> pa.Table:
        # Every row has its own label in one of the parts.
        outer = np.min([np.frombuffer(v) for v in table.column("outer").to_pylist()], axis=0)
        own_rows = np.concatenate([np.frombuffer(v).reshape(-1, 4) for v in table.column("own").to_pylist()])
        return pa.table(summed(own_rows[:, 1], own_rows[:, 2], outer[own_rows[:, 0].astype(np.int64)], own_rows[:, 3]))

    rows = rows.select("ti", "part", "chunk", "_l", "far", "size", "centre", "radius", "load", "labels")
    if shared == 1:
        each = rows.mapInArrow(values, "value double, n double")
    else:
        each = rows.mapInArrow(values, "ti long, outer binary, own binary").groupBy("ti").applyInArrow(merged, "value double, n double")
    return each.agg((F.sum("value") / F.sum("n")).alias("silhouette"))


def _squared_silhouette(data: Labelled) -> float:
    """The mean silhouette by mean squared distances: exact from centres and spreads."""
    d = data.d
    own = F.struct("middle", "q", "size")
    lists = data.candidates().groupBy("t", "ti", F.expr(f"pmod(_l, {PARTS})").alias("chunk")).agg(F.collect_list(own).alias("others"))
    mine = data.labels.select(F.col("_l").alias("t"), F.col("middle").alias("mc"), (F.col("sq") / F.col("size")).alias("mq"), F.col("size").alias("ms"))
    targets = attach(data.blocks.select(F.col("_l").alias("t"), F.col("idx").alias("ti"), "points"), mine, ["t"])
    rows = lists.join(targets, ["t", "ti"])

    schema = {"t": "long", "ti": "long", "i": "long", "w": "double", "size": "double", "a": "double", "b": "double"}

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row in batch.to_pylist():
                p = np.frombuffer(row["points"]).reshape(-1, d + 1)
                x = p[:, :d]
                inner = ((x - np.array(row["mc"])) ** 2).sum(axis=1) + row["mq"]
                inner *= row["ms"] / max(row["ms"] - 1, 1)
                middles = np.array([o["middle"] for o in row["others"]])
                outer = (((x[:, None] - middles) ** 2).sum(axis=2) + np.array([o["q"] for o in row["others"]])).min(axis=1)
                size = len(x)
                columns = [np.full(size, row["t"]), np.full(size, row["ti"]), np.arange(size), p[:, d], np.full(size, row["ms"]), inner, outer]
                parts.append(columns)
                if len(parts) == PARTS:
                    yield _joined(parts, schema)
                    parts = []
            yield _joined(parts, schema)

    each = rows.mapInArrow(least, ", ".join(f"{name} {kind}" for name, kind in schema.items()))
    each = each.groupBy("t", "ti", "i", "w", "size", "a").agg(F.min("b").alias("b"))
    value = _share(F.col("a"), F.col("b"), F.col("size"))
    return each.agg((F.sum(value * F.col("w")) / F.sum("w")).alias("v")).first()["v"]


def _davies_bouldin(data: Labelled) -> float:
    """Mean over labels of the largest (spread + spread) / distance of centres. Labels with
    equal centres are no pair."""
    nodes, leaves = data.label_tree()
    d = data.d
    blocks = leaves.select(F.col("idx").alias("ti"), F.col("centre").alias("tc"), F.col("radius").alias("tr"),
                           F.col("low")[1].alias("tlow"), F.col("high")[1].alias("thigh"), F.lit(0).cast("long").alias("_l"))
    frontier = attach(blocks, roots(nodes), ["_l"], "inner")
    own = Window.partitionBy("ti")

    def settle(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = rows.withColumn("_far", apart("tc", "centre", d))
        far, gap = F.col("_far"), F.col("_far") - F.col("tr") - F.col("radius")
        rows = rows.withColumns({
            "_most": F.when(gap > 0, (F.col("thigh") + F.col("high")[1]) / gap),
            "_least": F.when(gap > 0, (F.col("tlow") + F.col("low")[1]) / (far + F.col("tr") + F.col("radius"))),
        })
        best = F.max("_least").over(own) * (1 - 1e-9)
        kept = rows.withColumn("_best", best).where(F.col("_most").isNull() | F.col("_best").isNull() | (F.col("_most") >= F.col("_best")))
        return kept.select(*frontier.columns), F.col("level") == 0

    pairs = _union(walk(frontier, nodes, settle)).select("ti", "idx")
    left = leaves.select(F.col("idx").alias("ti"), F.col("points").alias("a"), F.col("ids").alias("ia"))
    rows = pairs.join(left, "ti").join(leaves.select("idx", F.col("points").alias("b")), "idx")

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for ids, a, b in zip(*[batch.column(c).to_pylist() for c in ("ia", "a", "b")]):
                a, b = (np.frombuffer(v).reshape(-1, d + 4) for v in (a, b))
                far = np.sqrt(((a[:, None, :d] - b[None, :, :d]) ** 2).sum(axis=2))
                both = a[:, None, d + 2] + b[None, :, d + 2]
                ratio = np.divide(both, far, out=np.zeros_like(far), where=far > 0).max(axis=1)
                parts.append((np.frombuffer(ids, np.int64), ratio))
            yield _joined(parts, {"_l": "long", "ratio": "double"})

    each = rows.mapInArrow(worst, "_l long, ratio double").groupBy("_l").agg(F.max("ratio").alias("ratio"))
    return each.agg(F.avg("ratio").alias("v")).first()["v"]


def cluster_quality(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """One row: Davies-Bouldin, Calinski-Harabasz, and the silhouette by squared distances
    (``silhouette_sq``), which is exact from the labels' centres and spreads.

    Any number of labels: each block of rows meets the labels that can be nearest to it, each
    block of label centres those that can be its worst partners. With a single label the
    results are infinite, 0 and -1. Labels with equal centres are no pair. A null label is a
    label; rows with a missing or infinite coordinate are left out.
    """
    spark = df.sparkSession
    schema = "davies_bouldin double, calinski_harabasz double, silhouette_sq double"
    data = Labelled(df, label, columns, 0)
    if data.count < 2:
        return spark.createDataFrame([(float("inf"), 0.0, -1.0)], schema)
    k, d = data.count, range(data.d)
    weighted = [(F.sum(F.col("size") * F.col("middle")[i]) / F.sum("size")).alias(f"m{i}") for i in d]
    middle = data.labels.agg(F.sum("size").alias("n"), F.sum("sq").alias("within"), *weighted).first()
    square = total([(F.col("middle")[i] - middle[f"m{i}"]) * (F.col("middle")[i] - middle[f"m{i}"]) for i in d])
    between = data.labels.agg(F.sum(F.col("size") * square).alias("b")).first()["b"]
    n, within = middle["n"], middle["within"]
    ch = between / (k - 1) / (within / (n - k)) if within > 0 and n > k else 1.0
    return spark.createDataFrame([(_davies_bouldin(data), float(ch), _squared_silhouette(data))], schema)

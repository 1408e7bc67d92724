"""Density-based clustering and nearest-place lookups on a grid.

Meters stand close together: a building is one position, a dense block one cell. So
equal positions are merged into one weighted row first, and the grid is fine enough
that two points of one cell are always within ``eps``. A cell that holds
``min_samples`` points is core as a whole and none of its pairs is ever formed; only
points of thin cells look at their surroundings, and there are fewer than
``min_samples`` of those per cell. Work is linear in the number of positions however
they are crowded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.functions.columns import EARTH_RADIUS_M, arc_m, distance
from ampledger.operators.components import connected_components
from ampledger.operators.grouped import attach, running_total
from ampledger.session import bounded, checkpointed, no_larger, row_bound

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180
#: Positions of one cell beyond which the cell is split over several tasks.
CELL_SPLIT = 10_000
#: Cuts after which undecided cell pairs are first checked for hanging together already.
PRUNE_LEVEL = 3
SMALL_CLUSTER = 10
MAX_EPS_M = 100_000.0


@dataclass(frozen=True)
class Grid:
    """Cells whose points are mutually within ``eps``, and the cells within reach of a point."""

    eps: float
    metric: str = "haversine"

    def __post_init__(self):
        if self.eps <= 0 or (self.metric == "haversine" and self.eps > MAX_EPS_M):
            raise ValueError("eps must be positive and, in metres, at most 100 km")
        if self.metric not in ("haversine", "euclidean", "manhattan", "chebyshev"):
            raise ValueError(f"unknown metric {self.metric!r}")

    @property
    def side(self) -> float:
        """Row height in coordinate units."""
        if self.metric == "haversine":
            return 0.99 * self.eps / math.sqrt(2) / METRES_PER_DEGREE
        shrink = {"euclidean": math.sqrt(2), "manhattan": 2.0, "chebyshev": 1.0}[self.metric]
        return 0.999 * self.eps / shrink

    def width(self, row: Column) -> Column:
        """Column width of a row: degrees of longitude grow towards the poles, and the
        edge of the row nearest to the equator has the longest ones."""
        if self.metric != "haversine":
            return F.lit(self.side)
        nearest = F.when(row >= 0, row * self.side).otherwise(-(row + 1) * self.side)
        return F.lit(self.side) / F.cos(F.radians(nearest))

    def row(self, y: Column) -> Column:
        return F.floor(y / self.side)

    def columns(self, row: Column) -> Column:
        """How many columns of equal width go round the sphere in a row."""
        return F.ceil(F.lit(360.0) / self.width(row))

    def column(self, row: Column, x: Column) -> Column:
        """Column of ``x``, counted from -180° on a sphere; it may lie beyond the first or
        last one, to which :meth:`turned` leads back."""
        if self.metric != "haversine":
            return F.floor(x / self.width(row))
        return F.floor((x + 180.0) / 360.0 * self.columns(row))

    def turned(self, row: Column, column: Column) -> Column:
        return F.pmod(column, self.columns(row)) if self.metric == "haversine" else column

    def turned_x(self, x: Column) -> Column:
        """Longitude from -180 up to, but without, 180."""
        return x - 360.0 * F.floor((x + 180.0) / 360.0) if self.metric == "haversine" else x

    def reach_y(self) -> float:
        return 1.01 * self.eps / (METRES_PER_DEGREE if self.metric == "haversine" else 1.0)

    def reach_x(self, y: Column) -> Column:
        if self.metric != "haversine":
            return F.lit(1.01 * self.eps)
        s = F.lit(math.sin(self.eps / EARTH_RADIUS_M))
        narrow = F.cos(F.radians(y))
        # Within reach of a pole, all longitudes are.
        return F.when((y < 90.0) & (narrow > s), F.degrees(F.asin(s / F.greatest(narrow, s))) * 1.01).otherwise(F.lit(180.0))

    def with_cell(self, df: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
        rows = df.withColumn("cy", self.row(F.col(y)))
        return rows.withColumn("cx", self.turned(F.col("cy"), self.column(F.col("cy"), F.col(x))))

    def with_reach(self, df: DataFrame, y0: str, y1: str, x0: str, x1: str) -> DataFrame:
        """One row per cell that may hold a point within ``eps`` of the given box."""
        ry = self.reach_y()
        far = F.greatest(F.abs(F.col(y0) - ry), F.abs(F.col(y1) + ry))
        rx = self.reach_x(far)
        rows = F.sequence(self.row(F.col(y0) - ry), self.row(F.col(y1) + ry))
        with_rows = df.withColumn("_rx", rx).withColumn("cy", F.explode(rows))
        first = self.column(F.col("cy"), F.col(x0) - F.col("_rx"))
        last = self.column(F.col("cy"), F.col(x1) + F.col("_rx"))
        if self.metric == "haversine":
            last = F.least(last, first + self.columns(F.col("cy")) - 1)  # once round
        wide = with_rows.withColumn("cx", F.explode(F.sequence(first, last)))
        return wide.withColumn("cx", self.turned(F.col("cy"), F.col("cx"))).drop("_rx")

    def box_distance(self, a: str, b: str, nearest: bool) -> Column:
        """Lower (``nearest``) or upper bound of the distance between the points of two
        boxes; for single points both are the exact distance."""

        def c(side: str, name: str) -> Column:
            return F.col(f"{side}.{name}")

        def gap(low: str, high: str) -> Column:
            if nearest:
                return F.greatest(F.lit(0.0), c(b, low) - c(a, high), c(a, low) - c(b, high))
            return F.greatest(c(b, high) - c(a, low), c(a, high) - c(b, low))

        dy = gap("y0", "y1")
        if self.metric != "haversine":
            zero = F.lit(0.0)
            return distance(self.metric, zero, zero, dy, gap("x0", "x1"))
        # Differences of longitude from the least to the largest; the way round is shorter
        # beyond half a turn.
        least = F.greatest(F.lit(0.0), c(b, "x0") - c(a, "x1"), c(a, "x0") - c(b, "x1"))
        most = F.greatest(c(b, "x1") - c(a, "x0"), c(a, "x1") - c(b, "x0"))
        if nearest:
            dx = F.greatest(F.lit(0.0), F.least(least, 360.0 - most))
        else:
            dx = F.when(most <= 180.0, most).when(least >= 180.0, 360.0 - least).otherwise(F.lit(180.0))

        def cosine(side: str) -> Column:
            low, high = F.abs(c(side, "y0")), F.abs(c(side, "y1"))
            if nearest:
                return F.cos(F.radians(F.greatest(low, high)))
            spans = (c(side, "y0") < 0) & (c(side, "y1") > 0)
            return F.when(spans, F.lit(1.0)).otherwise(F.cos(F.radians(F.least(low, high))))

        return arc_m(dy, dx, cosine(a), cosine(b))


def _counted(points: DataFrame) -> DataFrame:
    """``points`` with a row bound: small tables then need no measured statistics."""
    return points if row_bound(points) is not None else bounded(points, points.count())


def _positions(points: DataFrame, grid: Grid, key: str, y: str, x: str, within: list[str]) -> DataFrame:
    """One weighted row per distinct position, named by its smallest key."""
    merged = points.groupBy(*within, F.col(y).alias("y"), F.col(x).alias("x")).agg(
        F.count("*").alias("n"), F.min(key).alias("id")
    )
    return no_larger(grid.with_cell(merged), points)


def _near_pairs(probes: DataFrame, positions: DataFrame, grid: Grid, within: list[str]) -> DataFrame:
    """Pairs (probe, position) within ``eps``: probe columns as they are, the other's
    columns with ``o_``. ``positions`` carry ``_parts``, in how many parts their cell is
    split; probes are sent to every part, positions to one."""
    cell = [*within, "cy", "cx"]
    sizes = positions.groupBy(*cell).agg(F.max("_parts").alias("_parts"))
    spread = grid.with_reach(probes.drop("cy", "cx", "_parts"), "y", "y", "x", "x").join(sizes, cell)
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    others = positions.select(
        *cell,
        part.alias("_part"),
        *[F.col(c).alias(f"o_{c}") for c in positions.columns if c not in {*cell, "_parts"}],
    )
    near = distance(grid.metric, F.col("y"), F.col("x"), F.col("o_y"), F.col("o_x")) <= grid.eps
    return spread.join(others, [*cell, "_part"]).where(near).drop("cy", "cx", "_part")


def density(
    points: DataFrame,
    eps: float,
    min_samples: int,
    key: str = "meter_id",
    y: str = "lat",
    x: str = "lon",
    metric: str = "haversine",
    within: list[str] | None = None,
) -> DataFrame:
    """Distinct positions with ``id, n`` and ``is_core``: at least ``min_samples`` points,
    itself included, within ``eps`` (and the same ``within`` group)."""
    within = within or []
    grid = Grid(eps, metric)
    cell = [*within, "cy", "cx"]
    positions = _positions(_counted(points), grid, key, y, x, within)
    cells = positions.groupBy(*cell).agg(F.sum("n").alias("_w"), F.count("*").alias("_k"))
    cells = cells.select(*cell, "_w", F.ceil(F.col("_k") / CELL_SPLIT).cast("int").alias("_parts"))
    sized = checkpointed(attach(positions, no_larger(cells, positions), cell))
    thin = sized.where(F.col("_w") < min_samples).drop("_w")
    pairs = _near_pairs(thin.select(*within, "id", "y", "x", "cy", "cx"), sized.drop("_w"), grid, within)
    counted = pairs.groupBy("id").agg(F.sum("o_n").alias("_near"))
    cored = thin.join(counted, "id", "left").withColumn("is_core", F.col("_near") >= min_samples).drop("_near")
    dense = sized.where(F.col("_w") >= min_samples).drop("_w").withColumn("is_core", F.lit(True))
    return no_larger(checkpointed(dense.unionByName(cored)), positions)


def _cell_edges(core: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of cells with core points within ``eps`` of each other.

    Boxes around the core points of neighbouring cells decide most pairs: surely near,
    or surely apart. Undecided boxes are cut into quarters by both coordinates and
    compared again, until every pair is decided. A pair of cells leaves as soon as one
    pair of boxes is near, or both cells hang together already. No list of point pairs
    is formed, and the boxes shrink to single points at worst.
    """
    core = core.withColumn("x", grid.turned_x(F.col("x")))
    box = [F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]
    names = core.groupBy("cy", "cx").agg(F.min("id").alias("cell"), *box)
    names = checkpointed(names)
    near = grid.with_reach(names.withColumnsRenamed({"cy": "_cy", "cx": "_cx"}), "y0", "y1", "x0", "x1")
    boxes = names.select(
        "cy", "cx", F.col("cell").alias("b"), F.struct("y0", "y1", "x0", "x1").alias("q")
    )
    pairs = (
        near.join(boxes, ["cy", "cx"])
        .where(F.col("cell") < F.col("b"))
        .select(F.col("cell").alias("a"), "b", F.struct("y0", "y1", "x0", "x1").alias("p"), "q")
    )
    cells = names.select("cy", "cx", "cell")
    located = None
    found = None
    level = 0
    while True:
        bounds = pairs.withColumn("_lo", grid.box_distance("p", "q", True)).withColumn(
            "_hi", grid.box_distance("p", "q", False)
        )
        bounds = checkpointed(bounds.where(F.col("_lo") <= grid.eps))
        linked = bounds.where(F.col("_hi") <= grid.eps).select("a", "b").distinct()
        found = linked if found is None else found.unionByName(linked)
        open_pairs = bounds.drop("_lo", "_hi").join(linked, ["a", "b"], "left_anti")
        if open_pairs.limit(1).count() == 0:
            return found
        if level == PRUNE_LEVEL:
            found = checkpointed(found)
            roots = connected_components(found)
            for end in ("a", "b"):
                side = roots.select(F.col("node").alias(end), F.col("root").alias(f"_r{end}"))
                open_pairs = open_pairs.join(side, end, "left")
            same = F.coalesce(F.col("_ra") == F.col("_rb"), F.lit(False))
            open_pairs = open_pairs.where(~same).drop("_ra", "_rb")
        level += 1
        if located is None:
            located = checkpointed(core.select("cy", "cx", "y", "x").join(cells, ["cy", "cx"]).select("cell", "y", "x"))
        pairs = _quarter(open_pairs, located)


def _quarter(pairs: DataFrame, located: DataFrame) -> DataFrame:
    """Replace both boxes of every pair by the boxes of their four quarters."""
    corners = ["y0", "y1", "x0", "x1"]
    ends = pairs.select(F.col("a").alias("cell"), F.col("p").alias("box")).unionByName(
        pairs.select(F.col("b").alias("cell"), F.col("q").alias("box"))
    )
    def upper(value: str, low: str, high: str) -> Column:
        """Above the middle; the top value always, so that a box of two values is cut."""
        v, lo, hi = F.col(value), F.col(f"box.{low}"), F.col(f"box.{high}")
        return ((v > (lo + hi) / 2) | ((v == hi) & (hi > lo))).cast("int")

    quarter = upper("y", "y0", "y1") * 2 + upper("x", "x0", "x1")
    inside = F.col("y").between(F.col("box.y0"), F.col("box.y1")) & F.col("x").between(
        F.col("box.x0"), F.col("box.x1")
    )
    parts = (
        located.join(ends.distinct(), "cell")
        .where(inside)
        .groupBy("cell", "box", quarter.alias("_quarter"))
        .agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        .select("cell", "box", F.struct(*corners).alias("part"))
    )
    parts = checkpointed(parts)
    left = parts.select(F.col("cell").alias("a"), F.col("box").alias("p"), F.col("part").alias("p2"))
    right = parts.select(F.col("cell").alias("b"), F.col("box").alias("q"), F.col("part").alias("q2"))
    cut = pairs.join(left, ["a", "p"]).join(right, ["b", "q"])
    return cut.select("a", "b", F.col("p2").alias("p"), F.col("q2").alias("q"))


def dbscan(
    points: DataFrame,
    eps: float = 50.0,
    min_samples: int = 5,
    key: str = "meter_id",
    y: str = "lat",
    x: str = "lon",
    metric: str = "haversine",
) -> DataFrame:
    """Adds ``cluster`` (-1 for noise and for points without a position) and ``is_core``.

    Clusters are numbered by their smallest core key; a border point joins the lowest
    numbered cluster that reaches it. Both equal a sequential scan in key order, so the
    result does not depend on the partitioning.
    """
    grid = Grid(eps, metric)
    points = _counted(points)
    placed = no_larger(points.where(F.col(y).isNotNull() & F.col(x).isNotNull()), points)
    positions = density(placed, eps, min_samples, key, y, x, metric)
    core = positions.where("is_core")
    cells = core.groupBy("cy", "cx").agg(F.min("id").alias("cell"))
    roots = connected_components(_cell_edges(core, grid))
    rooted = cells.join(roots.withColumnRenamed("node", "cell"), "cell", "left")
    rooted = rooted.select("cy", "cx", F.coalesce("root", "cell").alias("root"))
    roots_only = no_larger(rooted.select("root").distinct(), points)
    numbers = running_total(roots_only, ["root"], name="number")
    numbered = attach(rooted, no_larger(numbers, points), ["root"]).select(
        "cy", "cx", (F.col("number") - 1).cast("int").alias("cluster")
    )
    numbered = no_larger(numbered, points)
    core = checkpointed(attach(core, numbered, ["cy", "cx"], "inner"))
    outer = positions.where(~F.col("is_core")).select("id", "y", "x", "cy", "cx")
    touched = _near_pairs(outer, core.select("id", "y", "x", "cy", "cx", "_parts", "cluster"), grid, [])
    border = touched.groupBy("id").agg(F.min("o_cluster").alias("cluster"))
    outer = outer.join(border, "id", "left").select("y", "x", "cluster", F.lit(False).alias("is_core"))
    labelled = core.select("y", "x", "cluster", "is_core").unionByName(outer)
    labelled = no_larger(labelled.withColumnsRenamed({"y": y, "x": x}), points)
    joined = attach(points, labelled, [y, x])
    out = joined.select(
        *points.columns,
        F.coalesce("cluster", F.lit(-1)).alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
    )
    return no_larger(out, points)


def cluster_members(
    points: DataFrame,
    eps: float,
    min_samples: int,
    key: str = "meter_id",
    y: str = "lat",
    x: str = "lon",
    within: list[str] | None = None,
) -> DataFrame:
    """Points with at least ``min_samples`` points around them, and all points those reach."""
    within = within or []
    grid = Grid(eps)
    points = _counted(points)
    positions = density(points, eps, min_samples, key, y, x, within=within)
    core = positions.where("is_core")
    outer = positions.where(~F.col("is_core")).select(*within, "id", "y", "x", "cy", "cx")
    reached = _near_pairs(outer, core.select(*within, "id", "y", "x", "cy", "cx", "_parts"), grid, within)
    members = core.select(*within, "y", "x").unionByName(reached.select(*within, "y", "x").distinct())
    members = members.withColumnsRenamed({"y": y, "x": x}).withColumn("_member", F.lit(True))
    joined = attach(points, no_larger(members, points), [*within, y, x])
    return joined.where("_member").select(*points.columns)


def has_cluster(points: DataFrame, radius: float, group: str, neighbours: int = 2) -> DataFrame:
    """Per group: is there a point with at least ``neighbours`` others within ``radius``?"""
    positions = density(points, radius, neighbours + 1, within=[group])
    return positions.groupBy(group).agg(F.max("is_core").alias("has_cluster"))


def cluster_table(labelled: DataFrame, small: int = SMALL_CLUSTER, y: str = "lat", x: str = "lon") -> DataFrame:
    """Size and centroid of each cluster; small ones are flagged as suspicious."""
    table = labelled.where("cluster >= 0").groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg(y).alias("center_lat"), F.avg(x).alias("center_lon")
    )
    return table.withColumn("is_small", F.col("size") <= small)


def cluster_statistics(labelled: DataFrame, small: int = SMALL_CLUSTER) -> DataFrame:
    """One row: points, clusters, noise, small clusters and their members, rates."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("k"))
    real, tiny = F.col("cluster") >= 0, (F.col("cluster") >= 0) & (F.col("k") <= small)

    def members(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("k"))), F.lit(0))

    stats = sizes.agg(
        F.sum("k").alias("n_points"),
        F.count_if(real).alias("n_clusters"),
        members(~real).alias("n_noise"),
        F.count_if(tiny).alias("n_small_clusters"),
        members(tiny).alias("n_small_members"),
    )
    return stats.select(
        "*",
        (F.col("n_noise") / F.col("n_points")).alias("noise_rate"),
        ((F.col("n_noise") + F.col("n_small_members")) / F.col("n_points")).alias("anomaly_rate"),
    )


def assign_clusters(
    points: DataFrame,
    table: DataFrame,
    eps: float,
    y: str = "lat",
    x: str = "lon",
    metric: str = "haversine",
    missing: str = "mark_normal",
) -> DataFrame:
    """New points to the nearest centroid within ``eps``: adds ``cluster, spatial_anomaly``.

    Centroids are listed per grid cell they can serve, and that list joined to the
    points' cells: a lookup by cell, not a comparison with all centroids. Points without
    a position are noise that counts as normal, anomalous or an error by ``missing``.
    """
    if missing not in ("mark_normal", "mark_anomaly", "error"):
        raise ValueError(f"unknown policy {missing!r}")
    no_position = F.col(y).isNull() | F.col(x).isNull()
    if missing == "error" and points.where(no_position).limit(1).count():
        raise ValueError("points without a position")
    grid = Grid(eps, metric)
    centre = table.select(
        F.col("center_lat").alias("y"), F.col("center_lon").alias("x"), "cluster", F.col("is_small").alias("small")
    )
    served = (
        grid.with_reach(centre, "y", "y", "x", "x")
        .groupBy("cy", "cx")
        .agg(F.collect_list(F.struct("cluster", "y", "x", "small")).alias("_near"))
    )
    located = attach(grid.with_cell(points, y, x), served, ["cy", "cx"])
    measured = F.transform(
        F.col("_near"),
        lambda c: F.struct(
            distance(metric, F.col(y), F.col(x), c["y"], c["x"]).alias("d"), c["cluster"].alias("k"), c["small"].alias("s")
        ),
    )
    best = F.array_min(F.filter(measured, lambda m: m["d"] <= eps))
    found = located.withColumn("_best", best)
    without = F.lit(1 if missing == "mark_anomaly" else 0)
    flag = F.when(no_position, without).when(F.col("_best").isNull() | F.col("_best.s"), F.lit(1)).otherwise(F.lit(0))
    return found.select(
        *points.columns, F.coalesce("_best.k", F.lit(-1)).alias("cluster"), flag.alias("spatial_anomaly")
    )


def nearest_city(lat: Column, lon: Column, centres: list[tuple]) -> Column:
    """``struct(d, city_id)`` of the nearest of a short fixed list of ``(id, name, lat, lon)``."""
    candidates = [
        F.struct(distance("haversine", lat, lon, F.lit(c[2]), F.lit(c[3])).alias("d"), F.lit(c[0]).alias("city_id"))
        for c in centres
    ]
    return F.least(*candidates)


OVERRIDE_M = 2000.0


def resolve_city(meters: DataFrame, districts: DataFrame, centres: list[tuple]) -> DataFrame:
    """Adds ``resolved_city``: the given city; else the city of the district name, unless
    another city's centre is more than 2 km closer; else the nearest city centre.

    ``districts`` holds ``barangay, city_id`` with unique names.
    """
    names = districts.select(F.trim("barangay").alias("_name"), F.col("city_id").alias("_mapped"))
    joined = attach(meters.withColumn("_name", F.trim("barangay")), no_larger(names, districts), ["_name"])
    lat, lon = F.col("lat"), F.col("lon")
    placed = lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0)
    nearest = F.when(placed, nearest_city(lat, lon, centres))
    to_mapped = F.lit(None).cast("double")
    for city_id, _, clat, clon in centres:
        there = distance("haversine", lat, lon, F.lit(clat), F.lit(clon))
        to_mapped = F.when(F.col("_mapped") == city_id, there).otherwise(to_mapped)
    with_near = joined.withColumn("_near", nearest).withColumn("_far", to_mapped)
    closer = F.col("_near.d") < F.col("_far") - OVERRIDE_M
    guessed = F.when(F.coalesce(closer, F.lit(False)), F.col("_near.city_id")).otherwise(
        F.coalesce("_mapped", "_near.city_id", F.lit("unknown"))
    )
    given = F.when((F.col("city_id") != "") & (F.col("city_id") != "unknown"), F.col("city_id"))
    return with_near.select(*meters.columns, F.coalesce(given, guessed).alias("resolved_city"))


def heat_points(meters: DataFrame, weight: float = 0.8) -> DataFrame:
    """Position and weighted score of the high-risk meters."""
    high = meters.where(F.upper("risk_level") == "HIGH")
    return high.select("lat", "lon", (F.col("anomaly_score") * weight).alias("intensity"))

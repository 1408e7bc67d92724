"""The nearest place of any table, anywhere on the sphere.

Positions become unit vectors, whose chords grow with the great-circle distance. Points lie in
blocks of neighbours, places in the leaves of a tree; blocks walk down the tree, one join per
level, and leave nodes that are surely farther than the farthest point of a nearer node. No
table of places is broadcast unless its size was checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import haversine_m
from ampledger.operators import separation as S
from ampledger.operators.grouped import attach
from ampledger.session import no_larger, stored

#: Places so close to the nearest one that rounding may hide which is nearer are measured again.
SLACK = 1e-9


def _unit(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def _known(lat: str, lon: str) -> Column:
    """Both coordinates are there and are numbers."""
    good = [F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (lat, lon)]
    return good[0] & good[1] & (F.abs(F.col(lat)) <= 90)


def _tree(positions: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and blocks of ``positions(id, lat, lon)``."""
    rows = positions.select(
        F.lit(0).cast("long").alias("_l"), _unit(F.col("lat"), F.col("lon")).alias("x"), F.lit(1).alias("w"),
        F.array().cast("array<double>").alias("e"), "id",
    )
    return S.build_tree(rows, 0, size)


def nearest_place(
    points: DataFrame,
    places: DataFrame,
    place: str = "place_id",
    lat: str = "lat",
    lon: str = "lon",
    output: str = "nearest",
    distance: str = "distance_m",
) -> DataFrame:
    """``points`` with the nearest of ``places(place, lat, lon)`` and its distance in metres.

    Of equally near places the smallest ``place`` is taken. Points without a position, and all
    points if there is no place, get NULL. Equal positions are looked up once; places that
    share a position are one, named by the smallest.
    """
    kind = places.schema[place].dataType
    sites = places.where(_known(lat, lon)).select(F.col(place), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    sites = sites.groupBy("lat", "lon").agg(F.min(place).alias("place"))
    sites = stored(sites.withColumn("id", F.monotonically_increasing_id()))
    wanted = points.where(_known(lat, lon)).select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).distinct()
    wanted = stored(wanted.withColumn("id", F.monotonically_increasing_id()))
    if not sites.limit(1).count() or not wanted.limit(1).count():
        return no_larger(points.withColumns({output: F.lit(None).cast(kind), distance: F.lit(None).cast("double")}), points)
    nodes, leaves = _tree(sites, S.LABEL_BLOCK)
    _, blocks = _tree(wanted, S.BLOCK)
    frontier = attach(
        blocks.select("_l", F.col("idx").alias("ti"), F.col("centre").alias("tc"), F.col("radius").alias("tr")), S.roots(nodes), ["_l"], "inner"
    )
    own = Window.partitionBy("ti")

    def settle(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = rows.withColumn("_far", S.apart("tc", "centre", 3))
        reach = F.col("tr") + F.col("radius")
        rows = rows.withColumn("_best", F.min(F.col("_far") + reach).over(own) + SLACK)
        return rows.where(F.col("_far") - reach <= F.col("_best")).select(*frontier.columns), F.col("level") == 0

    pairs = S._union(S.walk(frontier, nodes, settle)).select("ti", "idx")
    left = blocks.select(F.col("idx").alias("ti"), F.col("points").alias("a"), F.col("ids").alias("ia"))
    rows = pairs.join(left, "ti").join(leaves.select("idx", F.col("points").alias("b"), F.col("ids").alias("ib")), "idx")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"point": "long", "site": "long", "chord": "double"}
        for batch in batches:
            parts = []
            for a, ia, b, ib in zip(*[batch.column(c).to_pylist() for c in ("a", "ia", "b", "ib")]):
                a, b = (np.frombuffer(v).reshape(-1, 4)[:, :3] for v in (a, b))
                far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
                r, c = np.nonzero(far <= far.min(axis=1)[:, None] + SLACK)
                parts.append((np.frombuffer(ia, np.int64)[r], np.frombuffer(ib, np.int64)[c], far[r, c]))
                if len(parts) == S.PARTS:
                    yield S._joined(parts, schema)
                    parts = []
            yield S._joined(parts, schema)

    found = stored(rows.mapInArrow(nearest, "point long, site long, chord double"))
    least = found.groupBy("point").agg(F.min("chord").alias("least"))
    close = found.join(least, "point").where(F.col("chord") <= F.col("least") + SLACK)
    named = close.join(wanted.select(F.col("id").alias("point"), F.col("lat").alias("_y"), F.col("lon").alias("_x")), "point")
    named = named.join(sites.select(F.col("id").alias("site"), "place", "lat", "lon"), "site")
    metres = haversine_m(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon"))
    best = named.groupBy("_y", "_x").agg(F.min(F.struct(metres.alias("d"), F.col("place").alias("p"))).alias("_b"))
    best = best.select(F.col("_y").alias("_lat"), F.col("_x").alias("_lon"), F.col("_b.p").alias(output), F.col("_b.d").alias(distance))
    keyed = points.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    return no_larger(attach(keyed, best, ["_lat", "_lon"]).select(*points.columns, output, distance), points)

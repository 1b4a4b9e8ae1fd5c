"""Geographic coverage: boxes, grids, cells that split where full."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import settled


def bbox_assign(points: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id) of points inside a place's box. The whole degrees a box meets make it an equi-join."""
    cells = lambda c: F.sequence(F.floor(F.col(c) - F.col("half")), F.floor(F.col(c) + F.col("half")))
    p = places.withColumn("gx", F.explode(cells("lat"))).withColumn("gy", F.explode(cells("lon"))).select("place", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "half", "gx", "gy")
    g = points.withColumns({"gx": F.floor("lat"), "gy": F.floor("lon")})
    inside = F.col("lat").between(F.col("clat") - F.col("half"), F.col("clat") + F.col("half")) & F.col("lon").between(F.col("clon") - F.col("half"), F.col("clon") + F.col("half"))
    return g.join(p, ["gx", "gy"]).where(inside).select("place", "id")


def grid_cover(places: DataFrame, radius_km: float) -> DataFrame:
    """(place, i, j, lat, lon): centres of circles that cover each box, closer by longitude away from the equator."""
    step = radius_km * math.sqrt(2) / 111.32
    lon_step = F.lit(step) / F.greatest(F.cos(F.radians("lat")), F.lit(0.15))
    g = places.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(2 * F.col("half") / step).cast("int")))).withColumn("lon_step", lon_step)
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(2 * F.col("half") / F.col("lon_step")).cast("int"))))
    return g.select("place", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(F.col("lat") - F.col("half") + (F.col("i") + 0.5) * step, 6).alias("lat"), F.round(F.col("lon") - F.col("half") + (F.col("j") + 0.5) * F.col("lon_step"), 6).alias("lon"))


def cover_cells(points: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """grid_cover's cells with n: how many points lie in each, 0 for an empty one. A point in two places' boxes counts for both."""
    step = radius_km * math.sqrt(2) / 111.32
    inside = bbox_assign(points, places).join(points.select("id", F.col("lat").alias("y"), F.col("lon").alias("x")), "id").join(places.select("place", "lat", "lon", "half"), "place")
    lon_step = F.lit(step) / F.greatest(F.cos(F.radians("lat")), F.lit(0.15))
    at = lambda v, c, by: F.floor((F.col(v) - (F.col(c) - F.col("half"))) / by)
    n = inside.select("place", at("y", "lat", step).alias("i"), at("x", "lon", lon_step).alias("j")).groupBy("place", "i", "j").agg(F.count("*").alias("n"))
    return grid_cover(places, radius_km).join(n, ["place", "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adaptive_cells(points: DataFrame, size: float, full: int, least: float) -> DataFrame:
    """(size, gx, gy, n, complete): square cells of points; one with full points or more splits in four until half its size is below least."""
    rest, done = points.select("lat", "lon"), None
    while True:
        at = rest.withColumns({"gx": F.floor(F.col("lat") / size), "gy": F.floor(F.col("lon") / size)})
        cells = settled(at.groupBy("gx", "gy").agg(F.count("*").alias("n")), "cells")
        last = size / 2 < least
        ready = cells if last else cells.where(F.col("n") < full)
        ready = ready.select(F.lit(size).alias("size"), "gx", "gy", "n", (F.col("n") < full).alias("complete"))
        done = ready if done is None else done.union(ready)
        over = cells.where(F.col("n") >= full)
        if last or over.isEmpty():
            return done
        rest = settled(at.join(over.select("gx", "gy"), ["gx", "gy"], "left_semi").select("lat", "lon"), "cells")
        size /= 2

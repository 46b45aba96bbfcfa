"""Queries that project to planes other than the two built-in ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs, projection
from ..functions.boxes import Box
from .catalog import _C, _P, customers, parts, query

ZONE, LAMBERT = "epsg:32631", "epsg:2154"
#: Customers around 3 degrees east, within a zone.
_NEAR = f"(SELECT *, 3 + x / 60 AS lon, y * 0.9e0 AS lat FROM {_C})"


def _near(spark, sf):
    return customers(spark, sf).withColumns({"lon": F.col("x") / 60 + 3, "lat": F.col("y") * 0.9})


def _zone_sql() -> str:
    """The series written out: from latitude to the conformal one, to the sphere's plane, to the ellipsoid's."""
    p = crs.plane(ZONE)
    e, r = f"{p.e!r}::DOUBLE", f"{p.scale * p.radius!r}::DOUBLE"
    north = " + ".join(["xi", *(f"{c!r}::DOUBLE * sin({2 * k + 2} * xi) * cosh({2 * k + 2} * eta)" for k, c in enumerate(p.alpha))])
    east = " + ".join(["eta", *(f"{c!r}::DOUBLE * cos({2 * k + 2} * xi) * sinh({2 * k + 2} * eta)" for k, c in enumerate(p.alpha))])
    return f"""SELECT id, round(500000 + ({east}) * {r}, 4) AS px, round(({north}) * {r}, 4) AS py FROM (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM (
        SELECT *, tau * sqrt(1 + s * s) - s * sqrt(1 + tau * tau) AS t FROM (SELECT *, sinh({e} * atanh({e} * tau / sqrt(1 + tau * tau))) AS s FROM (SELECT *, tan(radians(lat)) AS tau, radians(lon - 3) AS l FROM {_NEAR}))))"""


@query(_zone_sql())
def project_zone(spark, sf):
    """Longitude and latitude to a zone of the transverse Mercator grid."""
    x, y = projection.project(F.col("lon"), F.col("lat"), projection.LONLAT, ZONE)
    return _near(spark, sf).select("id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


def _cone_sql(lon: str, lat: str) -> tuple[str, str]:
    p = crs.plane(LAMBERT)
    n, factor, origin = p.cone
    t = f"tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {p.e!r}::DOUBLE * sin(radians({lat}))) / (1 + {p.e!r}::DOUBLE * sin(radians({lat}))), {p.e / 2!r}::DOUBLE)"
    rho, theta = f"({factor!r}::DOUBLE * pow({t}, {n!r}::DOUBLE))", f"(radians({lon} - 3) * {n!r}::DOUBLE)"
    return f"700000 + {rho} * sin{theta}", f"6600000 + {origin!r}::DOUBLE - {rho} * cos{theta}"


@query(f"SELECT id, round({_cone_sql('lon', 'lat')[0]}, 4) AS px, round({_cone_sql('lon', 'lat')[1]}, 4) AS py FROM {_NEAR}")
def project_cone(spark, sf):
    """Longitude and latitude to a conformal cone."""
    x, y = projection.project(F.col("lon"), F.col("lat"), projection.LONLAT, LAMBERT)
    return _near(spark, sf).select("id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query(f"SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM {_NEAR}")
def project_there_and_back(spark, sf):
    """From one plane to another and back by longitude and latitude."""
    x, y = projection.project(F.col("lon"), F.col("lat"), projection.LONLAT, ZONE)
    x, y = projection.project(x, y, ZONE, LAMBERT)
    lon, lat = projection.project(x, y, LAMBERT, projection.LONLAT)
    return _near(spark, sf).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


_SIDES = "(SELECT unnest(range(20)) AS i)"
_RIM = f"""(SELECT p.id, minx / 60 + 3 + (maxx - minx) / 60 * u AS lon, 45 + miny / 60 + (maxy - miny) / 60 * v AS lat FROM {_P} p,
    (SELECT CASE WHEN i < 5 THEN i / 5e0 WHEN i < 10 THEN 1 WHEN i < 15 THEN 1 - (i - 10) / 5e0 ELSE 0 END AS u, CASE WHEN i < 5 THEN 0 WHEN i < 10 THEN (i - 5) / 5e0 WHEN i < 15 THEN 1 ELSE 1 - (i - 15) / 5e0 END AS v FROM {_SIDES}))"""


@query(f"SELECT id, round(min({_cone_sql('lon', 'lat')[0]}), 3) AS minx, round(min({_cone_sql('lon', 'lat')[1]}), 3) AS miny, round(max({_cone_sql('lon', 'lat')[0]}), 3) AS maxx, round(max({_cone_sql('lon', 'lat')[1]}), 3) AS maxy FROM {_RIM} GROUP BY id")
def project_boxes(spark, sf):
    """Boxes whose sides bend: the extremes of twenty points of their borders."""
    df = parts(spark, sf)
    box = Box(F.col("minx") / 60 + 3, F.col("miny") / 60 + 45, F.col("maxx") / 60 + 3, F.col("maxy") / 60 + 45)
    out = projection.project_box(box, projection.LONLAT, LAMBERT)
    return df.select("id", *(F.round(c, 3).alias(n) for n, c in zip(("minx", "miny", "maxx", "maxy"), out.parts())))

"""Event graph: nodes, communities, outlines (I5, I6, D28); cloud mask (I7); image append (A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.operators import communities as C
from loamwatch.operators import masks as M
from loamwatch.operators import windows as O
from loamwatch.operators.components import connected_components
from loamwatch.operators.spatial import neighbour_pairs
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.staging import staged
from loamwatch.streaming.append import append_newest


def nodes(spark, d):
    """(id, x, y, day, is_break) of the segments."""
    s = O.break_flags(X.segments(spark, d).withColumn("_at", F.struct("tStart", "flag")), ["x_coord", "y_coord"], "_at")
    return s.select(F.concat_ws("_", "x_coord", "y_coord", "flag").alias("id"), F.col("x_coord").alias("x"), F.col("y_coord").alias("y"), F.expr("tBreak div 86400000").alias("day"), "is_break")


def _graph(spark, d):
    """(nodes, edges), each made once: pairs read the nodes four times, and a node is an aggregate of all of its observations."""
    made = staged(nodes(spark, d), "event-nodes")
    return made, staged(neighbour_pairs(made, 12.0, 30), "event-edges")


def _edges(spark, d):
    return _graph(spark, d)[1]


@query("i05_communities")
def communities(spark, d):
    return C.communities(_edges(spark, d), "i", "j")


_REACH = X.with_sql("obs seg", """,
nodes AS (SELECT x_coord || '_' || y_coord || '_' || flag AS id, x_coord AS x, y_coord AS y, tBreak // 86400000 AS day, lead(tStart) OVER (PARTITION BY x_coord, y_coord ORDER BY tStart, flag) IS NOT NULL AS brk FROM seg),
edges AS (SELECT a.id AS i, b.id AS j FROM nodes a JOIN nodes b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144 WHERE a.brk <> b.brk OR (a.brk AND b.brk AND abs(a.day - b.day) < 30)),
reach(node, other) AS (SELECT DISTINCT i, i FROM edges UNION SELECT r.node, e.j FROM reach r JOIN edges e ON r.other = e.i)
SELECT node, min(other) AS component FROM reach GROUP BY 1""").replace("WITH obs", "WITH RECURSIVE obs").replace("\n,\n", ",\n")


@query("i05_components", _REACH)
def components(spark, d):
    return connected_components(_edges(spark, d), "i", "j")


_STATISTICS = _REACH.replace("SELECT node, min(other) AS component FROM reach GROUP BY 1", """, comp AS (SELECT node, min(other) AS community FROM reach GROUP BY 1)
SELECT community, count(*) AS size, round(avg(day) FILTER (WHERE brk), 4) AS mean_day, min(day) FILTER (WHERE brk) AS first_day, max(day) FILTER (WHERE brk) AS last_day FROM comp JOIN nodes ON id = node GROUP BY 1 HAVING count(*) >= 3""")


@query("d28_component_statistics", _STATISTICS)
def component_statistics(spark, d):
    """Day statistics of groups of several members; the groups are components, which SQL can find too."""
    made, edges = _graph(spark, d)
    t = made.withColumnRenamed("id", "node").join(connected_components(edges, "i", "j").withColumnRenamed("component", "community"), "node")
    return C.statistics(t, 3).withColumn("mean_day", F.round("mean_day", 4))


@query("i06_d28_outlines")
def outlines(spark, d):
    """Communities of several members with their day statistics and outline."""
    made, edges = _graph(spark, d)
    members = staged(C.communities(edges, "i", "j").join(made.withColumnRenamed("id", "node"), "node"), "members")
    rings = C.outlines(members)
    return C.statistics(members, 3).join(rings, "community").select("community", "size", F.round("mean_day", 4).alias("mean_day"), "first_day", "last_day", "points", F.size("ring").alias("corners"))


_CELLS = X.with_sql("obs", """,
cells AS (SELECT year(obs_date) AS image, (x - 500000) // 10 AS cx, (y - 4400000) // 10 AS cy, min(l_orderkey % 101) + 45 AS prob, min(l_linenumber) AS scl, min(nir) - 700 AS nir, 30.0 + year(obs_date) % 10 AS azimuth FROM obs GROUP BY 1, 2, 3, 7),
shade AS (SELECT DISTINCT image, cx + round_even(cos(radians(90 - azimuth)) * k, 0)::INT AS cx, cy + round_even(sin(radians(90 - azimuth)) * k, 0)::INT AS cy FROM cells, (SELECT unnest(range(1, 11)) AS k) WHERE prob > 50),
bad AS (SELECT c.image, c.cx, c.cy, prob > 50 OR (nir < 2000 AND scl <> 6 AND s.image IS NOT NULL) AS bad FROM cells c LEFT JOIN shade s ON c.image = s.image AND c.cx = s.cx AND c.cy = s.cy),
core AS (SELECT a.image, a.cx, a.cy FROM bad a JOIN bad b ON a.image = b.image AND abs(a.cx - b.cx) <= 2 AND abs(a.cy - b.cy) <= 2 GROUP BY ALL HAVING bool_and(b.bad))
SELECT image::INT AS image, cx::INT AS cx, cy::INT AS cy, EXISTS (SELECT 1 FROM core k WHERE k.image = c.image AND abs(k.cx - c.cx) <= 5 AND abs(k.cy - c.cy) <= 5) AS masked FROM cells c""").replace("\n,\n", ",\n")


@query("i07_cloud_mask", _CELLS)
def cloud_mask(spark, d):
    cells = X.observations(spark, d).groupBy(F.year("obs_date").alias("image"), F.expr("(x - 500000) div 10").cast("int").alias("cx"), F.expr("(y - 4400000) div 10").cast("int").alias("cy")).agg(
        (F.min(F.col("l_orderkey") % 101) + 45).alias("prob"), F.min("l_linenumber").alias("scl"), (F.min("nir") - 700).alias("nir")
    )
    return M.cloud_mask(staged(cells.withColumn("azimuth", 30.0 + F.col("image") % 10), "cells")).select("image", "cx", "cy", "masked")


@query("a16_append_newest", X.with_sql("obs", """,
old AS (SELECT * FROM obs WHERE obs_date < DATE '2000-01-01'), fresh AS (SELECT * FROM obs WHERE obs_date >= DATE '2000-01-01')
SELECT tile, x, y, obs_date, nir FROM old UNION ALL SELECT tile, x, y, obs_date, nir FROM fresh f WHERE obs_date = (SELECT max(obs_date) FROM fresh g WHERE g.tile = f.tile) AND (tile, x, y) IN (SELECT (tile, x, y) FROM old)""").replace("\n,\n", ",\n"), dates="obs_date")
def append(spark, d):
    o = X.observations(spark, d).select("tile", "x", "y", "obs_date", "nir")
    return append_newest(o.where("obs_date < DATE '2000-01-01'"), o.where("obs_date >= DATE '2000-01-01'"))

"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.tables import Tables

_TASK_EDGES = 1 << 16  # so few edges are one task's work: no shuffle of them pays


def _rows(edges: DataFrame, *rows: dict) -> DataFrame:
    """Each of ``edges`` as these rows, given as column names and values."""
    return edges.select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows])))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(a, b, m): for each directed edge, the least node among a and a's neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("m"))
    return edges.join(least, edges.a == least.u).select("a", "b", "m")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre (b) or on one edge only (as a)."""
    one, none = F.lit(1), F.lit(0)
    sides = _rows(edges, {"node": F.col("a"), "leaf": one, "centre": none}, {"node": F.col("b"), "leaf": none, "centre": one})
    roles = sides.groupBy("node").agg(F.sum("leaf").alias("edges"), F.max("centre").alias("centre"))
    return roles.filter("edges > 1 OR edges > 0 AND centre > 0").isEmpty()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the least node
    of the component.

    Each round joins larger neighbours to the least one, then smaller ones, until
    the edges form stars; rounds grow with the logarithm of the nodes. A node's
    neighbours are reduced to their least before the shuffle and, but for a few edges in all
    (``_TASK_EDGES``), never meet in one task; the result of each round is written to ``tables`` in place of the one
    before. The result reads the last one, until the next call with ``tables``."""
    stars = tables.put("stars", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("a != b").distinct())
    edge, back = {"a": F.col("a"), "b": F.col("b")}, {"a": F.col("b"), "b": F.col("a")}
    few = stars.count() <= _TASK_EDGES
    stars = stars.coalesce(1) if few else stars
    while not _are_stars(stars):  # in each edge b < a, so a star's centre is its least node
        large = (_least_neighbour(_rows(stars, edge, back)).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        small = _least_neighbour(large)  # here b < a in every row
        stars = tables.put("stars", _rows(small, {"a": F.col("b"), "b": F.col("m")}, {"a": F.col("a"), "b": F.col("m")})
                           .filter("a != b").distinct())
        stars = stars.coalesce(1) if few else stars
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

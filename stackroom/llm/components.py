"""Connected components of an edge table by alternating large and small stars.

Each round links every vertex's larger neighbours to its least neighbour (large
star) and then its smaller ones and itself likewise (small star), until the edges
are stars around the least vertex of each component. Rounds grow with the logarithm
of the largest component. Minima are aggregated before they are shuffled, and the
joins are equality joins of exchanged tables, whose hot keys adaptive execution can
split. Each round's edges are written to the shared folder; only a count and a
checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.shared import delete, materialize, scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def _round(edges: DataFrame, used: list[str]) -> DataFrame:
    """The edges after a large and a small star. Minima are written first: a join of two exchanged
    tables can be split where a vertex has very many edges, a join to an aggregate can't."""
    spark = edges.sparkSession

    def write(df: DataFrame) -> DataFrame:
        used.append(scratch(spark, "minima"))
        return materialize(df, "minima", used[-1])

    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = write(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
    lows = write(large.groupBy("hi").agg(F.min("lo").alias("m")))
    inner = large.join(lows, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return inner.union(lows.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each vertex of the edges: label is the least vertex of its component.

    Loops and repeated edges don't matter; edges with a null end are left out; no edges,
    no rows.
    """
    spark = edges.sparkSession
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    path = scratch(spark, "edges")
    now = materialize(start, "edges", path)
    state = _state(now)
    while state[0]:
        new_path, used = scratch(spark, "edges"), [path]
        new = materialize(_round(now, used), "edges", new_path)
        before, state = state, _state(new)
        for old in used:
            delete(spark, old)
        now, path = new, new_path
        if state == before:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(roots)

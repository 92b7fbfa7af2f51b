"""Connected components of a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import release, settle


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex of a pair of two different ones; the component is its smallest vertex.

    Rounds of two steps: every vertex hands its least neighbour to its larger neighbours, then to its
    smaller ones, until each edge leads to the least vertex. The number of rounds grows with the logarithm
    of the graph. Each round is a table in the shared folder, so a lost executor costs one round. Runs jobs.
    """
    edges = settle(_edges(pairs, F.col(a), F.col(b)))
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        last, edges = edges, settle(_edges(smaller, F.col("e.u"), F.col("e.m")))
        release(last)
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def _edges(pairs: DataFrame, a, b) -> DataFrame:
    """(u, v) with u > v, each once."""
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())

"""Connected components of an edge table by alternating large-star and small-star steps.

Every round joins the edges with the smallest neighbour of each node and writes the result to the shared folder;
nothing but two numbers a round reaches the driver. The edge count never grows beyond twice the input's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.skew import splittable_join
from lightsieve.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return splittable_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = splittable_join(edges, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 50) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node it reaches. Loops and nulls are ignored."""
    a, b = F.col(src), F.col(dst)
    pairs = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = materialize(pairs, "edges")
    state = _fingerprint(current)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        rounds, current = current, materialize(_small_star(_large_star(current)), "edges")
        discard(rounds)
        before, state = state, _fingerprint(current)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

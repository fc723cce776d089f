"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of links(src, dst); null and self links are ignored.

    Alternates large-star and small-star steps until no link changes; each step pre-aggregates the minimum before its
    shuffle, so a node with very many links is no single task's list.
    """
    edge = links.filter("src is not null and dst is not null and src <> dst").selectExpr("greatest(src, dst) as u", "least(src, dst) as v").distinct()
    edge = materialize(edge, "links")
    before = None
    for _ in range(max_rounds):
        both = edge.select("u", "v").union(edge.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("v as u", "m as v").filter("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").union(low.selectExpr("u", "m as v")).filter("u <> v")
        edge = materialize(small.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "small-star")
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edge.selectExpr("u as node", "v as component").union(edge.selectExpr("v as node", "v as component")).distinct()

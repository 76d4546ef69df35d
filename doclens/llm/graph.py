"""Connected components of a link table, by label passing and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import discard, hot_join, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the smallest node that links reach, itself included.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step is one
    grouped minimum and one join, the links never grow in number, and the rounds are
    logarithmic in practice. Nodes without links are not returned. Null ends link nothing.
    A hot node spreads: the minimum is pre-aggregated and its links are joined in shares. Each round ends in the shared folder.
    """
    edges = written(
        links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before, total = None, edges.count()
    while True:
        # Large star: each node's larger neighbours point to its smallest neighbour or itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, ["a"], "n", ["b"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, point to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, ["a"], "n", ["b"], total).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, edges = edges, written(small, "links")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before, total = now, now[0]
    roots = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())

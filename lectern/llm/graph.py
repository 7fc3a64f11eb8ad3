"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import forget, settle


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours.

    The join is on the complement of u, so that it gets shuffles of its own: adaptive execution can split a hub's rows there,
    which it can't do where a join reuses the distribution of an aggregate.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("key"), F.least("u", "m").alias("m"))
    return pairs.withColumn("key", F.bitwise_not("u")).join(least, "key").drop("key")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the least node of the component.

    Alternates large stars (hang larger neighbours on the least one) and small stars (hang smaller neighbours on the least one)
    until the edges stay the same. Every round writes its edges to the shared folder, so lost executors cost one round at most.
    Edge cases (tests/llm/test_graph.py): self-loops, repeated edges and edges with a null end are ignored; a table without edges gives
    no rows; further columns of any name are left out.
    """
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large).select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, settle(small.where("u <> v").distinct(), "edges")
        forget(before)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

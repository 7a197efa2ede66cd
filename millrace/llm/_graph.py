"""Connected components of an edge table, by contraction: no vertex's edges meet in one task, nothing goes to the
driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs, in any order, repeated or not -> (id, component): for each vertex of an edge the smallest
    vertex that it reaches.

    In each round every vertex points to the smallest of itself and its neighbours, pointers are followed once more,
    and the edges are carried over to what their ends point to; edges within one vertex go.  The rounds end when no
    edge is left; a star goes in one round, a path of n vertices in about log n."""
    left = written(_apart(edges.select("a", "b")), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "pointers")
        again = up.select(F.col("id").alias("__id"), F.col("to").alias("__to"))
        up = written(up.join(again, F.col("to") == F.col("__id")).select("id", F.col("__to").alias("to")), "pointers")
        steps.append(up)
        tail, head = up.select(F.col("id").alias("a"), F.col("to").alias("ta")), up.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        left = written(_apart(left.join(tail, "a").join(head, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    out = steps[0].select("id", F.col("to").alias("component"))
    for up in steps[1:]:
        out = out.join(up.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(out, "components")


def _apart(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.filter(F.col("a") != F.col("b")).select(low, high).distinct()

"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.sources.staging import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(back)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the ``a, b`` pairs of ``edges``.

    ``root`` names the component; which member it is, is not specified. Each
    round hooks every id to its smallest neighbour, follows two hooks, and
    contracts the edges; a star or a group around one member needs one round
    and a chain logarithmically many. Nothing is collected, and a member with
    very many neighbours is an aggregate and the skewed side of a join to a
    table with unique keys.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    members = None
    while not edges.isEmpty():
        hook = stage(
            _both_ways(edges).groupBy("a").agg(F.min("b").alias("b"))
            .select(F.col("a").alias("id"), F.least("a", "b").alias("up")),
            "hooks",
        )
        for _ in range(2):
            above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select(
                "id", F.coalesce("top", "up").alias("up")
            )
        hook = stage(hook, "roots")
        a = hook.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        b = hook.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = stage(
            edges.join(a, "a").join(b, "b").where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        if members is None:
            members = hook.withColumnRenamed("up", "root")
        else:
            up = hook.select(F.col("id").alias("root"), "up")
            members = stage(
                members.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")),
                "members",
            )
    if members is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members

"""Connected components of an undirected graph by contraction.

Each round every vertex hooks to its smallest neighbour if that is smaller, chains of hooks are followed to their ends
by pointer jumping, and the graph shrinks to the ends; with vertices in hash order the rounds are few.  All steps are
joins and minima on stored frames: nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import pin


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, root: one row per vertex of `links` (two columns of one type); equal roots mean one component."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    rounds = []
    while not edges.isEmpty():
        hooks = _follow(_hook(edges))
        rounds.append(hooks)
        ends_a = hooks.select(F.col("vertex").alias("a"), F.col("root").alias("ra"))
        ends_b = hooks.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
        edges = pin(
            edges.join(ends_a, "a")
            .join(ends_b, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).limit(0)
    return reduce(_through, rounds)


def _hook(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("a"), F.min("b")).alias("root"))


def _follow(hooks: DataFrame) -> DataFrame:
    """Replace each vertex's hook by the end of its chain."""
    hooks, moved = pin(hooks), True
    while moved:
        ends = hooks.select(F.col("vertex").alias("root"), F.col("root").alias("end"))
        jumped = pin(hooks.join(ends, "root").select("vertex", "root", "end"))
        moved = not jumped.where("root <> end").isEmpty()
        hooks = jumped.select("vertex", F.col("end").alias("root"))
    return hooks


def _through(first: DataFrame, later: DataFrame) -> DataFrame:
    ends = later.select(F.col("vertex").alias("root"), F.col("root").alias("end"))
    return first.join(ends, "root", "left").select("vertex", F.coalesce("end", "root").alias("root"))

"""Connected components of a link table, and ends of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace


def followed(pointers: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root): where the pointers (node, root) lead in the end; they must not run in circles.

    Each round doubles the distance that is looked ahead, and only nodes that
    haven't come to their end go into the next one.
    """
    done, active, step = None, pointers, 0
    while True:
        every = active if done is None else active.unionByName(done)
        ahead = every.select(F.col("node").alias("at"), F.col("root").alias("to"))
        moved = work.save(active.join(ahead, F.col("root") == F.col("at"), "left").select(
            "node", F.coalesce("to", "root").alias("root"), F.coalesce(F.col("to") != F.col("root"), F.lit(False)).alias("moved")), f"{name}_{step}")
        still = moved.where("NOT moved").select("node", "root")
        done, active, step = still if done is None else done.unionByName(still), moved.where("moved").select("node", "root"), step + 1
        if active.isEmpty():
            return done


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the smallest node of the component.

    Rounds of contraction: every node points to its smallest neighbour or to
    itself, pointers are followed to their ends, links are moved to those
    ends, and links within one end go.  Every table is written, so each round
    starts from files and a lost executor costs no earlier round.
    """
    links = work.save(links.select("a", "b").where("a <> b"), f"{name}_links")
    roots, step = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = work.save(both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("root")), f"{name}_ends{step}")
        ends = followed(ends, work, f"{name}_jump{step}")
        to = ends.select(F.col("node").alias("at"), F.col("root").alias("to"))
        if roots is None:
            roots = ends
        else:
            roots = work.save(roots.join(to, F.col("root") == F.col("at"), "left").select(
                "node", F.coalesce("to", "root").alias("root")), f"{name}_roots{step}")
        left = links.join(to, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        left = left.join(to.withColumnRenamed("to", "to_b"), F.col("b") == F.col("at")).select("a", F.col("to_b").alias("b"))
        links, step = work.save(left.where("a <> b").distinct(), f"{name}_left{step}"), step + 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots

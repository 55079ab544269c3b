"""Connected components of a link table, by joins that halve paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import cut

MAX_ROUNDS = 60
IN_A_TASK = 20_000  # links; up to so many are one partition, of which Spark shuffles nothing, however many it would deal others over


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), in either direction, repeats allowed -> node, root: every linked node and the least node it reaches.

    Alternates two star steps: every node hands its larger neighbours, then its smaller ones, to the least
    neighbour it knows.  Each step is an aggregate and a join on one key, so a node with very many neighbours is
    combined before the shuffle and split by the skew join; rounds grow with the logarithm of the longest path.
    Links are checkpointed each round; few of them (``IN_A_TASK``) in one partition, as a round has a dozen shuffles and each makes
    as many tasks as there are shuffle partitions.  A null end or a link of a node to itself links nothing.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    few = edges.count() <= IN_A_TASK  # rounds add no links

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows  # else Spark would deal both sides over all partitions again

    edges, before = dealt(edges), None
    for _ in range(MAX_ROUNDS):
        both = dealt(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sent(least), "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Now from each node to its smaller neighbours.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(sent(least), "hi")
        edges = dealt(cut(dealt(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))).distinct()))
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return dealt(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots))

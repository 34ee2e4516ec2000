"""Connected components of a link table by randomised contraction, as joins and grouped minima.

Each round orders the nodes by a hash of its own and sends every node to the least
node among itself and its neighbours; links between nodes that were sent to different
places go on, each once. About a third of the nodes or fewer are left after a round
whatever the graph looks like, so long chains and large stars end after few rounds and
the links shrink all the while. The rounds are then followed back to the first nodes.
Grouped minima are combined before the shuffle, so a node with very many links costs
no more than its links; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.session import stage_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the links (long ids) with the smallest node it
    can reach. Self links, repeated links and either direction are fine; nulls are
    ignored; no links give no rows."""
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = stage_table(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        seed = F.lit(len(rounds))
        ranked = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("node"))
        both = edges.union(edges.select("v", "u"))
        sent = both.groupBy("u").agg(F.min(ranked("v")).alias("least")).select(F.col("u").alias("node"), F.least("least", ranked("u")).getField("node").alias("to"))
        sent = stage_table(sent, "cc-sent")
        rounds.append(sent)
        moved = edges.join(sent.toDF("u", "p"), "u").join(sent.toDF("v", "q"), "v").where("p <> q")
        edges = stage_table(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "cc-edges")
    ended = rounds.pop()
    while rounds:
        ended = rounds.pop().join(ended.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ended = stage_table(ended, "cc-ended")
    return ended.join(ended.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def group_sizes(components: DataFrame) -> DataFrame:
    """component and its number of nodes."""
    return components.groupBy("component").agg(F.count("*").alias("n_members"))

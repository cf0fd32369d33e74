"""Connected components of a graph given as edges, with DataFrame operations only.

Randomised contraction: in each round every node picks, from itself and its neighbours, the one that comes
first in an order drawn for that round; edges are then drawn between the picked nodes and doubles vanish.
The expected number of edges falls by a constant factor in each round, whatever the shape of the graph, so
long chains and hubs both end after few rounds. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import landed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes of `edges` as (node, component); `component` is one of the nodes in it, the same for all of them.

    Null ends, loops and repeated edges are allowed and ignored. No edges give no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    graph = landed(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label, round_no = None, 0
    while not graph.isEmpty():
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.xxhash64(F.lit(round_no), c)  # noqa: B023, E731  one to one for numbers
        picks = both.groupBy("u").agg(F.min_by("v", order(F.col("v"))).alias("v"))
        picks = landed(
            picks.select("u", F.when(order(F.col("v")) < order(F.col("u")), F.col("v")).otherwise(F.col("u")).alias("pick")),
            "picks",
        )
        if label is None:
            label = picks.select(F.col("u").alias("node"), F.col("pick").alias("component"))
        else:
            moved = label.join(picks, label["component"] == picks["u"], "left")
            label = landed(moved.select("node", F.coalesce("pick", "component").alias("component")), "labels")
        left = picks.select("u", F.col("pick").alias("x"))
        right = picks.select(F.col("u").alias("v"), F.col("pick").alias("y"))
        drawn = graph.join(left, "u").join(right, "v").filter("x <> y")
        graph = landed(drawn.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        round_no += 1
    if label is None:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label

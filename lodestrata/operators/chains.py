"""References between rows: do they point back, where do chains end, which run in circles?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut


def unreciprocated(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Corrections that one side only knows: id, old and problem.

    ``newer`` (id, old) says what a row replaces, ``older`` (id, superseded_by) what has replaced a row.
    ``not_acknowledged``: the old row names another successor or none; ``not_claimed``: the named successor doesn't say so;
    ``unknown``: the old row isn't there.
    """
    pairs = newer.filter("old is not null").select("id", "old").distinct().withColumn("said", F.lit(True))
    back = older.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("old")).distinct().withColumn("back", F.lit(True))
    known = older.select(F.col("id").alias("old")).distinct().withColumn("known", F.lit(True))
    both = pairs.join(back, ["id", "old"], "full").filter("said is null or back is null").join(known, "old", "left")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("said").isNull(), "not_claimed").otherwise("not_acknowledged")
    return both.select("id", "old", problem.alias("problem"))


def chains(links: DataFrame, node: str, follows: str) -> DataFrame:
    """Where each node's chain of references ends: node, root, hops, cyclic and on_cycle.

    ``links`` has each node once, with the node it refers to or null. The root is the last node, ``hops`` links away; a chain that runs into a
    cycle has the cycle's smallest node as its root and no hops. A reference to a node that isn't there ends the chain before it.
    Pointers are doubled: a round joins what is still open with itself, so chains of n links take about log2(n) rounds; after
    as many rounds as the number of nodes allows, what is open runs in a circle. Each round is written to the shared folder.
    """
    base = links.select(F.col(node).alias("node"), F.col(follows).alias("to"))
    known = base.select(F.col("node").alias("to")).withColumn("known", F.lit(True))
    joined = base.join(known, "to", "left").select("node", F.when(F.col("known"), F.col("to")).alias("next"))
    state = cut(joined.select("node", F.coalesce("next", "node").alias("to"), F.col("next").isNotNull().cast("long").alias("hops"), F.least("node", F.coalesce("next", "node")).alias("low")))
    # a node is open while the one it points at goes on
    ends = state.filter("hops = 0").select(F.col("node").alias("end"))
    state = cut(state.join(ends, state["to"] == ends["end"], "left").select("node", "to", "hops", "low", F.col("end").isNull().alias("open")))
    nodes, reach = state.count(), 1
    left = state.filter("open").count()
    while left and reach < nodes:
        onward = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        moved = state.filter("open").join(onward, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"))
        state = cut(state.filter(~F.col("open")).unionByName(moved))
        reach *= 2
        left = state.filter("open").count()
    if not left:
        return state.select(F.col("node").alias(node), F.col("to").alias("root"), "hops", F.lit(False).alias("cyclic"), F.lit(False).alias("on_cycle"))
    # after as many steps as there are nodes every open pointer lies on its cycle, and its own way there has been all around it
    cycles = state.filter("open").select(F.col("to").alias("at")).distinct()
    named = cycles.join(state, F.col("at") == F.col("node")).select("at", F.col("low").alias("least"))
    turned = state.join(named, F.col("to") == F.col("at"), "left").drop("at")
    own = named.select(F.col("at").alias("own"))
    marked = turned.join(own, F.col("node") == F.col("own"), "left")
    return marked.select(F.col("node").alias(node), F.when(F.col("open"), F.col("least")).otherwise(F.col("to")).alias("root"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.col("open").alias("cyclic"), F.col("own").isNotNull().alias("on_cycle"))

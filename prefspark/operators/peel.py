"""H7 for graphs of any size: is each graph of an edge table acyclic?

A round trims: edges into nodes without a way out, and edges out of nodes without a way
in, lie on no cycle and go. A graph in which a round trims nothing, while it has edges
left, has a cycle, since every node left has a way out; so has one with an edge from a node
to itself. A graph whose edges are all gone has none. So that a long chain doesn't take a
round a node, a round also contracts nodes with one way in and one way out: of such
neighbours a coin by node and round picks some no two of which are adjacent,
and the edges on both sides of a picked one become one edge. That keeps cycles and
their absence, and halves chains in a few rounds.

A round counts the ways in and out of nodes with a partial aggregation in every task,
so a node on a third of all edges is a row for each task, and writes the edges that are
left as a table; a lost executor repeats one round. Nothing of a graph meets
in one row, task or the driver, which reads counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import materialize


def _nodes(edges: DataFrame, salt: int) -> DataFrame:
    """(g, n, goes, comes, only_to, picked) of every node: numbers of edges out and in, and whether it is contracted."""
    ends = edges.select("g", F.inline(F.array(
        F.struct(F.col("s").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in"), F.col("d").alias("to"), F.lit(None).cast(edges.schema["s"].dataType).alias("frm")),
        F.struct(F.col("d").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in"), F.lit(None).cast(edges.schema["d"].dataType).alias("to"), F.col("s").alias("frm")))))
    nodes = ends.groupBy("g", "n").agg(F.sum("out").alias("goes"), F.sum("in").alias("comes"), F.min("to").alias("only_to"), F.min("frm").alias("only_from"))
    coin = lambda c: F.pmod(F.xxhash64(F.lit(salt), "g", c), F.lit(2)) == 1
    return nodes.withColumn("picked", (F.col("goes") == 1) & (F.col("comes") == 1) & coin("n") & ~coin("only_from")).drop("only_from")


def acyclic_graphs(edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst", graphs: DataFrame | None = None) -> DataFrame:
    """(keys..., acyclic) for every graph of ``edges``, and for those of ``graphs`` (its key columns) without edges.

    Repeated edges count once; an edge with a null end is no edge; null keys are a graph of
    their own. Nodes are told apart within their graph."""
    spark = edges.sparkSession
    keys = list(keys)
    named = edges.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("g"), F.col(f"`{src}`").alias("s"), F.col(f"`{dst}`").alias("d"))
    every = named.select("g")
    if graphs is not None:
        every = every.unionByName(graphs.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("g")))
    left = materialize(named.where("s IS NOT NULL AND d IS NOT NULL").distinct(), "peel")
    cyclic = None
    salt = 0
    while not left.isEmpty():
        nodes = materialize(_nodes(left, salt), "peel-nodes")
        # a loop, or no node that could be trimmed
        own = nodes.groupBy("g").agg(F.min(F.least("goes", "comes")).alias("least"))
        loops = left.where("s = d").select("g").distinct()
        found = materialize(own.where("least > 0").select("g").unionByName(loops).distinct(), "peel-cyclic")
        cyclic = found if cyclic is None else cyclic.unionByName(found)
        at = lambda side, *cols: nodes.select(F.col("g").alias(f"{side}g"), F.col("n").alias(f"{side}n"), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        s, d = at("s", "comes", "picked"), at("d", "goes", "picked", "only_to")
        more = (left.join(found, "g", "left_anti")
                .join(s, (F.col("g") == F.col("sg")) & (F.col("s") == F.col("sn")))
                .join(d, (F.col("g") == F.col("dg")) & (F.col("d") == F.col("dn")))
                .where("s_comes > 0 AND d_goes > 0 AND NOT s_picked")
                .select("g", "s", F.when(F.col("d_picked"), F.col("d_only_to")).otherwise(F.col("d")).alias("d")).distinct())
        left = materialize(more, "peel")
        salt += 1
    every = every.distinct()
    if cyclic is None:
        flagged = every.withColumn("acyclic", F.lit(True))
    else:
        c = cyclic.select(F.col("g").alias("cg")).distinct()
        flagged = every.join(c, F.col("g") == F.col("cg"), "left").withColumn("acyclic", F.col("cg").isNull())
    return flagged.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], "acyclic")

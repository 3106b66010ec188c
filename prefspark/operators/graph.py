"""Per-prompt preference graphs over an explicit player axis.

Plan for every operator here: ONE keyed aggregation turns the long player
rewards into a row per (split, prompt) holding an A x P reward matrix
(``R[a][p]``, conditional max, partial aggregation map-side). All pairwise
work then happens inside that row with array higher-order functions (no
shuffle, no self-join, no pair rows). P comes from an explicit player list
(the bound on what one row holds). A node's out-edges are ceil(P / 64) bigint
words of a bitmask; one kernel serves every P.

The kernels are written as Spark SQL text (``F.expr``): the same expressions
as the Column DSL, but the plan is built with one call instead of hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.core import ATTRIBUTES


def _seq(P: int) -> str:
    return f"sequence(0, {P - 1})"


def _sig(x: str) -> str:
    return f"(1D / (1D + exp(-({x}))))"


def prompt_matrix(players_long: DataFrame, n_players: int,
                  attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(split, prompt_id, R array<array<double>>): R[a][p] = reward of player p on attribute a."""
    if n_players < 1:
        raise ValueError(f"player count must be positive, got {n_players}")
    x = players_long.filter(F.col("attribute").isin(list(attributes)))
    aggs = [F.expr(f"max(CASE WHEN attribute = '{a}' AND player = {p} THEN reward END) AS _{ai}_{p}")
            for ai, a in enumerate(attributes) for p in range(n_players)]
    g = x.groupBy("split", "prompt_id").agg(*aggs)
    rows = ", ".join("array(" + ", ".join(f"_{ai}_{p}" for p in range(n_players)) + ")"
                     for ai in range(len(attributes)))
    return g.select("split", "prompt_id", F.expr(f"array({rows})").alias("R"))


# ---------------------------------------------------------------- SQL kernels
def diff_sql(v: str, P: int) -> str:
    """D13 core: D[i][j] = v[i] - v[j]."""
    return f"transform({_seq(P)}, i -> transform({_seq(P)}, j -> {v}[i] - {v}[j]))"


def bt_probability_sql(R: str, P: int) -> str:
    """E8 core: P[i][j] = mean over attributes of sigmoid(R[a][i] - R[a][j]) (fixed order);
    every NaN is the same one, whatever sign the arithmetic gave it."""
    s = f"aggregate({R}, 0D, (acc, v) -> acc + {_sig('v[i] - v[j]')}) / size({R})"
    return f"transform({_seq(P)}, i -> transform({_seq(P)}, j -> nanvl({s}, double('NaN'))))"


def _words(P: int) -> int:
    return (P + 63) // 64


def _word_range(w: str, P: int) -> str:
    return f"sequence({w} * 64, least({w} * 64 + 63, {P - 1}))"


def _has(row: str, j: str) -> str:
    return f"(({row}[{j} div 64] & shiftleft(1L, {j} % 64)) != 0)"


def adjacency_sql(R: str, P: int) -> str:
    """H6 core: out-edge words per node. i -> j when strictly more than half of
    the attributes give sigmoid(r_i - r_j) < 0.5 (exactly half: no edge)."""
    votes = f"size(filter({R}, v -> {_sig('v[i] - v[j]')} < 0.5D))"
    W = _words(P)
    return (f"transform({_seq(P)}, i -> transform(sequence(0, {W - 1}), wd -> aggregate({_word_range('wd', P)}, 0L, "
            f"(m, j) -> m | IF({votes} * 2 > size({R}), shiftleft(1L, j % 64), 0L))))")


def in_degree_sql(adj: str, j: str) -> str:
    return f"aggregate({adj}, 0, (c, row) -> c + CAST({_has('row', j)} AS INT))"


def acyclic_sql(adj: str, P: int) -> str:
    """H7 core: peel all sinks (no out-edge into the alive set) P times; a DAG
    ends with nothing alive."""
    W = _words(P)
    last = P - 64 * (W - 1)
    full = ", ".join(["-1L"] * (W - 1) + ["-1L" if last == 64 else f"{(1 << last) - 1}L"])
    no_out = f"aggregate(sequence(0, {W - 1}), true, (ok, v) -> ok AND ({adj}[k][v] & alive[v]) = 0)"
    sinks = (f"transform(sequence(0, {W - 1}), wd -> aggregate({_word_range('wd', P)}, 0L, (s, k) -> s | "
             f"IF({_has('alive', 'k')} AND {no_out}, shiftleft(1L, k % 64), 0L)))")
    left = (f"aggregate(sequence(1, {P}), array({full}), "
            f"(alive, r) -> zip_with(alive, {sinks}, (a, b) -> a & ~b))")
    return f"forall({left}, x -> x = 0)"


def condorcet_sql(adj: str, P: int) -> str:
    """H8 core: the node every other node points to (in-degree P-1), else null."""
    return f"get(filter({_seq(P)}, w -> {in_degree_sql(adj, 'w')} = {P - 1}), 0)"


def sinks_sql(adj: str, P: int) -> str:
    """H9 core: nodes with in-degree > 0 and out-degree 0."""
    return f"filter({_seq(P)}, u -> forall({adj}[u], x -> x = 0) AND {in_degree_sql(adj, 'u')} > 0)"


_EDGES = "aggregate(a, 0, (c, row) -> c + aggregate(row, 0, (d, x) -> d + bit_count(x)))"


# Column versions (take column names)
def adjacency(R: str, P: int) -> Column:
    return F.expr(adjacency_sql(R, P))


def is_acyclic(adj: str, P: int) -> Column:
    return F.expr(acyclic_sql(adj, P))


def condorcet_winner(adj: str, P: int) -> Column:
    return F.expr(condorcet_sql(adj, P))


def sink_nodes(adj: str, P: int) -> Column:
    return F.expr(sinks_sql(adj, P))


# ---------------------------------------------------------------- operators
def player_cross(players_long: DataFrame, n_players: int) -> DataFrame:
    """All ordered player pairs of a (split, attribute, prompt) as a P x P
    difference matrix in one row (instead of P^2 rows)."""
    P = n_players
    g = players_long.groupBy("split", "attribute", "prompt_id").agg(
        *[F.expr(f"max(CASE WHEN player = {p} THEN reward END) AS _p{p}") for p in range(P)])
    v = "array(" + ", ".join(f"_p{p}" for p in range(P)) + ")"
    return g.select("split", "attribute", "prompt_id", F.expr(diff_sql(v, P)).alias("diff"))


def bt_probability_mean(players_long: DataFrame, n_players: int,
                        attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(split, prompt_id, prob array<array<double>>)."""
    m = prompt_matrix(players_long, n_players, attributes)
    return m.select("split", "prompt_id", F.expr(bt_probability_sql("R", n_players)).alias("prob"))


def preference_graph(players_long: DataFrame, n_players: int,
                     attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """H6: (split, prompt_id, adjacency array<array<bigint>>, n_edges)."""
    m = prompt_matrix(players_long, n_players, attributes)
    # bind the adjacency once as a lambda variable: the optimizer would
    # otherwise inline its expression at every reference
    g = f"transform(array({adjacency_sql('R', n_players)}), a -> named_struct('adjacency', a, 'n_edges', {_EDGES}))[0]"
    return m.select("split", "prompt_id", F.expr(g).alias("g")).select("split", "prompt_id", "g.*")


def edge_rows(graph: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., src, dst): a row for each bit of the adjacency words."""
    words = graph.select(*keys, F.posexplode("adjacency").alias("src", "_words")).select(*keys, "src", F.posexplode("_words").alias("_w", "_mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.getbit("_mask", j) == 1)
    return words.select(*keys, "src", "_w", F.explode(bits).alias("_j")).select(*keys, "src", (F.col("_w") * 64 + F.col("_j")).alias("dst"))


def graph_report(players_long: DataFrame, n_players: int,
                 attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """H7 + H8 + H9 per prompt: acyclic flag, Condorcet winner, sink nodes."""
    P = n_players
    m = prompt_matrix(players_long, P, attributes)
    rep = (f"transform(array({adjacency_sql('R', P)}), a -> named_struct("
           f"'acyclic', {acyclic_sql('a', P)}, 'condorcet_idx', {condorcet_sql('a', P)}, "
           f"'sinks', {sinks_sql('a', P)}))[0]")
    return m.select("split", "prompt_id", F.expr(rep).alias("r")).select("split", "prompt_id", "r.*")


def cycle_stats(report: DataFrame) -> DataFrame:
    """Per split, share of prompts with a cycle and without a Condorcet winner."""
    g = report.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum((~F.col("acyclic")).cast("long")).alias("n_cyclic"),
        F.sum(F.col("condorcet_idx").isNull().cast("long")).alias("n_no_condorcet"))
    return g.select("split", "n_prompts", "n_cyclic", "n_no_condorcet",
                    (F.col("n_cyclic") / F.col("n_prompts")).alias("cyclic_share"),
                    (F.col("n_no_condorcet") / F.col("n_prompts")).alias("no_condorcet_share"))


def condorcet_histogram(report: DataFrame) -> DataFrame:
    """Winner index counts (the reference's list of winners, as a keyed count)."""
    return (report.filter(F.col("condorcet_idx").isNotNull())
            .groupBy("split", F.col("condorcet_idx").alias("player")).agg(F.count(F.lit(1)).alias("n_wins")))

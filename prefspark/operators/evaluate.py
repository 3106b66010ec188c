"""Model comparison reports over a long reward table.

Input: ``rewards(model, split, attribute, prompt_id, completion_idx, reward)``,
one row per cell. Every report is a keyed aggregation (map-side partial
aggregation first, so a hot prompt or model never piles up raw rows in one
task). The baseline value of a cell is attached by a window over the full
cell key (one row per model), never by joining the table with itself; the
only cumulative window (F1) is the operator's own definition. Indicator means
are integer sums divided once, so results are exact and engine independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.core import ATTRIBUTES, nan, ieee_ge, require_columns

CELL = ["split", "attribute", "prompt_id", "completion_idx"]


def _i(c: Column) -> Column:
    return c.cast("long")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den)


# ---------------------------------------------------------------- E2 / E3 / C8
def reward_summary(rewards: DataFrame) -> DataFrame:
    """Per (model, split, attribute): NaN-skipping mean, NaN count, max-min range.

    The range is NaN as soon as one reward is NaN (max/min of a NaN tensor).
    """
    require_columns(rewards, "model", "split", "attribute", "reward")
    r = F.col("reward")
    n_nan = F.sum(_i(F.isnan(r)))
    return rewards.groupBy("model", "split", "attribute").agg(
        F.count(F.lit(1)).alias("n_rewards"),
        n_nan.alias("nan_count"),
        F.avg(F.when(~F.isnan(r), r)).alias("mean_reward"),
        F.when(n_nan > 0, nan()).otherwise(F.max(r) - F.min(r)).alias("reward_range"),
    )


def _row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-missing (non-null, non-NaN) values, fixed summation order."""
    vals = [F.when(~F.isnan(c), c) for c in cols]
    total = vals[0].isNull().cast("int") * 0.0
    for v in vals:
        total = total + F.coalesce(v, F.lit(0.0))
    n = sum((v.isNotNull().cast("int") for v in vals[1:]), vals[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def reward_summary_pivot(summary: DataFrame, splits=("train", "validation"),
                         attributes: Sequence[str] = ATTRIBUTES, value: str = "mean_reward") -> DataFrame:
    """One row per model, a column per (split, attribute) and a per-split mean.

    The pivot has an explicit value list (no extra job to discover values).
    """
    aggs = []
    for s in splits:
        for a in attributes:
            aggs.append(F.max(F.when((F.col("split") == s) & (F.col("attribute") == a), F.col(value)))
                        .alias(f"{s}_{a}"))
    wide = summary.groupBy("model").agg(*aggs)
    for s in splits:
        wide = wide.withColumn(f"{s}_mean", _row_mean([F.col(f"{s}_{a}") for a in attributes]))
    return wide


def sort_by_score(df: DataFrame, score: str, key: str = "model") -> DataFrame:
    """Order a per-model report by ``score`` descending; the rank is kept as a column.

    The input has one row per model (already aggregated), so the ordering
    window runs over a table whose size is the number of models.
    """
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return df.withColumn("score_rank", F.row_number().over(w)).orderBy("score_rank")


# ---------------------------------------------------------------- players
def player_index(players: Sequence[tuple[str, str, int]]) -> tuple[Column, Column]:
    """(index, name) columns for rows matching an explicit player list.

    ``players`` = [(name, model, completion_idx), ...]. Non-players get null.
    """
    idx = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for k, (nm, model, c) in enumerate(players):
        hit = (F.col("model") == model) & (F.col("completion_idx") == c)
        idx = F.when(hit, F.lit(k)).otherwise(idx)
        name = F.when(hit, F.lit(nm)).otherwise(name)
    return idx, name


def round_robin_tournament(rewards: DataFrame, players: Sequence[tuple[str, str, int]]) -> DataFrame:
    """W[i,j] = mean over (attribute, prompt) of 1[r_i >= r_j] for i < j,
    W[j,i] = 1 - W[i,j], W[i,i] = 0. Per split. Long output
    (split, player_i, player_j, win_rate).

    Plan: one shuffle groups each (split, attribute, prompt) cell into a row of
    P player rewards (conditional max, partial aggregation map-side); each cell
    then gives its P(P-1)/2 indicators to a hash aggregation on (split, i, j),
    which folds them before the shuffle. No self-join.
    """
    P = len(players)
    if P < 2:
        raise ValueError("need at least two players")

    def q(name):
        return "'" + name.replace("'", "''") + "'"

    pidx = "CASE " + " ".join(f"WHEN model = {q(m)} AND completion_idx = {c} THEN {k}"
                              for k, (_, m, c) in enumerate(players)) + " END"
    x = rewards.select("split", "attribute", "prompt_id", "reward", F.expr(pidx).alias("p")) \
        .filter(F.col("p").isNotNull())
    cells = x.groupBy("split", "attribute", "prompt_id").agg(
        *[F.expr(f"max(CASE WHEN p = {k} THEN reward END) AS r{k}") for k in range(P)])
    # written as SQL text so the plan is built with one call per expression
    # (the Column DSL needs dozens each)
    pair = ("named_struct('i', {i}, 'j', {j}, 'n', CAST(r{i} IS NOT NULL AND r{j} IS NOT NULL AS BIGINT), 'w', "
            "CAST(coalesce(NOT isnan(r{i}) AND NOT isnan(r{j}) AND r{i} >= r{j}, false) AS BIGINT))")
    pairs = ", ".join(pair.format(i=i, j=j) for i in range(P) for j in range(i + 1, P))
    tot = (cells.select("split", F.expr(f"inline(array({pairs}))"))
           .groupBy("split", "i", "j").agg(F.sum("w").alias("w"), F.sum("n").alias("n")))
    names = f"array({', '.join(q(p[0]) for p in players)})"
    rate = "CASE WHEN n > 0 THEN CAST(w AS DOUBLE) / n END"
    row = "named_struct('player_i', {names}[{i}], 'player_j', {names}[{j}], 'win_rate', {rate})"
    rows = [row.format(names=names, i="i", j="j", rate=rate), row.format(names=names, i="j", j="i", rate=f"1.0D - ({rate})")]
    # a player against itself comes with its first pair, the last player's with the last pair
    zero = "CAST(0.0 AS DOUBLE)"
    rows += [f"IF(j = i + 1, {row.format(names=names, i='i', j='i', rate=zero)}, NULL)",
             f"IF(i = {P - 2} AND j = {P - 1}, {row.format(names=names, i='j', j='j', rate=zero)}, NULL)"]
    return tot.selectExpr("split", f"inline(array_compact(array({', '.join(rows)})))")


def tournament_matrix(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Matrix view of E4 (rows player_i, one column per player_j), explicit pivot values."""
    return long.groupBy("split", "player_i").pivot("player_j", list(names)).agg(F.first("win_rate"))


# ---------------------------------------------------------------- D11 / E5
def baseline_join(rewards: DataFrame, baseline: str, models: Sequence[str] | None = None) -> DataFrame:
    """Each model's reward next to the baseline model's reward in the same
    (split, attribute, prompt_id, completion_idx) cell (inner-join semantics).

    Plan: instead of joining the table with its own baseline slice (a two-sided
    sort-merge join once the baseline is too big to broadcast), the baseline
    value is attached with a window over the cell: one exchange on the cell
    key, then a row-local filter. A cell holds one row per model, so a window
    partition is bounded by the model list.
    """
    w = Window.partitionBy(*CELL)
    x = rewards.withColumn("base_reward", F.max(F.when(F.col("model") == baseline, F.col("reward"))).over(w))
    keep = (F.col("model") != baseline) & F.col("base_reward").isNotNull()
    if models is not None:
        keep = keep & F.col("model").isin(list(models))
    return x.filter(keep).select("model", *CELL, "reward", "base_reward")


def winrate_vs_baseline(rewards: DataFrame, baseline: str, models: Sequence[str] | None = None,
                        roles: Sequence[tuple[int, str]] = ((0, "leader"), (1, "follower")),
                        splits=("train", "validation")) -> DataFrame:
    """E5: share of (attribute, prompt) cells where the model's completion ``idx``
    is at least the baseline's completion ``idx`` (ties win), per split.

    Output one row per model with columns ``{role}_{split}`` and, as an
    extra, ``{role}_{split}_tie_rate`` (share of exact ties, which count as wins).
    """
    j = baseline_join(rewards.filter(F.col("completion_idx").isin([r[0] for r in roles])), baseline, models)
    tie = ~F.isnan("reward") & ~F.isnan("base_reward") & (F.col("reward") == F.col("base_reward"))
    aggs = []
    for c, role in roles:
        for s_ in splits:
            hit = (F.col("completion_idx") == c) & (F.col("split") == s_)
            n = F.count(F.when(hit, F.lit(1)))
            aggs.append(_ratio(F.sum(F.when(hit, _i(ieee_ge("reward", "base_reward")))), n).alias(f"{role}_{s_}"))
            aggs.append(_ratio(F.sum(F.when(hit, _i(tie))), n).alias(f"{role}_{s_}_tie_rate"))
    return j.groupBy("model").agg(*aggs)


# ---------------------------------------------------------------- F1 / E6 / E7
def running_best(rewards: DataFrame, out: str = "best_so_far") -> DataFrame:
    """cumulative max over completion index per (model, split, attribute, prompt).

    NaN propagates (Spark orders NaN above every number, like torch.cummax).
    """
    w = (Window.partitionBy("model", "split", "attribute", "prompt_id").orderBy("completion_idx")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rewards.withColumn(out, F.max("reward").over(w))


def _completions(max_n: int, hit=None, name: str = "") -> list[Column]:
    """Reward and presence of each of the first ``max_n`` completions (of the rows that ``hit``)."""
    out = []
    for c in range(max_n):
        here = F.col("completion_idx") == c if hit is None else hit & (F.col("completion_idx") == c)
        out += [F.max(F.when(here, F.col("reward"))).alias(f"_v{name}_{c}"), F.count(F.when(here, 1)).alias(f"_c{name}_{c}")]
    return out


def _best(n: int, name: str = "") -> Column:
    """The best of the first n completions; NaN propagates (it orders above every number)."""
    vals = [F.col(f"_v{name}_{c}") for c in range(n)]
    return vals[0] if n == 1 else F.greatest(*vals)


def best_of_n_curve(rewards: DataFrame, max_n: int) -> DataFrame:
    """Mean over prompts of the best reward among the first N completions
    (N = 1..max_n; a prompt counts for N when it has an N-th completion).

    Plan: ONE keyed partial aggregation per cell into its first max_n
    completions (conditional max, folded map-side), the best of each N
    row-local, then the means. No window and no row is multiplied before the
    first shuffle.
    """
    cell = rewards.groupBy("model", "split", "attribute", "prompt_id").agg(*_completions(max_n))
    rows = [F.when(F.col(f"_c_{n - 1}") > 0, F.struct(F.lit(n).alias("n"), _best(n).alias("best"))) for n in range(1, max_n + 1)]
    return (cell.select("model", "split", "attribute", F.inline(F.array_compact(F.array(*rows))))
            .groupBy("model", "split", "attribute", "n").agg(F.avg("best").alias("mean_best")))


def best_of_n_winrate(rewards: DataFrame, baseline: str, models: Sequence[str], max_n: int) -> DataFrame:
    """Per (split, model, attribute, N) share of prompts where the model's
    best-of-N is at least the baseline's best-of-N; attribute 'Average' pools
    all attributes (grouping sets, one pass).

    Plan: as E6, ONE keyed partial aggregation per (split, attribute, prompt)
    holds every listed model's and the baseline's completions side by side (no
    join, no window); the wins of each N are row-local, then counted per model.
    """
    allm = [baseline, *[m for m in models if m != baseline]]
    aggs = [c for k, m in enumerate(allm) for c in _completions(max_n, F.col("model") == m, str(k))]
    cell = rewards.filter(F.col("model").isin(allm)).groupBy("split", "attribute", "prompt_id").agg(*aggs)
    has = lambda k, n: F.col(f"_c{k}_{n - 1}") > 0
    rows = [F.when(has(0, n) & has(k, n), F.struct(F.lit(n).alias("n"), F.lit(m).alias("model"), _i(ieee_ge(_best(n, str(k)), _best(n, "0"))).alias("win")))
            for n in range(1, max_n + 1) for k, m in enumerate(allm) if k > 0]
    j = cell.select("split", "attribute", F.inline(F.array_compact(F.array(*rows))))
    g = j.groupingSets([["split", "model", "n", "attribute"], ["split", "model", "n"]],
                       "split", "model", "n", "attribute").agg(
        F.sum("win").alias("wins"), F.count(F.lit(1)).alias("cnt"), F.grouping("attribute").alias("_g"))
    return g.select("split", "model",
                    F.when(F.col("_g") == 1, F.lit("Average")).otherwise(F.col("attribute")).alias("attribute"),
                    F.col("n").cast("int").alias("n"), _ratio(F.col("wins"), F.col("cnt")).alias("winrate"))


# ---------------------------------------------------------------- E9 / A8
def correction_matrix(corr: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per (leader, follower): mean over (attribute, prompt) of
    1[r(completion 1) >= r(completion 0)] over the cells that have both
    completions; a (leader, follower) without such a cell is NaN.

    Output: one row per follower, one column per leader (explicit list).
    """
    cell = corr.groupBy("leader", "follower", "attribute", "prompt_id").agg(
        F.max(F.when(F.col("completion_idx") == 0, F.col("reward"))).alias("r0"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("reward"))).alias("r1"))
    rate = cell.groupBy("leader", "follower").agg(
        _ratio(F.sum(_i(ieee_ge("r1", "r0"))), F.count(F.when(F.col("r0").isNotNull() & F.col("r1").isNotNull(), 1))).alias("winrate"))
    aggs = [F.coalesce(F.max(F.when(F.col("leader") == m, F.col("winrate"))), nan()).alias(m) for m in models]
    wide = rate.groupBy("follower").agg(*aggs)
    # every configured follower gets a row, even without any finished cell
    spark = corr.sparkSession
    rows = spark.createDataFrame([(m,) for m in models], "follower string")
    return rows.join(wide, "follower", "left").select(
        "follower", *[F.coalesce(F.col(m), nan()).alias(m) for m in models])


def pending_work(done: DataFrame, leaders: Sequence[str], followers: Sequence[str]) -> DataFrame:
    """The leader x follower cells of the configured grid that have no output yet.

    The grid is the product of two explicit parameter lists (size proven by
    the parameters); the done-manifest comes from the data; left anti join.
    """
    spark = done.sparkSession
    grid = spark.createDataFrame([(ld, fl) for ld in leaders for fl in followers], "leader string, follower string")
    present = done.select("leader", "follower").distinct()
    return grid.join(present, ["leader", "follower"], "left_anti")


# ---------------------------------------------------------------- D9 / D10 / D12
def align_prompts(tables: dict[str, DataFrame]) -> DataFrame:
    """Which (split, prompt_id) keys are missing from which model's table.

    The key columns of all tables are unioned with a table tag and reduced by
    ONE aggregation (a presence flag per table, partial aggregation map-side)
    instead of a chain of full outer joins. An empty result means aligned.
    """
    names = list(tables)
    u = None
    for n in names:
        k = tables[n].select("split", "prompt_id", F.lit(n).alias("_t"))
        u = k if u is None else u.unionByName(k)
    g = u.groupBy("split", "prompt_id").agg(
        *[F.max(F.when(F.col("_t") == n, F.lit(1))).alias(f"_in{i}") for i, n in enumerate(names)])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_in{i}").isNull(), F.lit(n)) for i, n in enumerate(names)]))
    return g.select("split", "prompt_id", missing.alias("missing_in")).filter(F.size("missing_in") > 0)


def stack_players(rewards: DataFrame, models: Sequence[str], per_model: int = 5) -> DataFrame:
    """First ``per_model`` completions of each model on one player axis:
    player = model position * per_model + completion_idx."""
    pos = F.lit(None).cast("int")
    for k, m in enumerate(models):
        pos = F.when(F.col("model") == m, F.lit(k)).otherwise(pos)
    return (rewards.filter(F.col("completion_idx") < per_model)
            .withColumn("_m", pos).filter(F.col("_m").isNotNull())
            .select("split", "attribute", "prompt_id",
                    (F.col("_m") * per_model + F.col("completion_idx")).cast("int").alias("player"), "reward"))


def model_pair_join(rewards: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every unordered model pair (i < j in the given order) on the same cell.

    No self-join: one keyed aggregation puts the M model rewards of a cell in
    one row, then a fixed literal list of the M(M-1)/2 pairs is exploded. The
    output per cell is bounded by the model list, never by the data, and
    duplicate rows of a hot cell are folded map-side.
    """
    x = rewards.filter(F.col("model").isin(list(models)))
    cell = x.groupBy(*CELL).agg(*[F.max(F.when(F.col("model") == m, F.col("reward"))).alias(f"_r{k}")
                                  for k, m in enumerate(models)])
    pairs = []
    for i in range(len(models)):
        for j in range(i + 1, len(models)):
            ra, rb = F.col(f"_r{i}"), F.col(f"_r{j}")
            pairs.append(F.when(ra.isNotNull() & rb.isNotNull(), F.struct(
                F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"),
                ra.alias("reward_a"), rb.alias("reward_b"), ieee_ge(ra, rb).alias("a_ge_b"))))
    return cell.select(*CELL, F.inline(F.array_compact(F.array(*pairs))))


# ---------------------------------------------------------------- E10
def instruction_accuracy(results: DataFrame) -> DataFrame:
    """Per completion index, prompt accuracy (all instructions of the
    prompt followed) and instruction accuracy, strict and loose."""
    per_prompt = results.groupBy("completion_idx", "prompt_id").agg(
        F.bool_and("followed_strict").alias("ps"), F.bool_and("followed_loose").alias("pl"),
        F.sum(_i(F.col("followed_strict"))).alias("is_"), F.sum(_i(F.col("followed_loose"))).alias("il"),
        F.count(F.lit(1)).alias("n"))
    return per_prompt.groupBy("completion_idx").agg(
        _ratio(F.sum(_i(F.col("ps"))), F.count(F.lit(1))).alias("prompt_strict"),
        _ratio(F.sum(_i(F.col("pl"))), F.count(F.lit(1))).alias("prompt_loose"),
        _ratio(F.sum("is_"), F.sum("n")).alias("instruction_strict"),
        _ratio(F.sum("il"), F.sum("n")).alias("instruction_loose"))

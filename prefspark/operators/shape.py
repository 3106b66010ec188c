"""Reshaping between prompts, completions, pairs and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten_completions(gen: DataFrame, comps: str = "comps", outer: bool = False) -> DataFrame:
    """One row per completion (prompt_id, prompt, completion_idx, completion)."""
    ex = F.posexplode_outer(comps) if outer else F.posexplode(comps)
    return gen.select("prompt_id", "prompt", ex.alias("completion_idx", "c")).select(
        "prompt_id", "prompt", "completion_idx", F.col("c.text").alias("completion"))


def unflatten_rewards(long: DataFrame, value: str = "reward", keys=("prompt_id",), most: int | None = None) -> DataFrame:
    """Long rewards -> per prompt the list of rewards in completion order
    (keyed regroup, ragged N allowed).

    A prompt's list is one row of the output, so its length is the caller's
    number of completions; ``most`` makes a larger completion_idx an error,
    row by row before any list is built.
    """
    if most is not None:
        long = long.withColumn("completion_idx", F.when(F.col("completion_idx") >= most, F.raise_error(
            F.lit(f"completion_idx beyond {most}"))).otherwise(F.col("completion_idx")).cast("int"))
    g = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_completions"),
        F.array_sort(F.collect_list(F.struct("completion_idx", F.col(value).alias("v")))).alias("_l"))
    return g.select(*keys, "n_completions",
                    F.transform("_l", lambda x: x["v"]).alias(value + "s"))


def group_return_sequences(flat: DataFrame, k: int, order: str = "seq_idx", value: str = "text", whole_only: bool = True) -> DataFrame:
    """A flat list of generations (k per prompt, consecutive) -> list of k
    per prompt; with k == 1 the values stay flat. A group without exactly k
    sequences is an error, unless ``whole_only`` is false: then it gives those it has."""
    if k <= 1:
        return flat.select((F.col(order)).alias("prompt_idx"), F.col(value).alias("completions"))
    g = flat.groupBy(F.floor(F.col(order) / k).alias("prompt_idx")).agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    values = F.transform("_l", lambda x: x[value])
    if whole_only:
        values = F.when(F.col("_n") == k, values).otherwise(F.raise_error(F.concat(
            F.lit(f"a prompt without {k} sequences: "), F.coalesce(F.col("prompt_idx").cast("string"), F.lit("null")))))
    return g.select("prompt_idx", values.alias("completions"))


def repeat_rows(df: DataFrame, k: int, out: str = "repeat_idx") -> DataFrame:
    """Every row k times (explode of a k-element sequence; k is a parameter)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def last_wins_dedup(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key -> value mapping where later rows overwrite earlier ones
    (``max_by`` per key: a partial aggregate, no sort of a hot key)."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def follower_reference_sequence(leader: DataFrame, follower: DataFrame, with_leader_context: bool = False
                                ) -> DataFrame:
    """The sequence the follower's KL is computed on: the leader's prompt
    tokens ++ the follower's completion tokens (or the follower's own sequence).

    Inputs (pair_id, ids array<int>, ctx int); equi-join on pair_id.
    """
    lf = leader.select("pair_id", F.col("ids").alias("l_ids"), F.col("ctx").alias("l_ctx"))
    ff = follower.select("pair_id", F.col("ids").alias("f_ids"), F.col("ctx").alias("f_ctx"))
    j = lf.join(ff, "pair_id", "inner")
    f_comp = F.slice("f_ids", F.col("f_ctx") + 1, F.greatest(F.size("f_ids") - F.col("f_ctx"), F.lit(0)))
    seq = F.col("f_ids") if with_leader_context else F.concat(F.slice("l_ids", F.lit(1), F.col("l_ctx")), f_comp)
    ctx = F.col("f_ctx") if with_leader_context else F.col("l_ctx")
    return j.select("pair_id", seq.alias("ids"), ctx.alias("ctx"))


def head_n(df: DataFrame, n: int, order: str, by: str = "split") -> DataFrame:
    """First min(n, size) rows of every split in ``order``.

    ``row_number`` within each split; Spark plans this as a per-partition
    top-k (WindowGroupLimit) before the shuffle, so only n rows per split and
    partition move.
    """
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def export_eval_rows(gen: DataFrame, generator: str, dataset: str = "prefspark", datasplit: str = "eval",
                     comps: str = "comps") -> DataFrame:
    """A5: one record per completion: instruction, output, generator
    ``{generator}_completion_{i}``, constant dataset/datasplit; other columns kept."""
    keep = [c for c in gen.columns if c not in (comps, "prompt")]
    x = gen.select(*keep, F.col("prompt").alias("instruction"), F.posexplode(comps).alias("completion_idx", "c"))
    return x.select(*keep, "instruction", F.col("c.text").alias("output"),
                    F.concat(F.lit(generator + "_completion_"), F.col("completion_idx").cast("string"))
                    .alias("generator"), F.lit(dataset).alias("dataset"), F.lit(datasplit).alias("datasplit"),
                    "completion_idx")


def write_eval_json(rows: DataFrame, path: str) -> None:
    """A5 sink: JSON lines, one folder per completion index."""
    rows.write.mode("overwrite").partitionBy("completion_idx").json(path)


def select_rename(df: DataFrame, rename: dict[str, str] | None = None, keep: list[str] | None = None,
                  drop: list[str] | None = None) -> DataFrame:
    """Keep / rename / drop columns in one projection (pruned at the scan)."""
    rename = rename or {}
    cols = keep if keep is not None else [c for c in df.columns if c not in (drop or [])]
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in cols])

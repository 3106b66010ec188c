"""Judging: multi-attribute votes, the pairwise A/B judge's probability,
position de-biasing and the reward-attribute schedule (H1-H5, G11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.core import ATTRIBUTES, coin, hash_bigint, ieee_ge

# The judge's answer tokens for response 0 and response 1.
JUDGE_TOKENS = ("A", "B")
PROB_EPS = 1.0e-6


def attribute_votes(scores: DataFrame, keys: Sequence[str], penalty: float | None = None) -> DataFrame:
    """Per (pair, attribute): 1 when completion 0 scores >= completion 1 after
    the missing-EOS penalty (G11: score - c * [no EOS]); NaN loses."""
    s = F.col("score")
    if penalty is not None:
        s = s - F.lit(float(penalty)) * (~F.col("has_eos")).cast("double")
    x = scores.withColumn("_s", s)
    g = x.groupBy(*keys, "attribute").agg(
        F.max(F.when(F.col("completion_idx") == 0, F.col("_s"))).alias("s0"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("_s"))).alias("s1"))
    return g.filter(F.col("s0").isNotNull() & F.col("s1").isNotNull()).withColumn(
        "vote", ieee_ge("s0", "s1").cast("int"))


def multi_attribute_vote(scores: DataFrame, keys: Sequence[str], penalty: float | None = None,
                         attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """H1: preference probability = mean over ``attributes`` of the votes (as in
    :func:`attribute_votes`; an attribute without both scores doesn't vote).

    One aggregation per pair holds both scores of every attribute: one shuffle."""
    s = F.col("score")
    if penalty is not None:
        s = s - F.lit(float(penalty)) * (~F.col("has_eos")).cast("double")
    side = lambda a, c: F.max(F.when((F.col("attribute") == a) & (F.col("completion_idx") == c), s))
    g = scores.groupBy(*keys).agg(*[side(a, c).alias(f"_s{c}_{i}") for i, a in enumerate(attributes) for c in (0, 1)])
    votes = [F.when(F.col(f"_s0_{i}").isNotNull() & F.col(f"_s1_{i}").isNotNull(), ieee_ge(f"_s0_{i}", f"_s1_{i}").cast("int")) for i in range(len(attributes))]
    cast = F.array_compact(F.array(*votes))
    total = F.aggregate(cast, F.lit(0), lambda n, v: n + v)
    return (g.select(*keys, cast.alias("_cast"), total.alias("_wins")).where(F.size("_cast") > 0)
            .select(*keys, (F.col("_wins") / F.size("_cast")).alias("p"), F.size("_cast").cast("long").alias("n_attributes")))


def sampled_attribute_vote(scores: DataFrame, keys: Sequence[str], seed: int,
                           attributes: Sequence[str] = ATTRIBUTES, penalty: float | None = None) -> DataFrame:
    """H2: one seeded attribute per pair decides (md5(seed|pair) mod A)."""
    v = attribute_votes(scores, keys, penalty)
    pick = F.element_at(F.array(*[F.lit(a) for a in attributes]),
                        (hash_bigint(F.lit(str(seed)), *[F.col(k) for k in keys]) % len(attributes) + 1).cast("int"))
    return v.filter(F.col("attribute") == pick).select(*keys, "attribute", "vote")


def judge_probability(logprobs: DataFrame, temperature: float = 1.0, key: str = "pair_id") -> DataFrame:
    """H4: p(response 0) from the judge's top-token log-probs:
    exp(lp/T) for the tokens A and B (a missing token counts 0), p = A / (A + B + 1e-6);
    a failed call gives 0.5 (so both tokens missing gives 0.0, not 0.5)."""
    t = F.lit(float(temperature))
    g = logprobs.groupBy(key).agg(
        F.max(F.when(F.col("token") == JUDGE_TOKENS[0], F.col("logprob"))).alias("lp_a"),
        F.max(F.when(F.col("token") == JUDGE_TOKENS[1], F.col("logprob"))).alias("lp_b"),
        F.max(F.col("call_failed").cast("int")).alias("_failed"))
    pa = F.coalesce(F.exp(F.col("lp_a") / t), F.lit(0.0))
    pb = F.coalesce(F.exp(F.col("lp_b") / t), F.lit(0.0))
    p = F.when(F.col("_failed") == 1, F.lit(0.5)).otherwise(pa / (pa + pb + F.lit(PROB_EPS)))
    return g.select(key, p.alias("p"),
                    (F.col("lp_a").isNull() & F.col("lp_b").isNull() & (F.col("_failed") == 0)).alias("both_missing"),
                    (F.col("_failed") == 1).alias("call_failed"))


def position_flip(df: DataFrame, seed: int, key: str = "pair_id") -> DataFrame:
    """H3 (before judging): seeded flip per pair; the judged order is reversed when set."""
    return df.withColumn("flip", coin(seed, F.col(key)) == 1)


def position_unflip(df: DataFrame, p: str = "p") -> DataFrame:
    """H3 (after judging): p(original response 0) = 1 - p when the pair was flipped."""
    return df.withColumn(p, F.when(F.col("flip"), F.lit(1.0) - F.col(p)).otherwise(F.col(p)))


def attribute_schedule(rewards: DataFrame, step: str, mode: str, seed: int = 42, fixed: str | None = None,
                       attributes: Sequence[str] = ATTRIBUTES, keys: Sequence[str] = ()) -> DataFrame:
    """H5: which reward attribute scores a batch: ``fixed`` (one attribute),
    ``random`` (md5(seed|step) mod A), ``round_robin`` (step mod A, one advance
    per step) or ``average`` (mean over all attributes).

    Input long rewards with ``attribute`` and ``reward``; output per
    (step, keys) the scheduled reward."""
    group = [step, *keys]
    if mode == "average":
        return rewards.groupBy(*group).agg(F.avg("reward").alias("scheduled_reward"))
    arr = F.array(*[F.lit(a) for a in attributes])
    if mode == "fixed":
        if fixed not in attributes:
            raise ValueError(f"unknown fixed attribute {fixed!r}")
        pick = F.lit(fixed)
    elif mode == "random":
        pick = F.element_at(arr, (hash_bigint(F.lit(str(seed)), F.col(step)) % len(attributes) + 1).cast("int"))
    elif mode == "round_robin":
        pick = F.element_at(arr, (F.pmod(F.col(step), F.lit(len(attributes))) + 1).cast("int"))
    else:
        raise ValueError(f"unknown schedule {mode!r}; known: fixed, random, round_robin, average")
    return rewards.filter(F.col("attribute") == pick).select(*group, F.col("reward").alias("scheduled_reward"))

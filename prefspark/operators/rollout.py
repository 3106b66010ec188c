"""Per-sequence training statistics from rollout tables.

Input rows are sequences: ``(step, prompt_id, sample_idx, model_logps,
ref_logps, gen_logps, score, prob, has_eos)``. Token work is row-local array
arithmetic. Batch statistics (per ``step``) and prompt statistics (per
(step, prompt_id)) are keyed aggregations joined back to the rows: the
statistics table is small enough for AQE to broadcast, and a hot step or
prompt is split by AQE's skew join rather than sorted in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import seq as sq
from prefspark.functions.core import clamp, hash_bigint, ieee_gt, log_sigmoid, nan, sigmoid


def missing_eos_penalty(score, has_eos, penalty: float) -> Column:
    """Score - c * [no EOS]."""
    return F.col(score) - F.lit(float(penalty)) * (~F.col(has_eos)).cast("double")


def eos_probability_penalty(prob, has_eos, penalty: float, follower: bool = False) -> Column:
    """Leader p - c*[no EOS]; follower (1 - p) - c*[no EOS]."""
    p = (F.lit(1.0) - F.col(prob)) if follower else F.col(prob)
    return p - F.lit(float(penalty)) * (~F.col(has_eos)).cast("double")


# ---------------------------------------------------------------- group statistics
# Batch (step) and prompt statistics are computed with a keyed aggregation
# (partial aggregation map-side) and joined back, not with a window: a window
# partition cannot be split, while the join lets AQE broadcast the small
# statistics table or split a hot key on the big side.
def _group_stats(df: DataFrame, keys, *aggs) -> DataFrame:
    """Rows with their group's statistics; a null key is a group of its own. The
    statistics read only the keys and the aggregated columns."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    stats = stats.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(stats, on, "inner").drop(*[f"_key{i}" for i in range(len(keys))])


def rloo_advantage(df: DataFrame, value: str, out: str = "advantage", group=("step", "prompt_id")) -> DataFrame:
    """v - (sum_group v - v) / (k - 1) among the k samples of one prompt
    (k = 1 gives NaN)."""
    x = _group_stats(df, group, F.sum(value).alias("_gs"), F.count(F.lit(1)).alias("_gk"))
    base = F.when(F.col("_gk") > 1, (F.col("_gs") - F.col(value)) / (F.col("_gk") - 1)).otherwise(F.lit(float("nan")))
    return x.withColumn(out, F.col(value) - base).drop("_gs", "_gk")


def batch_rloo_baseline(df: DataFrame, value: str, baseline: float | None = 0.5, out: str = "p_adj") -> DataFrame:
    """subtract the constant baseline, then the leave-one-out mean of the batch (step)."""
    v = F.col(value) - F.lit(float(baseline)) if baseline is not None else F.col(value)
    x = _group_stats(df.withColumn("_v", v), ["step"], F.sum("_v").alias("_bs"), F.count(F.lit(1)).alias("_bn"))
    return x.withColumn(out, F.col("_v") - F.when(F.col("_bn") > 1, (F.col("_bs") - F.col("_v")) / (F.col("_bn") - 1))
                        .otherwise(F.lit(float("nan")))).drop("_v", "_bs", "_bn")


def normalize(df: DataFrame, value: str, out: str, clip: float | None = None, by: str = "step") -> DataFrame:
    """F4 (with ``clip``) / F5: (x - mean) / (sample std + 1e-8) per batch.

    A batch of one has no sample deviation and one NaN makes the batch's mean
    NaN: both give NaN, clipped or not."""
    sd = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(nan())
    x = _group_stats(df, [by], F.avg(value).alias("_m"), sd.alias("_sd"))
    z = (F.col(value) - F.col("_m")) / (F.col("_sd") + F.lit(1e-8))
    if clip is not None:
        z = clamp(z, -clip, clip)
    return x.withColumn(out, z).drop("_m", "_sd")


def normalized_rloo_advantage(df: DataFrame, value: str, out: str = "adv_norm", group=("step", "prompt_id"), by: str = "step") -> DataFrame:
    """F2 then F5: the leave-one-out advantage, normalised over its batch.

    An advantage is a linear function of its value, a v - b with a = k/(k-1) and b = sum/(k-1)
    of the prompt's k samples, so the batch's mean and deviation follow from the prompts'
    centred moments (count, mean, squares) by the two-level formula: squares within
    a prompt are a^2 times its own, squares between prompts come from their means. One
    aggregation of the input, folded once more to steps, and one join back."""
    group = list(group)
    stats = df.groupBy(*group).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_k"), F.count(value).alias("_c"),
                                   (F.var_pop(value) * F.count(value)).alias("_m2"))
    more = F.when(F.col("_k") > 1, F.col("_k") - 1).otherwise(nan())      # a single sample has no advantage
    stats = stats.withColumn("_a", F.col("_k") / more).withColumn("_b", F.col("_s") / more)
    stats = stats.withColumn("_mu", F.when(F.col("_c") > 0, F.col("_a") * F.col("_s") / F.col("_c") - F.col("_b")))
    steps = stats.groupBy(by).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_mu")).alias("_sum"), F.sum(F.col("_c") * F.col("_mu") * F.col("_mu")).alias("_sq"),
                                  F.sum(F.col("_a") * F.col("_a") * F.col("_m2")).alias("_in"))
    mean = F.col("_sum") / F.col("_n")
    sd = F.when(F.col("_n") > 1, F.sqrt((F.col("_in") + F.col("_sq") - F.col("_sum") * mean) / (F.col("_n") - 1))).otherwise(nan())
    steps = steps.where("_n > 0").select(F.col(by).alias("_step"), mean.alias("_mean"), sd.alias("_sd"))
    both = stats.join(steps, F.col(by).eqNullSafe(F.col("_step")), "left").select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(group)], "_a", "_b", "_mean", "_sd")
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(group)]
    z = (F.col("_a") * F.col(value) - F.col("_b") - F.col("_mean")) / (F.col("_sd") + F.lit(1e-8))
    return df.join(both, on, "inner").withColumn(out, z).drop(*[f"_key{i}" for i in range(len(group))], "_a", "_b", "_mean", "_sd")


def alternating_update(step_losses: DataFrame, frequency: int, follower_weight: float,
                       separate_models: bool = False) -> DataFrame:
    """which loss counts at a step: L + w*F when frequency is 1; L alone when
    (step + 1) % frequency == 0; else w*F. With ``separate_models`` both are
    updated at every step and the total is (L + F) / 2. Input (step, loss_leader, loss_follower)."""
    if frequency < 1:
        raise ValueError("leader_update_frequency must be >= 1")
    L, Fo = F.col("loss_leader"), F.col("loss_follower")
    w = F.lit(float(follower_weight))
    if separate_models:
        total = (L + Fo) / 2
    elif frequency == 1:
        total = L + w * Fo
    else:
        total = F.when(F.pmod(F.col("step") + 1, F.lit(frequency)) == 0, L).otherwise(w * Fo)
    return step_losses.withColumn("total_loss", total)


# ---------------------------------------------------------------- sequence stats
def logprob_stats(df: DataFrame, logps: str = "model_logps") -> DataFrame:
    """Sum of real-token log-probs per sequence; entropy estimate = -sum."""
    s = sq.asum(F.col(logps))
    return df.withColumn("logp_sum", s).withColumn("entropy", -s)


def policy_loss(df: DataFrame, beta: float, kind: str = "k3", baseline: float | None = 0.5,
                rloo_baseline: bool = True, tis_threshold: float | None = None) -> DataFrame:
    """Per sequence loss = sum_t (beta * kl_t - p') * logp_t [* min(exp(logp_t - gen_t), tau)],
    score = p' * sum_t logp_t and kl = sum_t kl_t, where p' is the probability
    after the constant baseline and (optionally) the batch leave-one-out mean
    (F3). The batch loss is the mean over the step."""
    if rloo_baseline:
        x = batch_rloo_baseline(df, "prob", baseline, "p_adj")
    else:
        x = df.withColumn("p_adj", F.col("prob") - F.lit(float(baseline or 0.0)))
    kl = sq.kl_tokens("model_logps", "ref_logps", kind)
    p = F.col("p_adj")
    per_tok = F.zip_with(kl, F.col("model_logps"), lambda k, lp: (F.lit(float(beta)) * k - p) * lp)
    if tis_threshold is not None:
        tis = F.zip_with(F.col("model_logps"), F.col("gen_logps"),
                         lambda lp, g: clamp(F.exp(lp - g), high=tis_threshold))
        per_tok = F.zip_with(per_tok, tis, lambda a, b: a * b)
    return (x.withColumn("seq_loss", sq.asum(per_tok))
             .withColumn("score", p * sq.asum(F.col("model_logps")))
             .withColumn("kl", sq.asum(kl)))


def kl_penalized_reward(df: DataFrame, kl_coef: float, score: str = "score") -> DataFrame:
    """non_score_reward = -c * sum_t (logp_t - ref_t); rlhf_reward = that + score.
    (The token-level mode sums to the same value.)"""
    kl = sq.asum(F.zip_with(F.col("model_logps"), F.col("ref_logps"), lambda a, b: a - b))
    return (df.withColumn("seq_kl", kl)
              .withColumn("non_score_reward", F.lit(-float(kl_coef)) * F.col("seq_kl"))
              .withColumn("rlhf_reward", F.col("non_score_reward") + F.col(score)))


def clipped_policy_loss(df: DataFrame, advantage: str, clip: float,
                        new: str = "model_logps", old: str = "gen_logps") -> DataFrame:
    """ratio = exp(sum new - sum old); loss = max(-A*ratio, -A*clamp(ratio, 1-e, 1+e));
    clipped = second term larger; approx KL = (sum new - sum old)^2 / 2."""
    diff = sq.asum(F.col(new)) - sq.asum(F.col(old))
    x = df.withColumn("logprobs_diff", diff).withColumn("ratio", F.exp("logprobs_diff"))
    A = F.col(advantage)
    pg1 = -A * F.col("ratio")
    pg2 = -A * clamp("ratio", 1.0 - clip, 1.0 + clip)
    return (x.withColumn("pg_loss", F.greatest(pg1, pg2)).withColumn("clipped", pg2 > pg1)
             .withColumn("approxkl", F.lit(0.5) * F.col("logprobs_diff") * F.col("logprobs_diff")))


# ---------------------------------------------------------------- pair losses
def bradley_terry_loss(pairs: DataFrame, center_coef: float | None = None, by=("model", "attribute"),
                       use_margin: bool = True, use_weight: bool = True) -> DataFrame:
    """-log sigmoid(chosen - rejected - margin), weighted mean
    sum(w*l)/sum(w) (plain mean without weights), + c * mean((chosen + rejected)^2)."""
    d = F.col("chosen") - F.col("rejected") - (F.col("margin") if use_margin else F.lit(0.0))
    l = -log_sigmoid(d)
    loss = (F.sum(F.col("loss_weight") * l) / F.sum("loss_weight")) if use_weight else F.avg(l)
    if center_coef is not None:
        s = F.col("chosen") + F.col("rejected")
        loss = loss + F.lit(float(center_coef)) * F.avg(s * s)
    return pairs.groupBy(*by).agg(loss.alias("bt_loss"), F.count(F.lit(1)).alias("n_pairs"))


def weighted_bce_loss(rows: DataFrame, logit: str = "chosen", by=("model", "attribute"),
                      compat: bool = False) -> DataFrame:
    """BCE-with-logits of (logit - margin) against ``label``, weighted
    mean per group; ``compat=True`` is the reference's literal plain mean
    (its weights cancel because the BCE is already mean-reduced)."""
    x = F.col(logit) - F.col("margin")
    y = F.col("label").cast("double")
    l = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    loss = F.avg(l) if compat else F.sum(F.col("loss_weight") * l) / F.sum("loss_weight")
    return rows.groupBy(*by).agg(loss.alias("bce_loss"))


def preference_accuracy(pairs: DataFrame, by=("model", "attribute")) -> DataFrame:
    """Softmax over (chosen, rejected) rewards; accuracy = share of pairs
    where chosen beats rejected, and the mean preference probability."""
    return pairs.groupBy(*by).agg(
        (F.sum(ieee_gt("chosen", "rejected").cast("long")) / F.count(F.lit(1))).alias("accuracy"),
        F.avg(sigmoid(F.col("chosen") - F.col("rejected"))).alias("mean_p_chosen"))


# ---------------------------------------------------------------- per-step metrics
def rollout_metrics(rows: DataFrame, follower: Column, beta: float, penalty: float, kind: str = "k3",
                    pair_keys=("step", "prompt_id", "pair"), baseline: float = 0.5) -> DataFrame:
    """Per step means of score, KL, loss, log-prob sums, entropies, margin,
    probability, EOS rate and completion length for leader and follower sequences of
    one table, told apart by ``follower``; the follower optimises 1 - p (G8).

    The means are over pairs (leader and follower rows of equal ``pair_keys``), the
    batch baseline over all of a side's rows of a step, as if both sides were joined
    after :func:`policy_loss`. Nothing is joined, though: the leave-one-out baseline is linear,
    p' = n/(n-1) v - S/(n-1) with v the penalised probability less 0.5, S its sum and n
    the number of rows, so loss and score are too, and their means follow from sums of products.
    One scan, one shuffle by pair; steps are folded from the pairs' sums. A side
    that occurs several times in a pair counts once for each partner."""
    step = pair_keys[0]
    kl = sq.kl_tokens("model_logps", "ref_logps", kind)
    x = rows.select(*pair_keys, follower.alias("_f"), F.col("prob").alias("_p"), sq.asum(F.col("model_logps")).alias("_b"), sq.asum(kl).alias("_kl"),
                    sq.asum(F.zip_with(kl, F.col("model_logps"), lambda k, lp: k * lp)).alias("_a"),
                    F.col("has_eos").cast("double").alias("_eos"), F.size("model_logps").cast("double").alias("_len"),
                    (~F.col("has_eos")).cast("double").alias("_no"))
    v = F.when(F.col("_f"), 1.0 - F.col("_p")).otherwise(F.col("_p")) - F.lit(float(penalty)) * F.col("_no") - F.lit(float(baseline))
    x = x.withColumn("_v", v)
    both = lambda c, *others: F.when(_known(*others), F.col(c) if isinstance(c, str) else c)
    terms = {"vb": F.col("_v") * F.col("_b"), "b_v": both("_b", "_v"), "a": both("_a", "_v"), "vb_a": both(F.col("_v") * F.col("_b"), "_a"),
             "b_va": both("_b", "_v", "_a"), "kl": F.col("_kl"), "b": F.col("_b"), "p": F.col("_p"), "eos": F.col("_eos"), "len": F.col("_len")}
    aggs = []
    for side, mine in (("l", ~F.col("_f")), ("f", F.col("_f"))):
        aggs += [F.count(F.when(mine, 1)).alias(f"{side}_n"), F.sum(F.when(mine, F.col("_v"))).alias(f"{side}_s")]
        for name, e in terms.items():
            aggs += [F.sum(F.when(mine, e)).alias(f"{side}_{name}"), F.count(F.when(mine, e)).alias(f"{side}_{name}_n")]
    pairs = x.groupBy(*pair_keys).agg(*aggs)
    folded = [F.sum(f"{side}_n").alias(f"{side}_n") for side in "lf"] + [F.sum(f"{side}_s").alias(f"{side}_s") for side in "lf"]
    for side, other in (("l", "f"), ("f", "l")):
        for name in terms:
            folded += [F.sum(F.col(f"{side}_{name}") * F.when(F.col(f"{other}_n") > 0, F.col(f"{other}_n"))).alias(f"{side}_{name}"),
                       F.sum(F.col(f"{side}_{name}_n") * F.col(f"{other}_n")).alias(f"{side}_{name}_n")]
    folded += [F.sum(F.when((F.col("l_b_n") > 0) & (F.col("f_b_n") > 0), F.col("l_b") * F.col("f_b_n") - F.col("f_b") * F.col("l_b_n"))).alias("margins"),
               F.sum(F.col("l_b_n") * F.col("f_b_n")).alias("margins_n"), F.sum(F.col("l_n") * F.col("f_n")).alias("pairs")]
    g = pairs.groupBy(step).agg(*folded).where("pairs > 0")
    mean = lambda total, n: F.when(F.col(n) > 0, total / F.col(n))
    out = {}
    for side, name in (("l", "leader"), ("f", "follower")):
        c = lambda t, side=side: F.col(f"{side}_{t}")
        # a batch of one has no leave-one-out mean
        shrink = F.when(c("n") > 1, c("n") / (c("n") - 1)).otherwise(nan())
        rest = F.when(c("n") > 1, c("s") / (c("n") - 1)).otherwise(nan())
        out |= {f"score_{name}": mean(shrink * c("vb") - rest * c("b_v"), f"{side}_vb_n"), f"kl_{name}": mean(c("kl"), f"{side}_kl_n"),
                f"loss_{name}": mean(F.lit(float(beta)) * c("a") - (shrink * c("vb_a") - rest * c("b_va")), f"{side}_a_n"),
                f"logps_{name}": mean(c("b"), f"{side}_b_n"), f"entropy_{name}": -mean(c("b"), f"{side}_b_n"),
                f"{name}_contain_eos": mean(c("eos"), f"{side}_eos_n"), f"{name}_completion_length": mean(c("len"), f"{side}_len_n")}
    out["probabilities"] = mean(F.col("l_p"), "l_p_n")
    out["margins"] = mean(F.col("margins"), "margins_n")
    return g.select(step, *[e.alias(n) for n, e in out.items()])


def _known(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def policy_metrics(df: DataFrame, kl_coef: float, penalty: float, clip: float) -> DataFrame:
    """Per step KL, entropy, non-score reward, RLHF reward, score, clip
    fraction, approximate KL, policy loss, token ratio mean / variance, EOS count.

    ``ratio`` / ``ratio_var`` are over tokens: exp(new_t - old_t), pooled over the step.
    Their moments are Spark's own mergeable ones (count, mean, centred squares), over
    the exploded ratios; the sequence's other figures count at its first token only,
    so rows, tokens and merges share one scan and one aggregation."""
    x = df.withColumn("score_pen", missing_eos_penalty("score", "has_eos", penalty))
    x = kl_penalized_reward(x, kl_coef, "score_pen")
    x = rloo_advantage(x, "rlhf_reward")
    x = clipped_policy_loss(x, "advantage", clip)
    tok = F.zip_with(F.col("model_logps"), F.col("gen_logps"), lambda a, b: F.exp(a - b))
    once = {"kl": F.col("seq_kl"), "entropy": -sq.asum(F.col("model_logps")), "non_score_reward": F.col("non_score_reward"),
            "rlhf_reward": F.col("rlhf_reward"), "scores": F.col("score_pen"), "clipfrac": F.col("clipped").cast("double"),
            "approxkl": F.col("approxkl"), "policy_loss": F.col("pg_loss")}
    t = x.select("step", F.col("has_eos").cast("long").alias("_eos"), *[e.alias(n) for n, e in once.items()], F.posexplode_outer(tok).alias("_at", "_ratio"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    return t.groupBy("step").agg(
        *[F.avg(F.when(first, F.col(n))).alias(n) for n in once], F.avg("_ratio").alias("ratio"),
        F.when(F.count("_ratio") > 1, F.var_samp("_ratio")).alias("ratio_var"), F.sum(F.when(first, F.col("_eos"))).alias("num_eos"))


# ---------------------------------------------------------------- permutations
ROUNDS = 6


def _permute_once(x: Column, a: Column, b: Column, seed: int, parts) -> Column:
    """One pass of alternating Feistel rounds over (x div b, x mod b) in [0, a) x [0, b): a bijection of 0..ab-1."""
    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        h = hash_bigint(F.lit(str(seed)), *parts, r, F.when(odd, s["l"]).otherwise(s["r"]))
        return F.struct(F.when(odd, s["l"]).otherwise((s["l"] + h) % a).alias("l"), F.when(odd, (s["r"] + h) % b).otherwise(s["r"]).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: s["l"] * b + s["r"])


def permuted_rank(position: Column, size: Column, seed: int, parts=()) -> Column:
    """A keyed permutation of 0..size-1 as a row-local formula: the rank of ``position`` (0 <= position < size).

    The position is a place in the smallest a by b square-like table with ab >= size and is moved by
    ``ROUNDS`` alternating Feistel rounds, whose additions are keyed by (seed, parts,
    round). That permutes 0..ab-1; a result beyond size - 1 goes through again
    (cycle walking) and returns after at most ab - size < a further passes, since no
    cycle has more members out of range. Fewer than one row in sqrt(size) walks."""
    size = size.cast("long")
    a = F.greatest(F.ceil(F.sqrt(size.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(F.ceil(size / a).cast("long"), F.lit(1).cast("long"))
    first = _permute_once(position.cast("long"), a, b, seed, parts)
    # bound once by a one-element array, or the optimizer would repeat the formula at each reference
    walked = F.transform(F.array(first), lambda x: F.when(x < size, x).otherwise(F.aggregate(
        F.sequence(F.lit(1).cast("long"), a * b - size), x, lambda s, _: F.when(s < size, s).otherwise(_permute_once(s, a, b, seed, parts)))))
    return F.get(walked, 0)


def permuted_batches(df: DataFrame, seed: int, epochs: int, mini_batch: int, micro_batch: int, position: str, by: str = "step") -> DataFrame:
    """A fresh seeded permutation of each batch per epoch, cut into mini and micro batches.

    ``position`` numbers a batch's rows from 0. The rank is :func:`permuted_rank`, so nothing is
    sorted; only the batches' sizes are counted, a row a batch, and joined. A
    position that is null or beyond its batch's size is an error."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_size"))
    x = df.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    p = F.col(position)
    inside = F.when((p >= 0) & (p < F.col("_size")), p).otherwise(F.raise_error(F.lit("positions of a batch must be 0, 1, ... without gaps")).cast("long"))
    x = x.withColumn("perm_rank", permuted_rank(inside, F.col("_size"), seed, [F.coalesce(F.col(by).cast("string"), F.lit("")), F.col("epoch")]).cast("int"))
    return (x.drop("_by", "_size").withColumn("mini_batch", F.floor(F.col("perm_rank") / mini_batch))
            .withColumn("micro_batch", F.floor((F.col("perm_rank") % mini_batch) / micro_batch)))


def random_permutation_batches(df: DataFrame, seed: int, epochs: int, mini_batch: int, micro_batch: int,
                               key: str = "sample_idx", by: str = "step") -> DataFrame:
    """A fresh seeded permutation of each batch per epoch, cut into mini
    and micro batches: rank by md5(seed|step|epoch|key) within (step, epoch)
    (bucketed hash rank: no window partition holds a whole batch)."""
    from prefspark.operators.ids import hash_rank
    x = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    x = hash_rank(x, key, seed, "perm_rank", by=[by, "epoch"],
                  hash_parts=[F.col(by), F.col("epoch"), F.col(key)])
    x = x.withColumn("perm_rank", F.col("perm_rank").cast("int"))
    return x.withColumn("mini_batch", F.floor(F.col("perm_rank") / mini_batch)) \
            .withColumn("micro_batch", F.floor((F.col("perm_rank") % mini_batch) / micro_batch))

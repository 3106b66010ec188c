"""Preference-set building: pair rated responses, label by annotator
disagreement, pick chosen/rejected.

Ratings are kept long (one row per annotator rating) and reduced with keyed
aggregations (count, mean, centred moments, partial aggregation map-side), so
a prompt with a huge number of ratings never becomes one big list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.core import ATTRIBUTES

# Attributes whose label is flipped (lower is better).
FLIPPED = ("verbosity", "complexity")
TIE_EPS = 1e-8
#: Annotation rows that a task folds by prompt at most, unless a single prompt has more.
ROWS_EACH = 1_500_000


def side_stats(ratings: DataFrame) -> DataFrame:
    """(prompt_id, completion_idx, attribute, n, mean, std) from long ratings;
    population std as in ``np.std``. The deviation is merged from centred moments,
    so equal ratings have a deviation of exactly 0."""
    return ratings.groupBy("prompt_id", "completion_idx", "attribute").agg(
        F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"))


def side_stats_from_arrays(rows: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Same statistics when each response row carries its rating lists
    (row-local array aggregation in two passes, no shuffle)."""
    out = []
    for a in attributes:
        arr = F.col(a)
        n = F.size(arr)
        mean = F.when(n > 0, F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / n)
        # equal ratings have no deviation, whatever the rounding of their mean
        centre = F.when(F.array_min(arr) == F.array_max(arr), F.array_min(arr).cast("double")).otherwise(mean)
        squares = F.aggregate(F.transform(arr, lambda x: (x - centre) * (x - centre)), F.lit(0.0), lambda acc, x: acc + x)
        out.append(F.struct(F.lit(a).alias("attribute"), n.alias("n"), mean.alias("mean"),
                            F.when(n > 0, F.sqrt(squares / n)).alias("std")))
    return rows.select("prompt_id", "completion_idx", F.inline(F.array(*out)))


def _same(col: str, rows: str = "count(1)") -> str:
    """All rows of a group hold one value, null being a value (SQL aggregate text)."""
    return f"(count({col}) = 0 OR (count({col}) = {rows} AND min({col}) = max({col})))"


def pair_rows(rows: DataFrame, order: str, attributes: Sequence[str] = ATTRIBUTES, text: str = "response",
              prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """D1 on the raw table: rows 2k and 2k + 1 in ``order`` (a dense position, as
    ``ids.dense_ids`` gives) are the two responses of prompt k. Returns (responses, errors):
    responses as (prompt_id, completion_idx, prompt, response, rating lists), errors for
    positions whose two rows don't share their prompt (a null prompt equals only
    another null), that lack a row or hold one twice, and for null positions.

    One aggregation carries each side as a struct; good pairs are unfolded again, so
    the table is scanned and shuffled once for either result."""
    side = F.struct(F.col(prompt).alias("prompt"), F.col(text).alias("response"), *attributes)
    x = rows.select(F.floor(F.col(order) / 2).cast("long").alias("prompt_id"), (F.col(order) % 2).cast("int").alias("completion_idx"),
                    F.col(prompt).alias("prompt"), side.alias("side"))
    of = lambda k: F.when(F.col("completion_idx") == k, F.col("side"))
    g = x.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_rows"), F.expr(_same("prompt")).alias("same_prompt"),
                                   F.count(of(0)).alias("n0"), F.count(of(1)).alias("n1"),
                                   F.first(of(0), ignorenulls=True).alias("s0"), F.first(of(1), ignorenulls=True).alias("s1"))
    ok = (F.col("n0") == 1) & (F.col("n1") == 1) & F.col("same_prompt") & F.col("prompt_id").isNotNull()
    both = F.array(F.struct(F.lit(0).alias("completion_idx"), "s0.*"), F.struct(F.lit(1).alias("completion_idx"), "s1.*"))
    return g.where(ok).select("prompt_id", F.inline(both)), g.where(~ok).select("prompt_id", "n_rows", "same_prompt")


def pair_consecutive(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two responses of a prompt become one row (response0, response1).

    Keyed pairing (not by row position): a prompt that does not have exactly
    one response per side, or whose rows differ in their prompt (null equals only null),
    goes to the error table instead of failing the job.
    """
    g = responses.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(_same("prompt")).alias("same_prompt"),
        F.max(F.when(F.col("completion_idx") == 0, F.col("prompt"))).alias("prompt"),
        F.max(F.when(F.col("completion_idx") == 0, F.col("response"))).alias("response0"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("response"))).alias("response1"),
    )
    ok = (F.col("n_rows") == 2) & F.col("same_prompt") & F.col("response0").isNotNull() \
        & F.col("response1").isNotNull()
    pairs = g.filter(ok).select("prompt_id", "prompt", "response0", "response1")
    errors = g.filter(~ok).select("prompt_id", "n_rows", "same_prompt")
    return pairs, errors


def _coin_sql(seed: int, prompt: str, attribute: str) -> str:
    """SQL twin of ``functions.core.coin`` (md5 of seed|prompt|attribute, low bit)."""
    return (f"CAST(CAST(conv(substr(md5(concat_ws('|', '{seed}', CAST({prompt} AS STRING), {attribute})), 1, 8), 16, 10)"
            f" AS BIGINT) % 2 AS INT)")


def _label_sql(mean0: str, mean1: str, std0: str, std1: str, attribute: str, prompt: str, seed: int,
               compat: bool, flipped: bool | None = None) -> str:
    """E1 rule as SQL text: higher mean wins; on a mean tie the lower std; on a
    full tie the seeded coin; verbosity/complexity flipped afterwards.
    ``flipped`` known at build time (literal attribute) avoids the runtime test."""
    md, sd = f"({mean0} - {mean1})", f"({std0} - {std1})"
    tie = f"{sd} <= {TIE_EPS}" if compat else f"abs({sd}) <= {TIE_EPS}"
    raw = (f"(CASE WHEN abs({md}) <= {TIE_EPS} THEN (CASE WHEN {tie} THEN {_coin_sql(seed, prompt, attribute)} "
           f"WHEN {sd} > 0 THEN 0 ELSE 1 END) WHEN {md} > 0 THEN 1 ELSE 0 END)")
    if flipped is None:
        flip_list = ", ".join(f"'{a}'" for a in FLIPPED)
        return f"CAST(CASE WHEN {attribute} IN ({flip_list}) THEN 1 - {raw} ELSE {raw} END AS INT)"
    return f"CAST({'1 - ' if flipped else ''}{raw} AS INT)"


def _side_moments_sql(attributes: Sequence[str]) -> list:
    """Mean and centred deviation per side and attribute, null without ratings (SQL aggregate text)."""
    out = []
    for s_ in (0, 1):
        for a in attributes:
            x = f"CASE WHEN completion_idx = {s_} THEN {a} END"
            out += [F.expr(f"avg({x}) AS m{s_}_{a}"), F.expr(f"stddev_pop({x}) AS d{s_}_{a}")]
    return out


def _hot_prompts(ann: DataFrame, rows: int) -> list:
    """Prompts (null may be one) with more than ``ROWS_EACH`` of the rows, of which there are few."""
    candidates = ann.stat.freqItems(["prompt_id"], max(ROWS_EACH / rows, 1e-4)).first()[0]
    asked = F.col("prompt_id").isNull() | F.col("prompt_id").isin([c for c in candidates if c is not None])
    return [r[0] for r in ann.where(asked).groupBy("prompt_id").count().where(F.col("count") > ROWS_EACH).select("prompt_id").collect()]


def _moments_by_prompt(ann: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """A row for each prompt: the moments of both sides of every attribute, from wide annotator rows.

    A prompt's sums take half a kilobyte, its rows a few numbers each. Folding before the shuffle
    keeps the sums of all prompts of an input split at once and spills where splits are large. So from
    ``ROWS_EACH`` rows on, the rows are dealt by prompt, into as many parts as their count needs, and
    folded there; only prompts that alone have more rows than a part are folded before the shuffle."""
    fold = lambda x: x.groupBy("prompt_id").agg(*_side_moments_sql(attributes))
    ann = ann.select("prompt_id", "completion_idx", *attributes)
    rows = ann.count()
    if rows <= ROWS_EACH:
        return fold(ann)
    parts = max(ann.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_EACH))
    dealt = lambda x: fold(x.repartition(parts, "prompt_id"))
    hot = _hot_prompts(ann, rows)
    if not hot:
        return dealt(ann)
    is_hot = F.coalesce(F.col("prompt_id").isin([h for h in hot if h is not None]), F.lit(False)) | (F.col("prompt_id").isNull() & F.lit(None in hot))
    return dealt(ann.where(~is_hot)).unionByName(fold(ann.where(is_hot)))


def _side_label_sql(a: str, seed: int, compat: bool) -> str:
    """The label, null where a side has no rating."""
    label = _label_sql(f"m0_{a}", f"m1_{a}", f"d0_{a}", f"d1_{a}", f"'{a}'", "prompt_id", seed, compat, a in FLIPPED)
    return f"CASE WHEN m0_{a} IS NOT NULL AND m1_{a} IS NOT NULL THEN {label} END"


def disagreement_labels_wide(ann: DataFrame, seed: int = 42, compat: bool = False,
                             attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """E1 from wide annotator rows (one row per annotator and response, one
    column per attribute): ONE keyed aggregation per prompt collects the
    moments of both sides of every attribute (:func:`_moments_by_prompt`); the
    labels are then computed row-locally and unpivoted to (prompt_id,
    attribute, label)."""
    g = _moments_by_prompt(ann, attributes)
    rows = ", ".join(f"IF(m0_{a} IS NOT NULL AND m1_{a} IS NOT NULL, named_struct('attribute', '{a}', 'label', "
                     f"{_side_label_sql(a, seed, compat)}), NULL)" for a in attributes)
    return g.select("prompt_id", F.expr(f"inline(array_compact(array({rows})))"))


def side_means_and_labels(ann: DataFrame, seed: int = 42, compat: bool = False, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(prompt_id, s0_<a>, s1_<a>, label_<a>): mean ratings of both sides and the E1 label of each
    attribute, null where a side has no rating; rows without a prompt are left out. From wide annotator
    rows in the one aggregation of :func:`disagreement_labels_wide`, so no side is paired or joined later."""
    g = _moments_by_prompt(ann.where("prompt_id is not null"), attributes)
    return g.select("prompt_id", *[F.col(f"m{s}_{a}").alias(f"s{s}_{a}") for s in (0, 1) for a in attributes],
                    *[F.expr(_side_label_sql(a, seed, compat)).alias(f"label_{a}") for a in attributes])


def rated_pairs(rows: DataFrame, seed: int = 42, compat: bool = False,
                attributes: Sequence[str] = ATTRIBUTES) -> tuple[DataFrame, DataFrame]:
    """D1 + E1 in ONE keyed aggregation: rows are (prompt_id, prompt,
    completion_idx, response, one rating column per attribute), one row per
    annotator and response. Per prompt the aggregation keeps the prompt and
    both responses (checked unique per side) and count / sum / sum of squares
    of every attribute per side; labels ``label_<attribute>`` are then
    computed row-locally. Returns (pairs, errors)."""
    aggs = [F.expr("min(prompt) AS prompt"), F.expr(f"{_same('prompt')} AS _p1")]
    for s_ in (0, 1):
        r = f"CASE WHEN completion_idx = {s_} THEN response END"
        aggs += [F.expr(f"min({r}) AS response{s_}"), F.expr(f"min({r}) = max({r}) AS _u{s_}")]
    g = rows.groupBy("prompt_id").agg(*aggs, *_side_moments_sql(attributes))
    ok = F.col("_p1") & F.col("_u0") & F.col("_u1")
    labels = [F.expr(_side_label_sql(a, seed, compat)).alias(f"label_{a}") for a in attributes]
    pairs = g.filter(ok).select("prompt_id", "prompt", "response0", "response1", *labels)
    errors = g.filter(~ok.eqNullSafe(True)).select("prompt_id", F.col("_p1").alias("same_prompt"),
                                                   F.col("_u0").alias("side0_ok"), F.col("_u1").alias("side1_ok"))
    return pairs, errors


def pick_chosen(pairs: DataFrame, attribute: str) -> DataFrame:
    """D2 on labelled pairs (``label_<attribute>`` column): chosen = response[1 - label],
    row-local (no join). Pairs without a label (a side without ratings) are left out."""
    pairs = pairs.where(F.col(f"label_{attribute}").isNotNull())
    first_wins = F.col(f"label_{attribute}") == 1
    keep = [c for c in pairs.columns if c not in ("response0", "response1") and not c.startswith("label_")]
    return pairs.select(*keep,
                        F.when(first_wins, F.col("response0")).otherwise(F.col("response1")).alias("chosen"),
                        F.when(first_wins, F.col("response1")).otherwise(F.col("response0")).alias("rejected"))


def disagreement_labels(stats: DataFrame, seed: int = 42, compat: bool = False) -> DataFrame:
    """Label 1 when response 0 wins attribute a, else 0.

    Higher mean wins; on a mean tie (|diff| <= 1e-8) the lower std wins; on a
    full tie a seeded md5 coin decides. Verbosity and complexity are flipped
    afterwards (the coin too). ``compat=True`` keeps the literal std test
    without ``abs`` (when side 0 has the lower std the label is then random).
    """
    p = stats.groupBy("prompt_id", "attribute").agg(
        F.max(F.when(F.col("completion_idx") == 0, F.col("mean"))).alias("mean0"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("mean"))).alias("mean1"),
        F.max(F.when(F.col("completion_idx") == 0, F.col("std"))).alias("std0"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("std"))).alias("std1"),
    ).filter(F.col("mean0").isNotNull() & F.col("mean1").isNotNull())
    label = F.expr(_label_sql("mean0", "mean1", "std0", "std1", "attribute", "prompt_id", seed, compat))
    return p.select("prompt_id", "attribute", label.alias("label"))


def chosen_rejected(pairs: DataFrame, labels: DataFrame, attribute: str) -> DataFrame:
    """chosen = response[1 - label], rejected = the other one."""
    lab = labels.filter(F.col("attribute") == attribute).select("prompt_id", "label")
    j = pairs.join(lab, "prompt_id", "inner")
    first_wins = F.col("label") == 1
    return j.select(*[c for c in pairs.columns if c not in ("response0", "response1")],
                    F.when(first_wins, F.col("response0")).otherwise(F.col("response1")).alias("chosen"),
                    F.when(first_wins, F.col("response1")).otherwise(F.col("response0")).alias("rejected"))


def choice_pairs(df: DataFrame, choice: str = "choice", s0: str = "s0", s1: str = "s1") -> DataFrame:
    """D3: chosen = summaries[choice], rejected = summaries[1 - choice]."""
    c0 = F.col(choice) == 0
    return df.withColumn("chosen", F.when(c0, F.col(s0)).otherwise(F.col(s1))) \
             .withColumn("rejected", F.when(c0, F.col(s1)).otherwise(F.col(s0)))


def loss_weight(df: DataFrame, target_worker: str | None, weight: float) -> DataFrame:
    """Train rows of ``target_worker`` get ``weight``, other train rows 1.0;
    validation rows carry no weight (null), as in the reference."""
    w = F.lit(1.0) if target_worker is None else \
        F.when(F.col("worker") == target_worker, F.lit(float(weight))).otherwise(F.lit(1.0))
    return df.withColumn("loss_weight", F.when(F.col("split") == "train", w).otherwise(F.lit(None).cast("double")))


# ------------------------------------------------------------------ workers
def worker_counts(df: DataFrame) -> DataFrame:
    """Rows per (split, worker)."""
    return df.groupBy("split", "worker").agg(F.count(F.lit(1)).alias("n"))


def worker_count_join(df: DataFrame) -> DataFrame:
    """Train and validation counts side by side (null where a worker is
    absent from a split). One pass with conditional counts instead of a full
    outer join of two aggregates."""
    g = df.groupBy("worker").agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("_t"),
        F.count(F.when(F.col("split") == "validation", 1)).alias("_v"))
    return g.select("worker", F.when(F.col("_t") > 0, F.col("_t")).alias("train"),
                    F.when(F.col("_v") > 0, F.col("_v")).alias("valid"))


def workers_used(df: DataFrame, min_train: int) -> DataFrame:
    g = worker_count_join(df)
    return g.filter((F.col("train") >= min_train) & F.col("valid").isNotNull()).select("worker")


def worker_semi_join(df: DataFrame, min_train: int, worker: str | None = None) -> DataFrame:
    """Keep validation rows whose worker has >= ``min_train`` train rows and
    also occurs in validation; train rows are untouched. A given ``worker`` must
    be in that set (checked on the small per-worker table) and is then the
    only validation worker kept.

    One left join with the per-worker table carries a flag to the rows; Spark
    broadcasts that table by its measured size, else shuffles."""
    used = workers_used(df, min_train)
    if worker is not None:
        used = used.filter(F.col("worker") == worker)
        if used.limit(1).count() == 0:
            raise ValueError(f"worker {worker!r} is absent or has too few annotations")
    flagged = df.join(used.withColumn("_used", F.lit(True)), "worker", "left")
    return flagged.filter((F.col("split") != "validation") | F.col("_used")).select(*df.columns)

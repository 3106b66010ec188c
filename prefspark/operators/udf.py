"""User-function surface (U1-U4): scorers, pairwise judges, tokenizers and a
re-aimed reward-model fit. Python code runs in Arrow batches (iterator
pandas UDFs: a scorer is built once per task, not per row); everything
around it (pairing, flips, aggregation) stays in native expressions.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from prefspark.functions import chat as ch
from prefspark.functions.chat import TOKEN_RE
from prefspark.functions.core import coin
from prefspark.operators.subword import release, runs
from prefspark.session import materialize

# ---------------------------------------------------------------- U1 scorers


def native_scores(prompt: Column, completion: Column) -> Column:
    """Default scorers as native columns: completion length in tokens and the
    share of the completion's distinct tokens that also occur in the prompt."""
    tp = F.regexp_extract_all(prompt, F.lit(ch.TOKEN_RE), 0)
    tc = F.regexp_extract_all(completion, F.lit(ch.TOKEN_RE), 0)
    n = F.size(F.array_distinct(tc))
    overlap = F.when(n > 0, F.size(F.array_intersect(tp, tc)) / n).otherwise(F.lit(0.0))
    return F.array(F.struct(F.lit("length").alias("attribute"), F.size(tc).cast("double").alias("reward")),
                   F.struct(F.lit("lexical_overlap").alias("attribute"), overlap.cast("double").alias("reward")))


def score_native(flat: DataFrame, keys: Sequence[str] = ("prompt_id", "completion_idx")) -> DataFrame:
    """U1 with the default scorers: long (keys..., attribute, reward)."""
    return flat.select(*keys, F.inline(native_scores(F.col("prompt"), F.col("completion"))))


def score_with(flat: DataFrame, make_scorers: Callable[[], dict[str, Callable[[pd.Series, pd.Series], pd.Series]]],
               attributes: Sequence[str], keys: Sequence[str] = ("prompt_id", "completion_idx")) -> DataFrame:
    """Pluggable scorers ``f(prompts, completions) -> rewards`` for every
    attribute. ``make_scorers`` is called once per task (load a model there)."""
    schema = StructType([StructField(a, DoubleType()) for a in attributes])

    @F.pandas_udf(schema)
    def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorers = make_scorers()
        for prompts, comps in batches:
            yield pd.DataFrame({a: pd.Series(scorers[a](prompts, comps), dtype="float64") for a in attributes})

    s = flat.select(*keys, _score(F.col("prompt"), F.col("completion")).alias("_s"))
    return s.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"),
                                                        F.col(f"_s.{a}").alias("reward")) for a in attributes])))


# ---------------------------------------------------------------- U2 judges
def judge_with(pairs: DataFrame, make_judge: Callable[[], Callable[[pd.Series, pd.Series, pd.Series], pd.Series]],
               seed: int, key: str = "pair_id") -> DataFrame:
    """Pluggable pairwise judge ``j(prompts, first, second) -> p(first wins)``
    with the seeded position flip (H3) around it: flipped pairs are shown
    reversed and the answer is mapped back to 1 - p."""
    @F.pandas_udf(DoubleType())
    def _judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = make_judge()
        for p, a, b in batches:
            yield pd.Series(judge(p, a, b), dtype="float64")

    x = pairs.withColumn("flip", coin(seed, F.col(key)) == 1)
    first = F.when(F.col("flip"), F.col("response1")).otherwise(F.col("response0"))
    second = F.when(F.col("flip"), F.col("response0")).otherwise(F.col("response1"))
    x = x.withColumn("p_raw", _judge(F.col("prompt"), first, second))
    return x.withColumn("p", F.when(F.col("flip"), F.lit(1.0) - F.col("p_raw")).otherwise(F.col("p_raw")))


def judge_each_with(pairs: DataFrame, make_judge: Callable[[], Callable[[str, str, str], float]], seed: int, key: str = "pair_id",
                    threads: int = 8, attempts: int = 1) -> DataFrame:
    """U2 for a judge that answers one pair at a time and may fail: ``j(prompt, first, second) -> p(first wins)``.

    The calls of a batch run in a pool of ``threads`` threads a task and keep their order. A call
    that raises, or returns nothing or NaN, is repeated up to ``attempts`` times in all; then
    the pair's probability is 0.5 and ``failed`` is true. ``calls`` is the number of calls
    made. Answers are written as a table, so no later use of them calls the judge again.
    Around it is the seeded position flip (H3), as in :func:`judge_with`."""
    if threads < 1 or attempts < 1:
        raise ValueError("threads and attempts must be at least 1")

    @F.pandas_udf(StructType([StructField("p", DoubleType()), StructField("failed", BooleanType()), StructField("calls", IntegerType())]))
    def _judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = make_judge()

        def ask(pair: tuple[str, str, str]) -> tuple[float, bool, int]:
            for n in range(1, attempts + 1):
                try:
                    p = float(judge(*pair))
                except Exception:  # noqa: BLE001 - whatever a judge raises is a failed call
                    continue
                if not math.isnan(p):
                    return p, False, n
            return 0.5, True, attempts

        with ThreadPoolExecutor(threads) as pool:
            for p, a, b in batches:
                rows = zip(*(s.astype(object).where(s.notna(), None) for s in (p, a, b)))
                yield pd.DataFrame(list(pool.map(ask, rows)), columns=["p", "failed", "calls"])

    x = pairs.withColumn("flip", coin(seed, F.col(key)) == 1)
    first = F.when(F.col("flip"), F.col("response1")).otherwise(F.col("response0"))
    second = F.when(F.col("flip"), F.col("response0")).otherwise(F.col("response1"))
    x = materialize(x.withColumn("_a", _judge(F.col("prompt"), first, second)), "judged")
    p = F.col("_a.p")
    return x.withColumns({"p": F.when(F.col("flip"), F.lit(1.0) - p).otherwise(p), "failed": F.col("_a.failed"), "calls": F.col("_a.calls")}).drop("_a")


def judge_failures(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_pairs, n_failed, n_calls) of answers."""
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0)).alias("n_failed"),
                                   F.coalesce(F.sum("calls"), F.lit(0)).alias("n_calls"))


def length_judge() -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    """Example judge: prefers the longer response (1.0 / 0.0 / 0.5 on ties)."""
    def j(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        la, lb = a.fillna("").str.len(), b.fillna("").str.len()
        return (la > lb).astype("float64") + 0.5 * (la == lb).astype("float64")
    return j


# ---------------------------------------------------------------- U3 tokenizers
def hashing_tokenizer(vocab: int = 50_000) -> Callable[[pd.Series], list[list[int]]]:
    """Stand-in tokenizer: whitespace tokens mapped to the first 32 bits of their md5
    modulo ``vocab``, each distinct token of a batch hashed once. A real subword
    tokenizer plugs in through the same signature; :func:`hash_token_ids` is the native twin."""
    split = re.compile(TOKEN_RE)

    def tok(texts: pd.Series) -> list[list[int]]:
        words = [split.findall(s or "") for s in texts]
        ids = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % vocab for t in set().union(*words)}
        return [[ids[t] for t in ws] for ws in words]
    return tok


def hash_token_ids(text, vocab: int = 50_000) -> Column:
    """The stand-in tokenizer as a native column (no Python on the executors)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_RE), F.lit(0)), lambda t: (
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % vocab).cast("int"))


def tokenize_with(df: DataFrame, col: str, make_tokenizer: Callable[[], Callable[[pd.Series], list[list[int]]]],
                  out: str = "input_ids") -> DataFrame:
    """Pluggable batched tokenizer -> ``array<int>`` (built once per task).

    It gets an Arrow batch in runs of bounded size, so a task holds the words and ids of one run."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def _tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = make_tokenizer()
        for texts in batches:
            for a, b in runs([t if isinstance(t, str) else "" for t in texts]):
                yield pd.Series(tok(texts.iloc[a:b].reset_index(drop=True)))
            release()

    return df.withColumn(out, _tok(F.col(col)))


# ---------------------------------------------------------------- U4 reward model
def fit_reward_model(pairs: DataFrame, features: Sequence[str], weight: str | None = None,
                     reg: float = 0.0, max_iter: int = 100):
    """U4 (re-aimed): a linear Bradley-Terry reward model r(x) = w . x.

    Input rows carry ``chosen_<f>`` and ``rejected_<f>`` feature columns; each
    pair becomes two rows (d, 1) and (-d, 0) with d = chosen - rejected, and a
    weighted logistic regression without intercept is fitted (distributed
    L-BFGS in ``pyspark.ml``). Returns (model, coefficients DataFrame).
    The fit reads its rows several times, so the differences are written as a table first
    and what ``pairs`` takes to build is done once.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = [(F.col(f"chosen_{f}") - F.col(f"rejected_{f}")).alias(f"d_{f}") for f in features]
    w = F.col(weight) if weight else F.lit(1.0)
    diffs = materialize(pairs.select(*d, w.alias("w")), "reward-diffs")
    pos = diffs.select(*[f"d_{f}" for f in features], F.lit(1.0).alias("label"), "w")
    neg = pos.select(*[(-F.col(f"d_{f}")).alias(f"d_{f}") for f in features], F.lit(0.0).alias("label"), "w")
    data = VectorAssembler(inputCols=[f"d_{f}" for f in features], outputCol="features").transform(pos.union(neg))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", fitIntercept=False,
                            regParam=reg, maxIter=max_iter)
    model = lr.fit(data)
    spark = pairs.sparkSession
    coefs = spark.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients.toArray())],
                                  "feature string, weight double")
    return model, coefs


def reward_scores(df: DataFrame, coefs: dict[str, float], prefix: str = "") -> Column:
    """Score rows with a fitted linear reward model (native expression)."""
    expr = F.lit(0.0)
    for f, c in coefs.items():
        expr = expr + F.lit(float(c)) * F.col(prefix + f)
    return expr

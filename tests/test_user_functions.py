"""U3 / U4 (no SQL twin): checked against brute force on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import udf as uf


def test_tokenize_with_matches_python(spark):
    texts = ["a b  c", "", "héllo wörld\tx\ny", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["id"]: list(r["input_ids"]) for r in uf.tokenize_with(df, "text", uf.hashing_tokenizer).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50_000 for w in (t or "").split()]
    native = {r["id"]: list(r["ids"]) for r in df.select("id", uf.hash_token_ids("text").alias("ids")).collect()}
    assert native == got


def test_reward_model_matches_newton_solution(spark):
    rng = np.random.default_rng(0)
    n, feats = 400, ["f1", "f2", "f3"]
    true_w = np.array([1.5, -0.7, 0.3])
    ch_ = rng.normal(size=(n, 3))
    rj = rng.normal(size=(n, 3))
    d = ch_ - rj
    flip = rng.random(n) > 1 / (1 + np.exp(-d @ true_w))     # noisy preferences
    ch_[flip], rj[flip] = rj[flip].copy(), ch_[flip].copy()
    wts = rng.choice([1.0, 2.0], size=n)
    rows = [tuple(map(float, ch_[i])) + tuple(map(float, rj[i])) + (float(wts[i]),) for i in range(n)]
    schema = ", ".join([f"chosen_{f} double" for f in feats] + [f"rejected_{f} double" for f in feats] + ["w double"])
    df = spark.createDataFrame(rows, schema)
    _, coefs = uf.fit_reward_model(df, feats, weight="w", max_iter=200)
    got = np.array([r["weight"] for r in coefs.orderBy("feature").collect()])
    # brute force: Newton on the weighted mirrored logistic loss without intercept
    X = np.vstack([ch_ - rj, rj - ch_])
    y = np.concatenate([np.ones(n), np.zeros(n)])
    sw = np.concatenate([wts, wts])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (sw * (p - y))
        H = (X * (sw * p * (1 - p))[:, None]).T @ X
        w -= np.linalg.solve(H, g)
    assert got == pytest.approx(w, abs=1e-3)


def test_native_scores_shape(spark):
    df = spark.createDataFrame([(1, 0, "a b c", "b c d d")], "prompt_id long, completion_idx int, prompt string, "
                                                           "completion string")
    out = {r["attribute"]: r["reward"] for r in uf.score_native(df).collect()}
    assert out == {"length": 4.0, "lexical_overlap": pytest.approx(2 / 3)}
    assert uf.score_native(df).filter(F.col("reward") < 0).count() == 0


def test_fit_builds_its_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(float(i % 7), float(i % 5), float(i % 3), float(i % 2)) for i in range(60)]
    raw = spark.createDataFrame(rows, "chosen_x double, rejected_x double, chosen_y double, rejected_y double")
    once = raw.withColumn("chosen_x", counted("chosen_x"))
    _, coefs = uf.fit_reward_model(once, ["x", "y"], max_iter=30)
    assert seen.value == len(rows)
    plain = {r.feature: r.weight for r in uf.fit_reward_model(raw, ["x", "y"], max_iter=30)[1].collect()}
    assert {r.feature: r.weight for r in coefs.collect()} == pytest.approx(plain)


def test_tokenize_with_gets_runs_of_bounded_size(spark):
    def make():
        def tok(texts):
            size = sum(len(t or "") for t in texts)
            assert len(texts) == 1 or size <= 1 << 20, size
            return [[len(t or "")] for t in texts]
        return tok

    df = spark.range(12).select("id", F.when(F.col("id") != 3, F.repeat(F.lit("x"), 400_000 + F.col("id").cast("int"))).alias("text")).coalesce(1)
    got = {r.id: list(r.n) for r in uf.tokenize_with(df, "text", make, "n").select("id", "n").collect()}
    assert got == {i: [0 if i == 3 else 400_000 + i] for i in range(12)}

"""Edge rows with hand-computed results: single rows, NaN, nulls, ties and missing cells."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prefspark.functions import chat as ch
from prefspark.functions import seq as sq
from prefspark.functions.core import ATTRIBUTES, clamp
from prefspark.operators import evaluate as ev
from prefspark.operators import graph as gr
from prefspark.operators import labels as lb
from prefspark.operators import rollout as ro
from prefspark.operators import shape as sh

NAN = float("nan")


def test_clamp_keeps_nan_and_null(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 9.0), (4, -9.0), (5, 0.5)], "i int, x double")
    got = {r.i: r.y for r in df.select("i", clamp("x", -1, 1).alias("y")).collect()}
    assert math.isnan(got[1]) and got[2] is None and [got[3], got[4], got[5]] == [1.0, -1.0, 0.5]


@pytest.mark.parametrize("clip", [3.0, None])
def test_normalize_single_row_nan_and_null_step(spark, clip):
    rows = [(1, 2.0), (2, 1.0), (2, NAN), (None, 0.0), (None, 2.0)]
    got = ro.normalize(spark.createDataFrame(rows, "step int, score double"), "score", "z", clip).collect()
    assert len(got) == 5
    assert all(math.isnan(r.z) for r in got if r.step in (1, 2))
    assert sorted(round(r.z, 4) for r in got if r.step is None) == [-0.7071, 0.7071]


def test_leave_one_out_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 3.0), (1, 7, 5.0)], "step int, prompt_id int, score double")
    got = {(r.prompt_id, r.score): r.advantage for r in ro.rloo_advantage(df, "score").collect()}
    assert got[(None, 1.0)] == -2.0 and got[(None, 3.0)] == 2.0 and math.isnan(got[(7, 5.0)])


def test_kl_of_nan_is_nan(spark):
    df = spark.createDataFrame([([NAN, -1.0], [-1.0, -1.0]), ([-100.0], [0.0])], "m array<double>, r array<double>")
    got = [r.k for r in df.select(sq.kl_estimate("m", "r", "k3").alias("k")).collect()]
    assert math.isnan(got[0]) and got[1] == pytest.approx(math.expm1(40) - 40)


def test_importance_weight_of_nan_is_nan(spark):
    df = spark.createDataFrame([(1, [-1.0], [-1.0], [NAN], 0.5)], "step int, model_logps array<double>, ref_logps array<double>, gen_logps array<double>, prob double")
    assert math.isnan(ro.policy_loss(df, 0.1, "k1", rloo_baseline=False, tis_threshold=2.0).first().seq_loss)


def _annotations(rows):
    return [(p, f"prompt {p}", s, f"r{p}{s}", *[v] * len(ATTRIBUTES)) for p, s, v in rows]


SCHEMA = "prompt_id int, prompt string, completion_idx int, response string, " + ", ".join(f"{a} double" for a in ATTRIBUTES)


def test_unrated_side_gets_no_label(spark):
    df = spark.createDataFrame(_annotations([(1, 0, None), (1, 1, 2.0), (2, 0, 3.0), (2, 1, 2.0)]), SCHEMA)
    pairs, errors = lb.rated_pairs(df)
    assert {r.prompt_id: r.label_helpfulness for r in pairs.collect()} == {1: None, 2: 1} and errors.count() == 0
    assert [(r.prompt_id, r.chosen) for r in lb.pick_chosen(pairs, "helpfulness").collect()] == [(2, "r20")]
    long = df.select("prompt_id", "completion_idx", F.lit("helpfulness").alias("attribute"), F.col("helpfulness").alias("rating"))
    separate = lb.disagreement_labels(lb.side_stats(long))
    assert [(r.prompt_id, r.label) for r in separate.collect()] == [(2, 1)]


def test_equal_ratings_tie_exactly(spark):
    df = spark.createDataFrame(_annotations([(1, 0, 3.3)] * 3 + [(1, 1, 3.3)] * 2), SCHEMA)
    long = df.select("prompt_id", "completion_idx", F.lit("helpfulness").alias("attribute"), F.col("helpfulness").alias("rating"))
    assert [r.std for r in lb.side_stats(long).collect()] == [0.0, 0.0]
    arrays = spark.createDataFrame([(1, 0, [3.3] * 3, []), (1, 1, [3.3] * 2, [1.0, 2.0])], "prompt_id int, completion_idx int, helpfulness array<double>, verbosity array<double>")
    got = {(r.completion_idx, r.attribute): (r.n, r["mean"], r.std) for r in lb.side_stats_from_arrays(arrays, ["helpfulness", "verbosity"]).collect()}
    assert got[(0, "helpfulness")][2] == got[(1, "helpfulness")][2] == 0.0
    assert got[(0, "verbosity")] == (0, None, None) and got[(1, "verbosity")] == (2, 1.5, 0.5)
    from prefspark.functions.core import coin
    seed = {r.c for r in df.select(coin(42, F.col("prompt_id"), F.lit("helpfulness")).alias("c")).collect()}
    assert {r.label_helpfulness for r in lb.rated_pairs(df)[0].collect()} == seed


def test_positional_pairs_and_errors(spark):
    rows = [(0, "p", "a", [1.0]), (1, "p", "b", [2.0]), (2, "q", "c", [1.0]), (3, "x", "d", [1.0]), (4, "z", "e", [1.0])]
    ok, bad = lb.pair_rows(spark.createDataFrame(rows, "pos long, prompt string, response string, helpfulness array<double>"), "pos", ["helpfulness"])
    assert sorted((r.prompt_id, r.completion_idx, r.response) for r in ok.collect()) == [(0, 0, "a"), (0, 1, "b")]
    assert sorted((r.prompt_id, r.n_rows, r.same_prompt) for r in bad.collect()) == [(1, 2, False), (2, 1, True)]


def test_missing_completion_is_no_loss(spark):
    rows = [("a", "b", "h", 1, 0, 1.0), ("a", "b", "h", 1, 1, 2.0), ("a", "b", "h", 2, 0, 1.0)]
    df = spark.createDataFrame(rows, "leader string, follower string, attribute string, prompt_id int, completion_idx int, reward double")
    got = {r.follower: (r.a, r.b) for r in ev.correction_matrix(df, ["a", "b"]).collect()}
    assert got["b"][0] == 1.0 and math.isnan(got["b"][1]) and all(map(math.isnan, got["a"]))


def test_null_content_keeps_the_message(spark):
    df = spark.sql("SELECT array(named_struct('role', 'user', 'content', cast(null AS string)), named_struct('role', 'assistant', 'content', 'x')) AS m")
    assert df.select(ch.render_chat("m").alias("t")).first().t == "<|user|>\n\n<|assistant|>\nx\n"


def test_nan_probability_is_one_nan(spark):
    rows = [("s", 1, "h", p, v) for p, v in ((0, NAN), (1, 1.0))]
    pl = spark.createDataFrame(rows, "split string, prompt_id int, attribute string, player int, reward double")
    text = gr.bt_probability_mean(pl, 2, ["h"]).first().prob
    assert math.isnan(text[0][1]) and math.isnan(text[1][0]) and math.copysign(1, text[1][0]) == math.copysign(1, text[0][1]) == 1.0


def test_groups_of_any_length(spark):
    n = 3000
    long = spark.range(n).select(F.lit(1).alias("prompt_id"), F.col("id").cast("int").alias("completion_idx"), F.col("id").cast("double").alias("reward"))
    assert sh.unflatten_rewards(long).first().rewards == [float(i) for i in range(n)]
    with pytest.raises(PySparkException):
        sh.unflatten_rewards(long, most=100).collect()
    flat = spark.range(2 * n).select(F.col("id").alias("seq_idx"), F.col("id").cast("string").alias("text"))
    assert {len(r.completions) for r in sh.group_return_sequences(flat, n).collect()} == {n}
    with pytest.raises(PySparkException):
        sh.group_return_sequences(flat, n + 1).collect()


def test_token_counter_hook(spark):
    from prefspark.operators import text as tx
    df = spark.createDataFrame([(1, "abc de"), (2, "a"), (3, None)], "id int, prompt string")
    keep, stats = tx.filter_prompt_length(df, 2, "prompt", counter=F.length)
    assert sorted(r.id for r in keep.collect()) == [2, 3] and stats.first().n_removed == 1
    lines = F.transform(F.split(F.lit("ab\nc\nd"), "\n"), F.length)
    assert df.select(ch.truncate_lines(F.lit("ab\nc\nd"), 3, "", lines).alias("t")).first().t == "ab\nc"


def test_groups_with_too_few_or_too_many_sequences(spark, tmp_path):
    from prefspark.plans.catalog import QUERIES
    rows = [(0, 5), (1, 6), (2, None), (3, 8), (3, 9), (6, 1), (5, 2), (None, 7)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.prompt_idx: r.completions for r in QUERIES["group_return_sequences"](spark, str(tmp_path)).collect()}
    assert got == {0: ["5", "6", None, "8", "9"], 1: ["2", "1"], None: ["7"]}
    flat = spark.createDataFrame(rows, "seq_idx long, text int")
    with pytest.raises(PySparkException):
        sh.group_return_sequences(flat.where("seq_idx is null"), 4).collect()

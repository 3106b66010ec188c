"""E11, E12, F5 and C9 in their one-scan forms; D1, C2, C3 and A6 edge rows."""

import collections
import contextlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from prefspark.functions import seq as sq
from prefspark.operators import labels as lb
from prefspark.operators import rollout as ro
from prefspark.operators import text as tx
from prefspark.sources import io as sio

SF = "/root/testdata/sf0.001"
ROLL = "step int, prompt_id int, pair int, side int, model_logps array<double>, ref_logps array<double>, gen_logps array<double>, score double, prob double, has_eos boolean"


def joined_metrics(df, beta, penalty):
    """E11 as it is defined: both sides' losses, then the join, then plain means."""
    def side(k):
        p = ro.eos_probability_penalty("prob", "has_eos", penalty, k == 1)
        x = df.where(F.col("side") == k).withColumn("raw", F.col("prob")).withColumn("prob", p)
        x = ro.policy_loss(x, beta, "k3", 0.5, True)
        return x.select("step", "prompt_id", "pair", "raw", "seq_loss", "score", "kl", sq.asum(F.col("model_logps")).alias("b"),
                        F.col("has_eos").cast("double").alias("eos"), F.size("model_logps").cast("double").alias("len"))
    j = side(0).alias("l").join(side(1).alias("f"), ["step", "prompt_id", "pair"])
    cols = {"probabilities": F.col("l.raw"), "margins": F.col("l.b") - F.col("f.b")}
    for s, n in (("l", "leader"), ("f", "follower")):
        cols |= {f"score_{n}": F.col(f"{s}.score"), f"kl_{n}": F.col(f"{s}.kl"), f"loss_{n}": F.col(f"{s}.seq_loss"), f"logps_{n}": F.col(f"{s}.b"),
                 f"entropy_{n}": -F.col(f"{s}.b"), f"{n}_contain_eos": F.col(f"{s}.eos"), f"{n}_completion_length": F.col(f"{s}.len")}
    return j.groupBy("step").agg(*[F.avg(e).alias(n) for n, e in cols.items()])


def rolls(spark, rng, n, odd=False):
    rows = []
    for _ in range(n):
        k = rng.randrange(1, 6)
        arrays = [[-rng.random() * 3 for _ in range(k)] for _ in range(3)]
        if odd and rng.random() < 0.1:
            arrays[rng.randrange(2)] = None
        prob = None if odd and rng.random() < 0.1 else rng.random()
        rows.append((rng.randrange(6), rng.randrange(4), rng.randrange(3), rng.randrange(2), *arrays, rng.random(), prob, rng.random() < 0.7))
    rows.append((77, 1, 1, 0, [-1.0], [-1.5], [-1.0], 1.0, 0.5, True))                                # no partner
    rows += [(78, 1, 1, s, [-1.0, -2.0], [-1.5, -1.0], [-1.0, -1.0], 1.0, 0.5, s == 0) for s in (0, 1)]    # batches of one
    rows += [(79, 1, p, s, [-1.0], [-1.5], [-1.0], 1.0, float("nan") if p == 2 else 0.25, True) for s in (0, 1) for p in range(4)]
    return spark.createDataFrame(rows, ROLL).repartition(4)


@pytest.mark.parametrize("odd", [False, True])
def test_rollout_metrics_equal_the_joined_form(spark, odd):
    """Partners repeat and lack; with ``odd`` log-probs and probabilities are null here and there."""
    df = rolls(spark, random.Random(odd), 160, odd).cache()
    want = {r.step: r.asDict() for r in joined_metrics(df, 0.05, 1.0).collect()}
    got = {r.step: r.asDict() for r in ro.rollout_metrics(df, F.col("side") == 1, 0.05, 1.0).collect()}
    assert set(got) == set(want) and 77 not in got
    for step, row in want.items():
        assert set(row) == set(got[step])
        for c, v in row.items():
            assert got[step][c] == pytest.approx(v, rel=1e-9, abs=1e-9, nan_ok=True), (step, c)
    assert math.isnan(got[78]["loss_leader"]) and math.isnan(got[79]["score_follower"])


def test_normalized_advantage_equals_the_chain(spark):
    rng = random.Random(3)
    rows = [(s, p, rng.gauss(1e6 if s == 2 else 0, 1) if rng.random() > 0.05 else None) for s in range(4) for p in range(5) for _ in range(rng.randrange(2, 6))]
    rows += [(9, 1, 1.0), (10, 1, 1.0), (10, 1, 2.0), (None, None, 3.0), (None, None, 5.0), (None, None, 5.0), (11, 1, None), (11, 1, None)]
    df = spark.createDataFrame(rows, "step int, prompt_id int, score double").withColumn("id", F.monotonically_increasing_id()).cache()
    want = {r.id: r.z for r in ro.normalize(ro.rloo_advantage(df, "score"), "advantage", "z").collect()}
    got = {r.id: r.adv_norm for r in ro.normalized_rloo_advantage(df, "score").collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        if v is None or got[i] is None:
            assert got[i] is None and (v is None or math.isnan(v)), i
        else:
            assert got[i] == pytest.approx(v, rel=1e-6, abs=1e-6, nan_ok=True)


def test_ratio_variance_of_large_ratios(spark):
    rng = np.random.default_rng(1)
    rows, ratios = [], []
    for k in range(200):
        r = 1e6 + rng.normal(size=5)
        ratios += r.tolist()
        rows.append((1, k // 4, 0, 0, np.log(r).tolist(), [0.0] * 5, [0.0] * 5, 1.0, 0.5, True))
    rows.append((2, 1, 0, 0, [0.5], [0.0], [0.0], 1.0, 0.5, False))
    m = {r.step: r for r in ro.policy_metrics(spark.createDataFrame(rows, ROLL).repartition(8), 0.1, 1.0, 0.2).collect()}
    exact = np.exp(np.log(np.array(ratios)))
    assert m[1].ratio_var == pytest.approx(exact.var(ddof=1), rel=1e-6) and m[1].ratio == pytest.approx(exact.mean(), rel=1e-12)
    assert m[1].num_eos == 200 and m[2].num_eos == 0 and m[2].ratio_var is None


def test_permuted_rank_is_a_bijection(spark):
    sizes = [*range(1, 130), 255, 256, 257, 1000, 1023, 2047, 2500, 4095, 4096, 4999, 5000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    g = df.withColumn("x", ro.permuted_rank(F.col("p"), F.col("n"), 7, [F.col("n")])).groupBy("n").agg(
        F.countDistinct("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum((F.col("x") == F.col("p")).cast("int")).alias("fixed"))
    rows = g.collect()
    assert len(rows) == len(sizes) and all(r.d == r.n and r.lo == 0 and r.hi == r.n - 1 for r in rows)
    assert sum(r.fixed for r in rows if r.n > 1000) < 60          # about one a permutation


def test_every_size_to_five_thousand_is_permuted(spark):
    """All sizes at once: the sums of ranks and of their squares are those of 0..n-1, for sizes in steps of 7."""
    df = spark.range(1, 5001, 7).select(F.col("id").alias("n")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    bad = df.withColumn("x", ro.permuted_rank(F.col("p"), F.col("n"), 1)).groupBy("n").agg(F.countDistinct("x").alias("d"), F.max("x").alias("hi")).where("d <> n OR hi <> n - 1")
    assert bad.count() == 0


def test_batches_are_cut_and_positions_checked(spark):
    df = spark.createDataFrame([(s, p) for s, n in ((1, 10), (2, 37), (None, 3)) for p in range(n)], "step int, position long")
    got = ro.permuted_batches(df, 5, 3, 8, 4, "position").collect()
    for step, n in ((1, 10), (2, 37), (None, 3)):
        for e in range(3):
            own = [r for r in got if r.step == step and r.epoch == e]
            assert sorted(r.perm_rank for r in own) == list(range(n))
            assert all(r.mini_batch == r.perm_rank // 8 and r.micro_batch == r.perm_rank % 8 // 4 for r in own)
    orders = {tuple(r.perm_rank for r in sorted((r for r in got if r.step == 2 and r.epoch == e), key=lambda r: r.position)) for e in range(3)}
    assert len(orders) == 3
    with pytest.raises(Exception, match="without gaps"):
        ro.permuted_batches(spark.createDataFrame([(1, 5)], "step int, position long"), 5, 1, 8, 4, "position").collect()


@pytest.mark.parametrize("name,most,exchanges", [("rollout_metrics", 1, 2), ("normalize_advantage", 3, None), ("pair_rows", 1, 1)])
def test_scans_and_exchanges(spark, name, most, exchanges):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF).explain(mode="formatted")
    tree = buf.getvalue().split("\n\n(")[0]
    assert tree.count("Scan parquet") <= most, tree
    assert exchanges is None or tree.count("Exchange") <= exchanges, tree


def test_no_window_over_the_permuted_rows(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()["permuted_batches"](spark, SF).explain()
    assert "Window" not in buf.getvalue() and "Sort " not in buf.getvalue().replace("SortMergeJoin", "")


def test_null_prompts_and_positions_in_pairs(spark):
    rows = spark.createDataFrame([(0, None, "a"), (1, "p", "b"), (2, None, "c"), (3, None, "d"), (4, "p", "e"), (5, "p", "f"), (6, "q", "g"),
                                  (8, "r", "h"), (8, "r", "i"), (None, "s", "j"), (None, "s", "k")], "position long, prompt string, response string")
    good, bad = lb.pair_rows(rows, "position", [])
    assert sorted((r.prompt_id, r.completion_idx, r.prompt, r.response) for r in good.collect() if r.prompt) == [(2, 0, "p", "e"), (2, 1, "p", "f")]
    assert sorted((r.prompt_id, r.response) for r in good.collect() if r.prompt is None) == [(1, "c"), (1, "d")]
    assert {(r.prompt_id, r.n_rows, r.same_prompt) for r in bad.collect()} == {(0, 2, False), (3, 1, True), (4, 2, True), (None, 2, True)}
    keyed = spark.createDataFrame([(1, None, 0, "a"), (1, "p", 1, "b"), (2, None, 0, "c"), (2, None, 1, "d")], "prompt_id long, prompt string, completion_idx int, response string")
    pairs, errors = lb.pair_consecutive(keyed)
    assert [r.prompt_id for r in pairs.collect()] == [2] and [(r.prompt_id, r.same_prompt) for r in errors.collect()] == [(1, False)]


def test_null_texts_have_no_tokens(spark):
    df = spark.createDataFrame([("a b", None), (None, None), ("a b c", "a"), ("a", "b")], "chosen string, rejected string")
    assert tx.filter_pair_length(df, 2).count() == 3
    assert tx.filter_message_length(df, 2, "chosen").count() == 3 and tx.filter_message_length(df, 0, "chosen").count() == 1


def test_sources(spark):
    with pytest.raises(ValueError, match="split"):
        sio.normalize_source("Rated_Responses", None)
    items = spark.createDataFrame([(5, "do", "out", "gen", 1, "x"), (3, "be", "out", "gen", 2, None)], "item_id int, instruction string, output string, generator string, n int, tag string")
    got = sio.normalize_source("instruction_eval", items)
    assert got.columns == ["prompt_id", "prompt", "n", "tag", "split"]
    assert sorted((r.prompt_id, r.prompt[0].content, r.n, r.tag, r.split) for r in got.collect()) == [(0, "be", 2, None, "validation"), (1, "do", 1, "x", "validation")]
    both = sio.prompt_sources({"Instruction_Eval": items, "constraint_eval": items.withColumnRenamed("instruction", "prompt")})
    assert both.columns == ["source", "prompt_id", "prompt", "split"] and both.count() == 4


def test_side_means_and_labels_are_those_of_the_joined_form(spark):
    rng = random.Random(5)
    rate = lambda: rng.choice([None, 0.0, 1.0, 2.0, 4.0])
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, -1, 0, 1]), *[rate() for _ in lb.ATTRIBUTES]) for _ in range(300)]
    ann = spark.createDataFrame(rows, "prompt_id long, completion_idx int, " + ", ".join(f"{a} double" for a in lb.ATTRIBUTES))
    st = lb.side_stats(ann.unpivot(["prompt_id", "completion_idx"], list(lb.ATTRIBUTES), "attribute", "rating")).collect()
    mean = {(r.prompt_id, r.completion_idx, r.attribute): r.mean for r in st}
    label = {(r.prompt_id, r.attribute): r.label for r in lb.disagreement_labels(spark.createDataFrame(st), 3).collect()}
    got = lb.side_means_and_labels(ann, 3).collect()
    assert {r.prompt_id for r in got} == {r[0] for r in rows} - {None} and len(got) == len({r.prompt_id for r in got})
    for r in got:
        for a in lb.ATTRIBUTES:
            assert [r[f"s{s}_{a}"] for s in (0, 1)] == [mean.get((r.prompt_id, s, a)) for s in (0, 1)]
            assert r[f"label_{a}"] == label.get((r.prompt_id, a))


def test_reward_features_take_one_shuffle_of_the_annotations(spark):
    from prefspark.plans import catalog as ct
    for df in (ct._rated_features(spark, SF), ct._rated_features_by_attribute(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_many_annotations_are_dealt_by_prompt_before_they_are_folded(spark, monkeypatch):
    """No sums of prompts are kept below the shuffle, but those of a prompt with more rows than a part; same results."""
    rng = random.Random(9)
    rate = lambda: rng.choice([None, 0.0, 1.0, 2.0, 4.0])
    row = lambda p: (p, rng.choice([None, -1, 0, 1]), *[rate() for _ in lb.ATTRIBUTES])
    even = [row(rng.randrange(60)) for _ in range(240)]
    schema = "prompt_id long, completion_idx int, " + ", ".join(f"{a} double" for a in lb.ATTRIBUTES)
    for rows in (even, even + [row(rng.choice([7, None])) for _ in range(200)]):
        ann = spark.createDataFrame(rows, schema).repartition(4).cache()
        forms = []
        for most in (10**6, 40):
            monkeypatch.setattr(lb, "ROWS_EACH", most)
            forms.append((lb.side_means_and_labels(ann, 3), lb.disagreement_labels_wide(ann, 3)))
        tree = forms[1][0]._jdf.queryExecution().executedPlan().toString()
        for whole, dealt in zip(*forms):
            near = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
            assert collections.Counter(map(near, whole.collect())) == collections.Counter(map(near, dealt.collect()))
        assert tree.count("HashAggregate") == (2 if rows is even else 4) and ("Union" in tree) == (rows is not even)
        if rows is even:
            assert "HashAggregate" not in tree[tree.index("Exchange "):]

"""B4 with a generator, U2 with failures, U4 for each attribute."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.functions import chat as ch
from prefspark.operators import reward_fit as rf
from prefspark.operators import rounds as rd
from prefspark.operators import udf as uf

# ---------------------------------------------------------------- B4


def echo(p):
    return F.concat(F.lit("<"), p, F.lit(">"))


def said(p):
    return F.md5(ch.render_chat(p))


def literal(prompt, given, instruction, rounds, generate):
    out = [given if given is not None else generate(prompt)]
    while len(out) < rounds:
        out.append(generate(prompt + out[-1] + instruction))
    return out


def test_rounds_of_texts_given_and_generated(spark):
    rows = [(1, "p", None), (2, "q", "mine"), (3, "", ""), (3, "q", "mine")]
    df = spark.createDataFrame(rows, "prompt_id long, prompt string, leader_completion string")
    got = sorted((r.prompt_id, r.prompt, r.completions) for r in rd.correction_loop(df, echo, "!", 4).collect())
    assert got == sorted((i, p, literal(p, g, "!", 4, lambda x: f"<{x}>")) for i, p, g in rows)
    none = rd.correction_loop(df.drop("leader_completion"), echo, "!", 2).collect()
    assert {r.prompt: r.completions[1] for r in none}["q"] == "<q<q>!>"
    null = rd.correction_loop(spark.createDataFrame([(None, 7)], "prompt string, x int"), lambda p: F.coalesce(p, F.lit("nothing")), "!", 2).first()
    assert null.completions == ["nothing", "nothing!"] and null.x == 7
    assert rd.correction_loop(df.where("false"), echo, "!", 2).collect() == []


def test_rounds_of_messages(spark):
    m = "array<struct<role string, content string>>"
    df = spark.createDataFrame([(1, [("user", "hi")], [("assistant", "ho")])], f"prompt_id int, prompt {m}, leader_completion {m}".replace("role string", "role: string").replace("content string", "content: string"))
    got = rd.correction_loop(df, said, "again", 3).first().completions
    assert [len(c) for c in got] == [1, 1, 1] and got[0][0].asDict() == {"role": "assistant", "content": "ho"}
    second = spark.range(1).select(F.md5(F.lit(f"<|user|>\nhi\n<|assistant|>\n{got[1][0].content}\n<|user|>\nagain\n"))).first()[0]
    assert got[2][0].content == second


def test_a_model_hook_is_made_once_a_task(spark):
    def make():
        made = [0]

        def model(prompts):
            made[0] += 1
            return [f"{made[0] > 0}:{p}" for p in prompts]
        return model

    df = spark.createDataFrame([(k, f"p{k}") for k in range(20)], "prompt_id int, prompt string")
    got = {r.prompt_id: r.completions for r in rd.correction_loop(df, rd.text_generator(make), "!", 2).collect()}
    assert got[3] == ["True:p3", "True:p3True:p3!"]


@pytest.mark.parametrize("bad", [{"rounds": 1}, {"return_sequences": 2}, {"instruction": ""}])
def test_arguments_are_checked(spark, bad):
    df = spark.createDataFrame([(1, "p")], "prompt_id int, prompt string")
    kw = {"instruction": "!", "rounds": 2} | bad
    with pytest.raises(ValueError):
        rd.correction_loop(df, echo, kw.pop("instruction"), kw.pop("rounds"), **kw)
    with pytest.raises(TypeError):
        rd.correction_loop(df, echo, "!", 2, prompt="prompt_id")


def test_a_restart_goes_on_after_the_last_whole_round(spark, tmp_path):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "prompt_id int, prompt string")
    folder, calls = str(tmp_path / "run"), []

    def failing(p):
        calls.append(1)
        return F.when(F.lit(len(calls) == 3), F.raise_error(F.lit("lost"))).otherwise(echo(p))

    with pytest.raises(Exception, match="lost"):
        rd.correction_loop(df, failing, "!", 4, folder=folder).collect()
    again = []

    def counted(p):
        again.append(1)
        return F.concat(F.lit("{"), p, F.lit("}"))

    got = {r.prompt_id: r.completions for r in rd.correction_loop(df, counted, "!", 4, folder=folder).collect()}
    assert len(again) == 2 and got[7] == ["<p7>", "<p7<p7>!>", "{p7<p7<p7>!>!}", "{p7{p7<p7<p7>!>!}!}"]
    with pytest.raises(ValueError, match="another instruction"):
        rd.correction_loop(df, echo, "?", 4, folder=folder)


# ---------------------------------------------------------------- U2


def pairs_of(spark, n=200):
    return spark.createDataFrame([(k, f"p{k}", "a" * (k % 7), None if k % 11 == 0 else "b" * (k % 5)) for k in range(n)], "pair_id long, prompt string, response0 string, response1 string")


def test_a_failing_judge_gives_a_half_and_is_counted(spark):
    def make():
        def judge(prompt, a, b):
            k = int(prompt[1:])
            if k % 10 == 3:
                raise TimeoutError("no answer")
            if k % 10 == 4:
                return None
            if k % 10 == 5:
                return float("nan")
            return (len(a or "") + 1) / (len(a or "") + len(b or "") + 2)
        return judge

    got = {r.pair_id: r for r in uf.judge_each_with(pairs_of(spark), make, 42, attempts=2).collect()}
    flips = {r.pair_id: r.flip for r in uf.judge_with(pairs_of(spark), uf.length_judge, 42).collect()}
    for k, r in got.items():
        a, b = len(r.response0 or "") + 1, len(r.response1 or "") + 1
        bad = k % 10 in (3, 4, 5)
        assert (r.failed, r.calls, r.flip) == (bad, 2 if bad else 1, flips[k])
        assert r.p == pytest.approx(0.5 if bad else a / (a + b))
    s = uf.judge_failures(uf.judge_each_with(pairs_of(spark), make, 42)).first()
    assert (s.n_pairs, s.n_failed, s.n_calls) == (200, 60, 200)
    assert uf.judge_failures(uf.judge_each_with(pairs_of(spark).where("false"), make, 42)).first().n_failed == 0


def test_calls_run_together_in_order_and_are_repeated(spark):
    def make():
        seen, lock, meet = {}, threading.Lock(), threading.Barrier(4, timeout=30)

        def judge(prompt, a, b):
            with lock:
                seen[prompt] = seen.get(prompt, 0) + 1
                n = seen[prompt]
            if n == 1:
                meet.wait()                       # ends only if four calls are under way at once
                raise OSError("the first call fails")
            return int(prompt[1:]) / 1000
        return judge

    got = uf.judge_each_with(pairs_of(spark, 40).coalesce(1), make, 1, threads=4, attempts=3).collect()
    assert all(not r.failed and r.calls == 2 for r in got)
    assert all((1 - r.p if r.flip else r.p) == pytest.approx(r.pair_id / 1000) for r in got)


# ---------------------------------------------------------------- U4


def sample(rng, n, names, truth):
    rows = []
    for a in names:
        for _ in range(n):
            c, r = rng.normal(size=3), rng.normal(size=3)
            if rng.random() > 1 / (1 + np.exp(-(c - r) @ truth[a])):
                c, r = r, c
            rows.append((a, *map(float, c), *map(float, r), float(rng.choice([0.5, 1, 3])), float(rng.choice([0, 0.3]))))
    return rows


SCHEMA = "attribute string, chosen_x double, chosen_y double, chosen_z double, rejected_x double, rejected_y double, rejected_z double, w double, m double"


def newton(rows, reg, center):
    c, r = (np.array([row[i:i + 3] for row in rows]) for i in (1, 4))
    sw, m = (np.array([row[i] for row in rows]) for i in (7, 8))
    d, s, w = c - r, c + r, np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(d @ w - m)))
        g = -(d.T @ (sw * (1 - p))) / sw.sum() + 2 * center * s.T @ (s @ w) / len(rows) + reg * w
        h = (d * (sw * p * (1 - p))[:, None]).T @ d / sw.sum() + 2 * center * s.T @ s / len(rows) + reg * np.eye(3)
        w = w - np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("reg,center", [(0.0, 0.0), (0.1, 0.02)])
def test_models_equal_newton_for_each_attribute(spark, reg, center):
    rng = np.random.default_rng(0)
    truth = {"help": np.array([1.5, -0.7, 0.3]), "verb": np.array([-4.0, 2.0, 0.0]), "cohe": np.zeros(3)}
    rows = sample(rng, 300, truth, truth)
    extra = [("help", None, *[0.0] * 7), ("verb", float("nan"), *[0.0] * 7), (None, *[1.0] * 8), ("zero", *[1.0] * 6, 0.0, 0.0)]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(5)
    got = rf.fit_reward_models(df, ["x", "y", "z"], weight="w", margin="m", reg=reg, center=center)
    for a in truth:
        assert got[a].weights == pytest.approx(newton([r for r in rows if r[0] == a], reg, center), abs=1e-8)
        assert got[a].converged and got[a].steps <= 10 and got[a].n_pairs == 300
    assert list(got["zero"].weights) == [0.0] * 3 and not got["zero"].converged and set(got) == {*truth, "zero"}
    one = {(r.attribute, r.feature): r.weight for r in rf.newton_steps(df.where("attribute = 'help'"), ["x", "y", "z"], 30, weight="w", margin="m", reg=reg, center=center).collect()}
    assert [one["help", f] for f in "xyz"] == pytest.approx(list(got["help"].weights), abs=1e-8)


def test_separable_pairs_and_a_feature_that_never_differs(spark):
    rows = [("a", 1.0 + k % 3, 5.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rf.fit_reward_models(df, ["x", "y"], max_iter=8)["a"]
    assert not got.converged and got.weights[0] > 3 and got.weights[1] == pytest.approx(0)
    assert rf.fit_reward_models(df, ["x", "y"], reg=0.1)["a"].converged
    table = rf.weights_table(spark, {"a": got}, ["x", "y"])
    assert table.count() == 2 and rf.fit_reward_models(df.where("false"), ["x"]) == {}
    fitted = rf.fit_reward_models(df, ["x", "y"], reg=0.1)
    scored = df.select((rf.model_scores(df, fitted, ["x", "y"], "chosen_") - rf.model_scores(df, fitted, ["x", "y"], "rejected_")).alias("d"))
    assert scored.where("d <= 0").count() == 0

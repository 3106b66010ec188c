"""Fixture views: the reference's table shapes derived from the driver tables.

Every view is a pure function of the driver tables (no randomness), so the
same view can be rebuilt in DuckDB for the oracle (``prefspark.plans.oracle``).
All views are row-local projections / explodes of their source table, or one
keyed aggregation; none uses a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.core import ATTRIBUTES, nan, sigmoid
from prefspark.sources.tables import spread, table

# Fixture models and completions per model.
MODELS = ["m0", "m1", "m2", "m3"]
COMPLETIONS = 3


def _split_of(id_col: Column) -> Column:
    return F.when(id_col % 5 == 0, F.lit("validation")).otherwise(F.lit("train"))


def _attr_name(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ATTRIBUTES]), (idx + 1).cast("int"))


def rewards_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, attribute, prompt_id, completion_idx, reward), one row per cell.

    Item k = (m*5 + a)*3 + c of each embedding gives the reward of model m,
    attribute a, completion c. One posexplode; no cross join.
    """
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = emb.select("vec_id", F.posexplode(F.slice("embedding", 1, len(MODELS) * 5 * COMPLETIONS))
                   .alias("k", "v"))
    m = F.expr("k div 15")
    a = F.expr("(k div 3) % 5")
    r = F.floor(F.col("v").cast("double") * 40) / 4
    return x.select(
        F.concat(F.lit("m"), m.cast("string")).alias("model"),
        _split_of(F.col("vec_id")).alias("split"),
        _attr_name(a).alias("attribute"),
        F.col("vec_id").alias("prompt_id"),
        (F.col("k") % 3).cast("int").alias("completion_idx"),
        F.when((F.col("vec_id") % 50 == 7) & (a == 2) & (m == 1), nan()).otherwise(r).alias("reward"),
    )


def annotation_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long annotator ratings (prompt_id, completion_idx, attribute, rating).

    One lineitem row is one annotator's five ratings of one response.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
               "l_discount", "l_tax", "l_partkey", "l_suppkey")
    ratings = F.array(
        F.struct(F.lit("coherence").alias("attribute"), (F.round(F.col("l_tax") * 100) % 5).alias("rating")),
        F.struct(F.lit("complexity").alias("attribute"), (F.col("l_partkey") % 5).cast("double").alias("rating")),
        F.struct(F.lit("correctness").alias("attribute"), (F.round(F.col("l_discount") * 100) % 5).alias("rating")),
        F.struct(F.lit("helpfulness").alias("attribute"), (F.col("l_quantity") % 5).cast("double").alias("rating")),
        F.struct(F.lit("verbosity").alias("attribute"), (F.col("l_suppkey") % 5).cast("double").alias("rating")),
    )
    return li.select(
        F.col("l_orderkey").alias("prompt_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("completion_idx"),
        F.inline(ratings),
    ).select("prompt_id", "completion_idx", "attribute", F.col("rating").cast("double").alias("rating"))


def annotations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotator's five ratings of one response per row:
    (prompt_id, completion_idx, coherence, complexity, correctness, helpfulness, verbosity)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
               "l_discount", "l_tax", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("prompt_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("completion_idx"),
        (F.round(F.col("l_tax") * 100) % 5).cast("double").alias("coherence"),
        (F.col("l_partkey") % 5).cast("double").alias("complexity"),
        (F.round(F.col("l_discount") * 100) % 5).cast("double").alias("correctness"),
        (F.col("l_quantity") % 5).cast("double").alias("helpfulness"),
        (F.col("l_suppkey") % 5).cast("double").alias("verbosity"),
    )


def rated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rated responses in long form: one row per annotator and response,
    carrying the prompt, the response text and the five ratings."""
    # texts ride through the pairing aggregation (string min/max is a sort-based
    # aggregate), so the scan gets every core
    li = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
                      "l_discount", "l_tax", "l_partkey", "l_suppkey"))
    key, side = F.col("l_orderkey"), (F.col("l_linenumber") % 2)
    return li.select(
        key.alias("prompt_id"),
        F.concat(F.lit("prompt "), key.cast("string")).alias("prompt"),
        side.cast("int").alias("completion_idx"),
        F.concat(F.lit("response "), key.cast("string"), F.lit("/"), side.cast("string")).alias("response"),
        (F.round(F.col("l_tax") * 100) % 5).cast("double").alias("coherence"),
        (F.col("l_partkey") % 5).cast("double").alias("complexity"),
        (F.round(F.col("l_discount") * 100) % 5).cast("double").alias("correctness"),
        (F.col("l_quantity") % 5).cast("double").alias("helpfulness"),
        (F.col("l_suppkey") % 5).cast("double").alias("verbosity"),
    )


def rated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rating table in source order: (position, prompt, response, a list of ratings
    for each attribute). Rows 2k and 2k + 1 share a prompt, but for every 17th pair."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    pair = F.expr("vec_id div 2")
    prompt = F.when((pair % 17 == 3) & (F.col("vec_id") % 2 == 1), F.lit("another prompt")).otherwise(
        F.concat(F.lit("prompt "), pair.cast("string")))
    ratings = [F.transform(F.slice("embedding", 3 * i + 1, 3), lambda x: F.floor(F.abs(x.cast("double")) * 8).cast("double") % 5).alias(a)
               for i, a in enumerate(ATTRIBUTES)]
    return emb.select(F.col("vec_id").alias("position"), prompt.alias("prompt"),
                      F.concat(F.lit("response "), F.col("vec_id").cast("string")).alias("response"), *ratings)


def rated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rated responses: (prompt_id, prompt, completion_idx, response)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("prompt_id"),
        F.concat(F.lit("prompt "), F.col("l_orderkey").cast("string")).alias("prompt"),
        (F.col("l_linenumber") % 2).cast("int").alias("completion_idx"),
        F.concat(F.lit("response "), F.col("l_orderkey").cast("string"), F.lit("/"),
                 (F.col("l_linenumber") % 2).cast("string")).alias("response"),
    ).dropDuplicates(["prompt_id", "completion_idx"])


def tldr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated summaries: one row per document, labels joined by doc_id.

    The tables hold no summaries; the two halves of a text by lines stand in for them."""
    lines = F.split("text", "\n", -1)
    half = F.ceil(F.size(lines) / 2).cast("int")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    d = docs.join(labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("worker"),
        # doc_id % 7 (not % 5): the worker is doc_id % 20, so % 5 would put
        # every worker in one split only
        F.when(F.col("doc_id") % 7 == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("site"),
        F.col("lang").alias("subreddit"),
        F.substring_index("text", "\n", 1).alias("title"),      # the first line is the title
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("post"),
        F.col("text").alias("article"),
        F.array_join(F.slice(lines, F.lit(1), half), "\n").alias("s0"),
        F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n").alias("s1"),
        F.coalesce(F.col("quality"), (F.col("doc_id") % 2).cast("int")).alias("choice"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, prompt, sys, comps array<struct<turn, text>>) per conversation.

    The prompt is all user turns in order, a line each. One keyed aggregation; a
    conversation's turns are one row of the view.
    """
    def turns(role):
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))

    asked = F.transform("asked", lambda x: x["text"])
    t = conversation_turns(spark, sf_dir)
    g = t.groupBy("conv_id").agg(
        turns("user").alias("asked"),
        F.min_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("sys"),
        turns("assistant").alias("comps"),
    )
    return g.select(F.col("conv_id").alias("prompt_id"), F.when(F.size("asked") > 0, F.array_join(asked, "\n")).alias("prompt"), "sys", "comps")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, prompt_id, sample_idx, model_logps, ref_logps, gen_logps, score, prob, has_eos)."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = F.expr("cast(4 + vec_id % 13 as int)")

    def seq(start):
        return F.transform(F.slice("embedding", start + 1, n), lambda x: F.abs(x.cast("double")) * -10.0)

    return emb.select(
        F.expr("vec_id div 64").alias("step"),
        F.expr("vec_id div 4").alias("prompt_id"),
        (F.col("vec_id") % 4).cast("int").alias("sample_idx"),
        seq(0).alias("model_logps"),
        seq(16).alias("ref_logps"),
        seq(32).alias("gen_logps"),
        (F.element_at("embedding", 49).cast("double") * 10.0).alias("score"),
        sigmoid(F.element_at("embedding", 50).cast("double") * 10.0).alias("prob"),
        (F.col("vec_id") % 7 != 0).alias("has_eos"),
    )


def judge_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, token, logprob, call_failed): top-token reply of a pairwise judge."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    toks = F.array(*[F.struct(F.lit(t).alias("token"),
                              (F.abs(F.element_at("embedding", i + 1).cast("double")) * -10.0).alias("logprob"))
                     for i, t in enumerate(["A", "B", "C"])])
    x = emb.select(F.col("vec_id").alias("pair_id"), F.inline(toks),
                   (F.col("vec_id") % 29 == 0).alias("call_failed"))
    return x.filter(~(((F.col("token") == "A") & (F.col("pair_id") % 17 == 0))
                      | ((F.col("token") == "B") & (F.col("pair_id") % 34 == 0))))


def instruction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    strict = F.col("l_returnflag") != "R"
    return li.select(
        F.col("l_orderkey").alias("prompt_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("completion_idx"),
        F.col("l_linenumber").alias("instruction_id"),
        strict.alias("followed_strict"),
        (strict | (F.col("l_linestatus") == "O")).alias("followed_loose"),
    )


def correction_rewards(spark: SparkSession, sf_dir: str, models=MODELS,
                       missing=(("m3", "m0"),)) -> DataFrame:
    """(leader, follower, attribute, prompt_id, completion_idx, reward).

    Completion 0 is the leader model's completion 0, completion 1 the follower
    model's completion 1. The grid comes from the explicit model list (an
    explode of a literal array per row, no cross join).
    """
    r = rewards_long(spark, sf_dir).filter(F.col("completion_idx") <= 1)
    other = F.explode(F.array(*[F.lit(m) for m in models]))
    lead = r.filter(F.col("completion_idx") == 0).select(
        F.col("model").alias("leader"), other.alias("follower"), "attribute", "prompt_id",
        "completion_idx", "reward")
    foll = r.filter(F.col("completion_idx") == 1).select(
        other.alias("leader"), F.col("model").alias("follower"), "attribute", "prompt_id",
        "completion_idx", "reward")
    out = lead.unionByName(foll)
    for ld, fl in missing:
        out = out.filter(~((F.col("leader") == ld) & (F.col("follower") == fl)))
    return out


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, ids array<int>, ctx int); EOS = 0, PAD = 9."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return emb.select(
        F.col("vec_id").alias("seq_id"),
        F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 100), F.lit(10)).cast("int"))
        .alias("ids"),
        F.lit(8).alias("ctx"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, logits array<double>, target int): 4 positions of 16 logits."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = emb.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    return x.select(
        F.col("vec_id").alias("seq_id"), "pos",
        F.transform(F.slice("embedding", F.col("pos") * 16 + 1, F.lit(16)),
                    lambda v: v.cast("double") * 10.0).alias("logits"),
        (F.col("vec_id") % 16).cast("int").alias("target"),
    )


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, attribute, prompt_id, chosen, rejected, margin, loss_weight, label)."""
    r = rewards_long(spark, sf_dir).filter(F.col("completion_idx") <= 1)
    g = r.groupBy("model", "split", "attribute", "prompt_id").agg(
        F.max(F.when(F.col("completion_idx") == 0, F.col("reward"))).alias("chosen"),
        F.max(F.when(F.col("completion_idx") == 1, F.col("reward"))).alias("rejected"),
    )
    return g.select(
        "model", "split", "attribute", "prompt_id", "chosen", "rejected",
        ((F.col("prompt_id") % 3).cast("double") * 0.1).alias("margin"),
        F.when(F.col("prompt_id") % 4 == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("loss_weight"),
        (F.col("prompt_id") % 2).cast("int").alias("label"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts timestamp, run, metric, value): the training log as an event table."""
    ev = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")
    return ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run"),
                     F.col("event_type").alias("metric"), F.col("value"))

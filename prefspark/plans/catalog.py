"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` runs one operator of
the inventory over the fixture views of the given scale factor (whole tables).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions import chat as ch
from prefspark.functions import seq as sq
from prefspark.functions.core import ATTRIBUTES as ATTRS
from prefspark.operators import evaluate as ev
from prefspark.operators import graph as gr
from prefspark.operators import ids as idx
from prefspark.operators import judge as jd
from prefspark.operators import labels as lb
from prefspark.operators import peel as pl
from prefspark.operators import reward_fit as rf
from prefspark.operators import rollout as ro
from prefspark.operators import rounds as rd
from prefspark.operators import shape as sh
from prefspark.operators import subword as sw
from prefspark.operators import text as tx
from prefspark.operators import udf as uf
from prefspark.session import ensure_checkpoint_dir, materialize
from prefspark.sources import eval_json as ej
from prefspark.sources import fixtures as fx
from prefspark.sources import io as sio
from prefspark.streaming import metrics as sm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The fixture's model list, baseline and player choices.
MODELS = fx.MODELS
BASELINE = "m0"
OTHERS = MODELS[1:]
PLAYERS = [(f"{m}#{c}", m, c) for m in MODELS for c in range(fx.COMPLETIONS)]
N_PLAYERS = len(MODELS) * fx.COMPLETIONS


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Columns rounded for the comparison with SQL; the operators themselves don't round."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _rl(spark, sf):
    return fx.rewards_long(spark, sf)


# ------------------------------------------------------------ E: reports
@query("reward_summary")
def q_reward_summary(spark, sf):
    return ev.reward_summary(_rl(spark, sf))


@query("reward_summary_pivot")
def q_reward_summary_pivot(spark, sf):
    return ev.reward_summary_pivot(ev.reward_summary(_rl(spark, sf)))


@query("sort_by_score")
def q_sort_by_score(spark, sf):
    wide = ev.reward_summary_pivot(ev.reward_summary(_rl(spark, sf)))
    return ev.sort_by_score(wide.select("model", "train_mean", "validation_mean"), "train_mean")


@query("round_robin_tournament")
def q_round_robin(spark, sf):
    return ev.round_robin_tournament(_rl(spark, sf), PLAYERS)


@query("baseline_join")
def q_baseline_join(spark, sf):
    return ev.baseline_join(_rl(spark, sf), BASELINE, OTHERS)


@query("winrate_vs_baseline")
def q_winrate_vs_baseline(spark, sf):
    return ev.winrate_vs_baseline(_rl(spark, sf), BASELINE, OTHERS)


@query("running_best")
def q_running_best(spark, sf):
    return ev.running_best(_rl(spark, sf))


@query("best_of_n_curve")
def q_best_of_n_curve(spark, sf):
    return ev.best_of_n_curve(_rl(spark, sf), fx.COMPLETIONS)


@query("best_of_n_winrate")
def q_best_of_n_winrate(spark, sf):
    return ev.best_of_n_winrate(_rl(spark, sf), BASELINE, OTHERS, fx.COMPLETIONS)


@query("correction_matrix")
def q_correction_matrix(spark, sf):
    return ev.correction_matrix(fx.correction_rewards(spark, sf), MODELS)


@query("pending_work")
def q_pending_work(spark, sf):
    return ev.pending_work(fx.correction_rewards(spark, sf), MODELS, MODELS)


@query("align_prompts")
def q_align_prompts(spark, sf):
    rl = _rl(spark, sf)
    return ev.align_prompts({m: rl.filter(F.col("model") == m) for m in MODELS})


@query("stack_players")
def q_stack_players(spark, sf):
    return ev.stack_players(_rl(spark, sf), MODELS, fx.COMPLETIONS)


@query("model_pair_theta_join")
def q_model_pair(spark, sf):
    return ev.model_pair_join(_rl(spark, sf), MODELS)


# ------------------------------------------------------------ graphs
def _players(spark, sf):
    return ev.stack_players(_rl(spark, sf), MODELS, fx.COMPLETIONS)


@query("player_cross")
def q_player_cross(spark, sf):
    return gr.player_cross(_players(spark, sf), N_PLAYERS)


@query("bt_probability_mean")
def q_bt_probability_mean(spark, sf):
    p = gr.bt_probability_mean(_players(spark, sf), N_PLAYERS)
    return p.withColumn("prob", F.transform("prob", lambda row: F.transform(row, lambda x: F.round(x, 6))))


@query("preference_graph")
def q_preference_graph(spark, sf):
    return gr.preference_graph(_players(spark, sf), N_PLAYERS)


@query("acyclic_check")
def q_acyclic(spark, sf):
    return gr.graph_report(_players(spark, sf), N_PLAYERS).select("split", "prompt_id", "acyclic")


@query("acyclic_check_edges")
def q_acyclic_edges(spark, sf):
    """H7 on edge tables: the same graphs, an edge a row."""
    graph = gr.preference_graph(_players(spark, sf), N_PLAYERS)
    return pl.acyclic_graphs(gr.edge_rows(graph, ["split", "prompt_id"]), ["split", "prompt_id"], graphs=graph)


@query("condorcet_winner")
def q_condorcet(spark, sf):
    return gr.graph_report(_players(spark, sf), N_PLAYERS).select("split", "prompt_id", "condorcet_idx")


@query("sink_nodes")
def q_sinks(spark, sf):
    return gr.graph_report(_players(spark, sf), N_PLAYERS).select("split", "prompt_id", "sinks")


@query("cycle_stats")
def q_cycle_stats(spark, sf):
    return gr.cycle_stats(gr.graph_report(_players(spark, sf), N_PLAYERS))


@query("condorcet_histogram")
def q_condorcet_histogram(spark, sf):
    return gr.condorcet_histogram(gr.graph_report(_players(spark, sf), N_PLAYERS))


# ------------------------------------------------------------ label chain

SEED = 42
LABEL_ATTRIBUTE = "helpfulness"
TRAIN_FRACTION = 0.8


def _pairs(spark, sf):
    return lb.pair_consecutive(fx.rated_responses(spark, sf))[0]


def _labels(spark, sf, compat=False):
    return lb.disagreement_labels_wide(fx.annotations_wide(spark, sf), SEED, compat)


@query("disagreement_labels_long")
def q_disagreement_labels_long(spark, sf):
    """E1 from long (one row per rating) annotations: per-side stats, then pairing."""
    return lb.disagreement_labels(lb.side_stats(fx.annotation_ratings(spark, sf)), SEED)


@query("pair_consecutive")
def q_pair_consecutive(spark, sf):
    return _pairs(spark, sf)


@query("pair_consecutive_errors")
def q_pair_consecutive_errors(spark, sf):
    """D1's error table: prompts that don't have exactly one response for each side."""
    return lb.pair_consecutive(fx.rated_responses(spark, sf))[1]


@query("pair_rows")
def q_pair_rows(spark, sf):
    """D1 by position on the raw table, its rows in source order, with rating lists."""
    return lb.pair_rows(fx.rated_rows(spark, sf), "position")[0]


@query("disagreement_labels_arrays")
def q_disagreement_labels_arrays(spark, sf):
    """D1 by position, then E1 on the rating lists."""
    responses, _ = lb.pair_rows(fx.rated_rows(spark, sf), "position")
    return lb.disagreement_labels(lb.side_stats_from_arrays(responses), SEED)


@query("disagreement_labels")
def q_disagreement_labels(spark, sf):
    return _labels(spark, sf)


@query("disagreement_labels_compat")
def q_disagreement_labels_compat(spark, sf):
    return _labels(spark, sf, compat=True)


@query("dense_ids")
def q_dense_ids(spark, sf):
    docs = fx.table(spark, sf, "documents", "doc_id")
    return idx.dense_ids(docs, "doc_id", "prompt_id")


@query("seeded_shuffle")
def q_seeded_shuffle(spark, sf):
    docs = fx.table(spark, sf, "documents", "doc_id")
    return idx.seeded_shuffle(docs, "doc_id", SEED)


@query("train_validation_split")
def q_train_validation_split(spark, sf):
    return idx.train_validation_split(_pairs(spark, sf).select("prompt_id"), "prompt_id", TRAIN_FRACTION, SEED)


@query("chosen_rejected")
def q_chosen_rejected(spark, sf):
    return lb.chosen_rejected(_pairs(spark, sf), _labels(spark, sf), LABEL_ATTRIBUTE)


@query("chat_structure")
def q_chat_structure(spark, sf):
    cr = lb.chosen_rejected(_pairs(spark, sf), _labels(spark, sf), LABEL_ATTRIBUTE)
    pm = ch.user_message(F.col("prompt"))
    return cr.select("prompt_id", pm.alias("prompt"), ch.with_assistant(pm, F.col("chosen")).alias("chosen"),
                     ch.with_assistant(pm, F.col("rejected")).alias("rejected"))


@query("source_rated_pairs")
def q_source_rated_pairs(spark, sf):
    """Preference-set build: pair + label (one aggregation) -> exact split -> chosen/rejected -> chat."""
    pairs, _ = lb.rated_pairs(fx.rated_annotations(spark, sf), SEED)
    # written once: the split's selection passes and the output read the
    # table instead of re-aggregating the raw annotation rows
    pairs = materialize(pairs, "rated_pairs")
    pairs = idx.train_validation_split(pairs, "prompt_id", TRAIN_FRACTION, SEED, persist_keys=False)
    cr = lb.pick_chosen(pairs, LABEL_ATTRIBUTE)
    pm = ch.user_message(F.col("prompt"))
    return cr.select("prompt_id", "split", ch.with_assistant(pm, F.col("chosen")).alias("chosen"),
                     ch.with_assistant(pm, F.col("rejected")).alias("rejected"))


# ------------------------------------------------------------ TL;DR text chain
MAX_PROMPT_TOKENS = 512
MAX_RESPONSE_TOKENS = 64
MIN_PER_WORKER = 43
TARGET_WORKER = "src3"
TARGET_WEIGHT = 2.0


def _tldr(spark, sf):
    return fx.tldr_raw(spark, sf)


@query("tldr_prompt")
def q_tldr_prompt(spark, sf):
    return _tldr(spark, sf).select("id", ch.tldr_prompt("site", "subreddit", "title", "post", "article")
                                   .alias("prompt"))


@query("truncate_lines")
def q_truncate_lines(spark, sf):
    return tx.tldr_prompts(_tldr(spark, sf), MAX_PROMPT_TOKENS).select("id", "prompt")


@query("token_count")
def q_token_count(spark, sf):
    return _tldr(spark, sf).select("id", ch.token_count(F.col("article")).alias("n_tokens"))


@query("filter_prompt_length")
def q_filter_prompt_length(spark, sf):
    keep, _ = tx.filter_prompt_length(_tldr(spark, sf), MAX_PROMPT_TOKENS, "article")
    return keep.select("id", "split")


@query("prompt_length_stats")
def q_prompt_length_stats(spark, sf):
    return tx.filter_prompt_length(_tldr(spark, sf), MAX_PROMPT_TOKENS, "article")[1]


@query("filter_pair_length")
def q_filter_pair_length(spark, sf):
    return tx.filter_pair_length(lb.choice_pairs(_tldr(spark, sf)), MAX_RESPONSE_TOKENS).select(
        "id", "chosen", "rejected")


@query("filter_message_length")
def q_filter_message_length(spark, sf):
    return tx.filter_message_length(fx.conversation_turns(spark, sf), 100, "text").select("conv_id", "turn")


@query("filter_empty_post")
def q_filter_empty_post(spark, sf):
    return tx.filter_empty_post(_tldr(spark, sf)).select("id")


@query("choice_pairs")
def q_choice_pairs(spark, sf):
    return lb.choice_pairs(_tldr(spark, sf)).select("id", "chosen", "rejected")


@query("worker_semi_join")
def q_worker_semi_join(spark, sf):
    return lb.worker_semi_join(_tldr(spark, sf), MIN_PER_WORKER).select("id", "split", "worker")


@query("worker_count_join")
def q_worker_count_join(spark, sf):
    return lb.worker_count_join(_tldr(spark, sf))


@query("worker_counts")
def q_worker_counts(spark, sf):
    return lb.worker_counts(_tldr(spark, sf))


@query("loss_weight")
def q_loss_weight(spark, sf):
    return lb.loss_weight(_tldr(spark, sf), TARGET_WORKER, TARGET_WEIGHT).select("id", "split", "loss_weight")


@query("source_annotated_summaries")
def q_source_annotated_summaries(spark, sf):
    # a single target worker (must pass the >= 1 train annotation test) gets the loss weight
    return tx.source_annotated_summaries(_tldr(spark, sf), 1, MAX_PROMPT_TOKENS, MAX_RESPONSE_TOKENS,
                                         SEED, TARGET_WORKER, TARGET_WEIGHT)


@query("head_n")
def q_head_n(spark, sf):
    return sh.head_n(_tldr(spark, sf).select("id", "split"), 50, "id")


# ------------------------------------------------------------ generations / chat shaping
SYSTEM_PROMPT = "You are a helpful assistant."
FOLLOWER_INSTRUCTION = "Improve the answer above."
JUDGE_TEMPLATE = ("Which response answers the prompt better?\n\nPrompt: {prompt}\n\n"
                  "Response A: {response0}\n\nResponse B: {response1}\n\nAnswer A or B.")


def _gen(spark, sf):
    return fx.generations(spark, sf)


@query("chat_prompt_with_system")
def q_chat_prompt_with_system(spark, sf):
    g = _gen(spark, sf)
    return g.select("prompt_id", ch.chat_prompt_with_system(F.col("prompt"), SYSTEM_PROMPT, FOLLOWER_INSTRUCTION,
                                                            ch.first_completion("comps")["text"]).alias("messages"))


@query("follower_prompt")
def q_follower_prompt(spark, sf):
    g = _gen(spark, sf).filter(F.size("comps") > 0)
    return g.select("prompt_id", ch.follower_prompt(ch.user_message(F.col("prompt")),
                                                    ch.first_completion("comps")["text"],
                                                    FOLLOWER_INSTRUCTION).alias("messages"))


@query("correction_rounds")
def q_correction_rounds(spark, sf):
    return tx.correction_rounds(_gen(spark, sf), FOLLOWER_INSTRUCTION)


def _digest_answer(p):
    """A deterministic generator: an answer that depends on all it was asked."""
    return F.concat(F.lit("answer "), F.md5(ch.render_chat(p)))


@query("correction_loop")
def q_correction_loop(spark, sf):
    """Three rounds a prompt by a generator, each a written table."""
    g = _gen(spark, sf).select("prompt_id", ch.user_message(F.col("prompt")).alias("prompt"))
    return rd.correction_loop(g, _digest_answer, FOLLOWER_INSTRUCTION, 3).select("prompt_id", "completions")


@query("correction_loop_given")
def q_correction_loop_given(spark, sf):
    """B4 on plain texts, where a leader's completion exists with that as round 0."""
    g = _gen(spark, sf).select("prompt_id", "prompt", ch.first_completion("comps")["text"].alias("leader_completion"))
    return rd.correction_loop(g, lambda p: F.concat(F.lit("answer "), F.md5(p)), FOLLOWER_INSTRUCTION, 3).select("prompt_id", "completions")


@query("render_chat")
def q_render_chat(spark, sf):
    g = _gen(spark, sf)
    msgs = ch.chat_prompt_with_system(F.col("prompt"), SYSTEM_PROMPT)
    return g.select("prompt_id", ch.render_chat(msgs).alias("text"))


@query("judge_prompt")
def q_judge_prompt(spark, sf):
    g = _gen(spark, sf).filter(F.size("comps") >= 2)
    return g.select("prompt_id", ch.judge_prompt(JUDGE_TEMPLATE, F.col("prompt"), F.col("comps")[0]["text"],
                                                 F.col("comps")[1]["text"], SYSTEM_PROMPT).alias("messages"))


@query("first_completion")
def q_first_completion(spark, sf):
    return _gen(spark, sf).select("prompt_id", ch.first_completion("comps")["text"].alias("leader_completion"))


@query("message_content")
def q_message_content(spark, sf):
    g = _gen(spark, sf)
    msgs = F.when(F.col("sys").isNotNull(), F.array(ch.msg("system", F.col("sys")), ch.msg("user", F.col("prompt")))
                  ).otherwise(ch.user_message(F.col("prompt")))
    return g.select("prompt_id", ch.message_content(msgs).alias("content"))


@query("flatten_completions")
def q_flatten_completions(spark, sf):
    return sh.flatten_completions(_gen(spark, sf))


@query("unflatten_rewards")
def q_unflatten_rewards(spark, sf):
    return sh.unflatten_rewards(_rl(spark, sf), "reward", ("model", "split", "attribute", "prompt_id"))


@query("group_return_sequences")
def q_group_return_sequences(spark, sf):
    flat = fx.table(spark, sf, "embeddings", "vec_id", "label").select(
        F.col("vec_id").alias("seq_idx"), F.col("label").cast("string").alias("text"))
    return sh.group_return_sequences(flat, 4, whole_only=False)     # as the SQL: ids may have gaps


@query("repeat_rows")
def q_repeat_rows(spark, sf):
    return sh.repeat_rows(fx.rollouts(spark, sf).select("step", "prompt_id", "sample_idx", "score"), 2)


@query("last_wins_dedup")
def q_last_wins_dedup(spark, sf):
    docs = fx.table(spark, sf, "documents", "doc_id", "source", "n_chars")
    return sh.last_wins_dedup(docs, "source", "n_chars", "doc_id")


@query("follower_reference_sequence")
def q_follower_reference_sequence(spark, sf):
    t = fx.token_ids(spark, sf).withColumnRenamed("seq_id", "pair_id")
    follower = t.select("pair_id", F.reverse("ids").alias("ids"), (F.col("ctx") + 2).alias("ctx"))
    return sh.follower_reference_sequence(t, follower)


@query("export_eval_json")
def q_export_eval_json(spark, sf):
    return sh.export_eval_rows(_gen(spark, sf).select("prompt_id", "prompt", "comps"), "prefspark")


@query("export_eval_json_files")
def q_export_eval_json_files(spark, sf):
    """A5 with its sink: one JSON array file a completion index, read back."""
    path = _scratch(spark, "eval-arrays")
    ej.write_eval_arrays(sh.export_eval_rows(_gen(spark, sf).select("prompt_id", "prompt", "comps"), "prefspark"), path)
    got = ej.read_eval_arrays(spark, path, "instruction string, output string, generator string, dataset string, datasplit string")
    return got.withColumn("completion_idx", F.regexp_extract("file", r"_completion_(\d+)\.json$", 1).cast("int")).drop("file")


# ------------------------------------------------------------ token arrays / rollouts

EOS, PAD = 0, 9
BETA = 0.05
KL_KIND = "k3"
EOS_PENALTY = 1.0
KL_COEF = 0.05
CLIP = 0.2
CENTER_COEF = 0.01
TIS = 2.0
REWARD_CLIP = 3.0
LEADER_FREQ = 3
FOLLOWER_WEIGHT = 0.5
ROLL_KEYS = ["step", "prompt_id", "sample_idx"]


def _roll(spark, sf):
    return fx.rollouts(spark, sf)


def _R(c):
    return F.round(c, 6)


@query("truncate_at_stop")
def q_truncate_at_stop(spark, sf):
    t = fx.token_ids(spark, sf)
    tr = sq.truncate_at_stop(sq.completion("ids", "ctx"), EOS)
    return t.select("seq_id", tr.alias("completion"), F.size(tr).alias("length"))


@query("contains_eos")
def q_contains_eos(spark, sf):
    return fx.token_ids(spark, sf).select("seq_id", sq.contains_eos("ids", "ctx", EOS).alias("has_eos"))


@query("sequence_length")
def q_sequence_length(spark, sf):
    return fx.token_ids(spark, sf).select(
        "seq_id", sq.sequence_length(sq.completion("ids", "ctx"), PAD).alias("seq_len"),
        sq.sequence_length_last_non_pad("ids", "ctx", PAD).alias("seq_len_last_non_pad"))


@query("selected_log_softmax")
def q_selected_log_softmax(spark, sf):
    return fx.logits(spark, sf).select("seq_id", "pos", _R(sq.selected_log_softmax("logits", "target")).alias("logp"))


@query("softmax_entropy")
def q_softmax_entropy(spark, sf):
    return fx.logits(spark, sf).select("seq_id", "pos", _R(sq.softmax_entropy("logits")).alias("entropy"))


@query("masked_logprob_sum")
def q_masked_logprob_sum(spark, sf):
    return ro.logprob_stats(_roll(spark, sf)).select(*ROLL_KEYS, "logp_sum", "entropy")


@query("kl_estimate")
def q_kl_estimate(spark, sf):
    r = _roll(spark, sf)
    return r.select(*ROLL_KEYS, *[_R(sq.kl_estimate("model_logps", "ref_logps", k)).alias(f"kl_{k}")
                                  for k in ("k1", "k2", "k3")])


@query("policy_loss")
def q_policy_loss(spark, sf):
    x = ro.policy_loss(_roll(spark, sf), BETA, KL_KIND, 0.5, True, TIS)
    return x.select(*ROLL_KEYS, _R(F.col("seq_loss")).alias("seq_loss"), _R(F.col("score")).alias("score"),
                    _R(F.col("kl")).alias("kl"))


@query("eos_probability_penalty")
def q_eos_probability_penalty(spark, sf):
    r = _roll(spark, sf)
    return r.select(*ROLL_KEYS, _R(ro.eos_probability_penalty("prob", "has_eos", EOS_PENALTY)).alias("p_leader"),
                    _R(ro.eos_probability_penalty("prob", "has_eos", EOS_PENALTY, True)).alias("p_follower"))


@query("missing_eos_penalty")
def q_missing_eos_penalty(spark, sf):
    return _roll(spark, sf).select(*ROLL_KEYS, ro.missing_eos_penalty("score", "has_eos", EOS_PENALTY)
                                   .alias("score_pen"))


@query("kl_penalized_reward")
def q_kl_penalized_reward(spark, sf):
    r = _roll(spark, sf).withColumn("score_pen", ro.missing_eos_penalty("score", "has_eos", EOS_PENALTY))
    x = ro.kl_penalized_reward(r, KL_COEF, "score_pen")
    return x.select(*ROLL_KEYS, *[_R(F.col(c)).alias(c) for c in ("seq_kl", "non_score_reward", "rlhf_reward")])


@query("rloo_advantage")
def q_rloo_advantage(spark, sf):
    return ro.rloo_advantage(_roll(spark, sf), "score").select(*ROLL_KEYS, _R(F.col("advantage")).alias("advantage"))


@query("batch_rloo_baseline")
def q_batch_rloo_baseline(spark, sf):
    return ro.batch_rloo_baseline(_roll(spark, sf), "prob", 0.5).select(*ROLL_KEYS, _R(F.col("p_adj")).alias("p_adj"))


@query("normalize_reward")
def q_normalize_reward(spark, sf):
    return ro.normalize(_roll(spark, sf), "score", "score_norm", REWARD_CLIP).select(
        *ROLL_KEYS, _R(F.col("score_norm")).alias("score_norm"))


@query("normalize_advantage")
def q_normalize_advantage(spark, sf):
    x = ro.normalized_rloo_advantage(_roll(spark, sf), "score")
    return x.select(*ROLL_KEYS, _R(F.col("adv_norm")).alias("adv_norm"))


def _step_losses(spark, sf):
    x = ro.policy_loss(_roll(spark, sf), BETA, KL_KIND, 0.5, True, None)
    # even samples are the leader's sequences, odd ones the follower's
    lead = F.col("sample_idx") % 2 == 0
    return x.groupBy("step").agg(F.avg(F.when(lead, F.col("seq_loss"))).alias("loss_leader"),
                                 F.avg(F.when(~lead, F.col("seq_loss"))).alias("loss_follower"))


@query("alternating_update")
def q_alternating_update(spark, sf):
    x = ro.alternating_update(_step_losses(spark, sf), LEADER_FREQ, FOLLOWER_WEIGHT)
    return x.select("step", *[_R(F.col(c)).alias(c) for c in ("loss_leader", "loss_follower", "total_loss")])


@query("alternating_update_separate")
def q_alternating_update_separate(spark, sf):
    x = ro.alternating_update(_step_losses(spark, sf), LEADER_FREQ, FOLLOWER_WEIGHT, separate_models=True)
    return x.select("step", *[_R(F.col(c)).alias(c) for c in ("loss_leader", "loss_follower", "total_loss")])


@query("clipped_policy_loss")
def q_clipped_policy_loss(spark, sf):
    x = ro.clipped_policy_loss(ro.rloo_advantage(_roll(spark, sf), "score"), "advantage", CLIP)
    return x.select(*ROLL_KEYS, *[_R(F.col(c)).alias(c) for c in ("ratio", "pg_loss", "approxkl")], "clipped")


@query("rollout_metrics")
def q_rollout_metrics(spark, sf):
    r = _roll(spark, sf)
    # even samples are leader sequences, odd ones the follower's answer to the same pair
    r = r.withColumn("pair", (F.col("sample_idx") / 2).cast("int"))
    m = ro.rollout_metrics(r, F.col("sample_idx") % 2 == 1, BETA, EOS_PENALTY, KL_KIND)
    return rounded(m, *[c for c in m.columns if c != "step"])


@query("policy_metrics")
def q_policy_metrics(spark, sf):
    m = ro.policy_metrics(_roll(spark, sf), KL_COEF, EOS_PENALTY, CLIP)
    return rounded(m, *[c for c in m.columns if c not in ("step", "num_eos")])


def _pairs_sc(spark, sf):
    return fx.scored_pairs(spark, sf)


@query("bradley_terry_loss")
def q_bradley_terry_loss(spark, sf):
    return rounded(ro.bradley_terry_loss(_pairs_sc(spark, sf), CENTER_COEF), "bt_loss")


@query("weighted_bce_loss")
def q_weighted_bce_loss(spark, sf):
    return rounded(ro.weighted_bce_loss(_pairs_sc(spark, sf)), "bce_loss")


@query("preference_accuracy")
def q_preference_accuracy(spark, sf):
    return rounded(ro.preference_accuracy(_pairs_sc(spark, sf)), "mean_p_chosen")


# ------------------------------------------------------------ judging
JUDGE_KEYS = ["model", "split", "prompt_id"]


def _judge_scores(spark, sf):
    r = _rl(spark, sf).filter(F.col("completion_idx") <= 1)
    return r.select(*JUDGE_KEYS, "attribute", "completion_idx", F.col("reward").alias("score"),
                    ((F.col("prompt_id") + F.col("completion_idx")) % 7 != 0).alias("has_eos"))


@query("multi_attribute_vote")
def q_multi_attribute_vote(spark, sf):
    return jd.multi_attribute_vote(_judge_scores(spark, sf), JUDGE_KEYS, EOS_PENALTY)


@query("sampled_attribute_vote")
def q_sampled_attribute_vote(spark, sf):
    return jd.sampled_attribute_vote(_judge_scores(spark, sf), JUDGE_KEYS, SEED, penalty=EOS_PENALTY)


@query("judge_probability")
def q_judge_probability(spark, sf):
    return rounded(jd.judge_probability(fx.judge_logprobs(spark, sf)), "p")


@query("position_debias")
def q_position_debias(spark, sf):
    judged = rounded(jd.judge_probability(fx.judge_logprobs(spark, sf)), "p")
    return jd.position_unflip(jd.position_flip(judged, SEED)).select("pair_id", "flip", "p")


SCHED_KEYS = ["model", "completion_idx"]


def _sched_input(spark, sf):
    return _rl(spark, sf).select(F.col("prompt_id").alias("step"), "model", "completion_idx", "attribute", "reward")


@query("attribute_schedule")
def q_attribute_schedule(spark, sf):
    return jd.attribute_schedule(_sched_input(spark, sf), "step", "round_robin", keys=SCHED_KEYS)


@query("attribute_schedule_random")
def q_attribute_schedule_random(spark, sf):
    return jd.attribute_schedule(_sched_input(spark, sf), "step", "random", SEED, keys=SCHED_KEYS)


@query("attribute_schedule_average")
def q_attribute_schedule_average(spark, sf):
    return jd.attribute_schedule(_sched_input(spark, sf), "step", "average", keys=SCHED_KEYS)


# ------------------------------------------------------------ sources / sinks


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex[:12]}"


@query("read_table")
def q_read_table(spark, sf):
    return sio.read_table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")


@query("write_splits")
def q_write_splits(spark, sf):
    path = _scratch(spark, "splits")
    sio.write_splits(_tldr(spark, sf).select("id", "worker", "split"), path)
    return sio.read_splits(spark, path).select("id", "worker", "split")


@query("read_splits")
def q_read_splits(spark, sf):
    path = _scratch(spark, "splits")
    sio.write_splits(_tldr(spark, sf).select("id", "worker", "split"), path)
    return sio.read_splits(spark, path, ["validation"]).select("id", "worker", "split")


@query("read_jsonl")
def q_read_jsonl(spark, sf):
    """Records written as JSON lines, then read with a declared schema."""
    path = _scratch(spark, "jsonl")
    log = fx.table(spark, sf, "events", "event_id", "props")
    sio.parse_json_records(log, "props", "k long").select("event_id", "k").write.json(path)
    return sio.read_jsonl(spark, path, "event_id long, k long")


@query("expand_attribute_paths")
def q_expand_attribute_paths(spark, sf):
    """One reward table for each attribute, written first, read back through the template."""
    path, rl = _scratch(spark, "attributes"), _rl(spark, sf)
    for a in ATTRS:
        rl.where(F.col("attribute") == a).drop("attribute").write.parquet(f"{path}/{a}.parquet")
    tagged = sio.read_attribute_tables(spark, f"{path}/({'|'.join(ATTRS)}).parquet")
    return tagged.groupBy("attribute", "model").agg(F.count(F.lit(1)).alias("n_rows"), F.max("reward").alias("best"))


@query("split_row_counts")
def q_split_row_counts(spark, sf):
    raw = _tldr(spark, sf)
    return sio.split_row_counts(raw, "raw").unionByName(
        sio.split_row_counts(lb.worker_semi_join(raw, MIN_PER_WORKER), "worker_filter"))


def _bench_items(spark, sf):
    return fx.table(spark, sf, "benchmark", "item_id", "text")


def _mixture(spark, sf):
    return lb.choice_pairs(_tldr(spark, sf)).select("id", F.col("article").alias("prompt"), "chosen", "rejected")


@query("source_preference_mixture")
def q_source_preference_mixture(spark, sf):
    return sio.normalize_source("preference_mixture", _mixture(spark, sf), prompts_only=True)


@query("source_preference_mixture_pairs")
def q_source_preference_mixture_pairs(spark, sf):
    return sio.normalize_source("preference_mixture", _mixture(spark, sf))


@query("source_instruction_eval")
def q_source_instruction_eval(spark, sf):
    return sio.normalize_source("instruction_eval", _bench_items(spark, sf).withColumnRenamed("text", "instruction"))


@query("source_constraint_eval")
def q_source_constraint_eval(spark, sf):
    return sio.normalize_source("constraint_eval", _bench_items(spark, sf).withColumnRenamed("text", "prompt"),
                                prompts_only=True)


def _eval_items(spark, sf):
    """Evaluation items as their source has them: with the fields that the adapter drops and others."""
    text = F.col("text")
    return _bench_items(spark, sf).select("item_id", text.alias("instruction"), F.upper(text).alias("output"), F.lit("m0").alias("generator"),
                                          F.length(text).alias("n_chars"))


@query("source_instruction_eval_columns")
def q_source_instruction_eval_columns(spark, sf):
    """A6d: output and generator go, other columns stay."""
    return sio.normalize_source("instruction_eval", _eval_items(spark, sf))


@query("source_constraint_eval_columns")
def q_source_constraint_eval_columns(spark, sf):
    """A6e with all columns."""
    return sio.normalize_source("constraint_eval", _eval_items(spark, sf).select("item_id", F.col("instruction").alias("prompt"), "n_chars"))


@query("normalize_source")
def q_normalize_source(spark, sf):
    """All four prompt-only sources in one common schema (source, prompt_id, prompt, split)."""
    items = _bench_items(spark, sf)
    pairs = idx.train_validation_split(_pairs(spark, sf), "prompt_id", TRAIN_FRACTION, SEED)
    return sio.prompt_sources({"Instruction_Eval": items.withColumnRenamed("text", "instruction"), "rated_pairs": pairs,
                               "preference_mixture": _mixture(spark, sf), "constraint_eval": items.withColumnRenamed("text", "prompt")})


@query("random_permutation_batches")
def q_random_permutation_batches(spark, sf):
    r = _roll(spark, sf).select("step", "prompt_id", "sample_idx",
                                (F.col("prompt_id") * 4 + F.col("sample_idx")).alias("row_key"))
    return ro.random_permutation_batches(r, SEED, 2, 16, 4, key="row_key").select(
        "step", "row_key", "sample_idx", "epoch", "perm_rank", "mini_batch", "micro_batch")


@query("permuted_batches")
def q_permuted_batches(spark, sf):
    """C9 by a keyed permutation of positions: no sort and no window over the rows."""
    r = _roll(spark, sf).select("step", "sample_idx", (F.col("prompt_id") * 4 + F.col("sample_idx") - F.col("step") * 64).alias("position"))
    return ro.permuted_batches(r, SEED, 2, 16, 4, "position")


@query("instruction_accuracy")
def q_instruction_accuracy(spark, sf):
    return ev.instruction_accuracy(fx.instruction_results(spark, sf))


@query("score_with")
def q_score_with(spark, sf):
    return uf.score_native(sh.flatten_completions(_gen(spark, sf)))


def _length_scorers():
    """Example pandas scorers: token count (same token rule as the native
    columns) and completion/prompt character ratio."""
    tok = ch.TOKEN_RE
    return {"length": lambda p, c: c.fillna("").str.count(tok).astype("float64"),
            "prompt_ratio": lambda p, c: c.fillna("").str.len() / (1.0 + p.fillna("").str.len())}


@query("score_with_udf")
def q_score_with_udf(spark, sf):
    return uf.score_with(sh.flatten_completions(_gen(spark, sf)), _length_scorers, ["length", "prompt_ratio"])


@query("judge_with")
def q_judge_with(spark, sf):
    g = _gen(spark, sf).filter(F.size("comps") >= 2).select(
        F.col("prompt_id").alias("pair_id"), "prompt", F.col("comps")[0]["text"].alias("response0"),
        F.col("comps")[1]["text"].alias("response1"))
    return uf.judge_with(g, uf.length_judge, SEED).select("pair_id", "flip", "p")


def _unsure_judge():
    """Example of a judge that fails: it doesn't answer where both responses begin alike, and shares by length."""
    def j(prompt: str, a: str, b: str) -> float:
        if (a or "")[:1] == (b or "")[:1]:
            raise TimeoutError("no answer")
        return (len(a or "") + 1.0) / (len(a or "") + len(b or "") + 2.0)
    return j


def _judged(spark, sf):
    g = _gen(spark, sf).filter(F.size("comps") >= 2).select(
        F.col("prompt_id").alias("pair_id"), "prompt", F.col("comps")[0]["text"].alias("response0"), F.col("comps")[1]["text"].alias("response1"))
    return uf.judge_each_with(g, _unsure_judge, SEED, attempts=2)


@query("judge_with_failures")
def q_judge_with_failures(spark, sf):
    return rounded(_judged(spark, sf), "p").select("pair_id", "flip", "p", "failed", "calls")


@query("judge_failures")
def q_judge_failures(spark, sf):
    return uf.judge_failures(_judged(spark, sf), ["flip"])


@query("tokenize_subword")
def q_tokenize_subword(spark, sf):
    """U3 with two public tokenizers: token numbers and ids of every document."""
    docs = fx.table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", sw.library_ids("text", public_tokenizers.path("word_bpe_49k.json")).alias("word_ids"),
                       sw.library_ids("text", public_tokenizers.path("byte_bpe_50k.json")).alias("byte_ids"))


@query("truncate_lines_subword")
def q_truncate_lines_subword(spark, sf):
    """B7 and B8 by a subword tokenizer, whose counts don't add up by line."""
    raw = _tldr(spark, sf).select("id", ch.tldr_prompt("site", "subreddit", "title", "post", "article").alias("prompt"))
    return sw.truncate_lines_library(raw, "prompt", MAX_PROMPT_TOKENS, public_tokenizers.path("word_bpe_49k.json"))


@query("tokenize_with")
def q_tokenize_with(spark, sf):
    return uf.tokenize_with(fx.table(spark, sf, "documents", "doc_id", "text"), "text", uf.hashing_tokenizer
                            ).select("doc_id", F.size("input_ids").alias("n_ids"), "input_ids")


REWARD_FEATURES = [c for c in ATTRS if c != LABEL_ATTRIBUTE]


def _by_label(label, attributes):
    """chosen_<f>, rejected_<f> of a pair: side 0 is chosen where the label is 1."""
    first = F.col(label) == 1
    return [F.when(first, F.col(f"s{s}_{a}")).otherwise(F.col(f"s{1 - s}_{a}")).alias(f"{side}_{a}")
            for s, side in enumerate(("chosen", "rejected")) for a in attributes]


def _rated_features(spark, sf):
    """chosen_<f>, rejected_<f> annotation means of each pair, by the helpfulness label."""
    means, label = lb.side_means_and_labels(fx.annotations_wide(spark, sf), SEED), f"label_{LABEL_ATTRIBUTE}"
    return means.where(F.col(label).isNotNull()).select("prompt_id", *_by_label(label, REWARD_FEATURES))


REWARD_REG = 0.1


def _rated_features_by_attribute(spark, sf):
    """(attribute, prompt_id, chosen_<f>, rejected_<f>): annotation means of each pair, chosen by the attribute's own label."""
    means = lb.side_means_and_labels(fx.annotations_wide(spark, sf), SEED)
    own = [F.when(F.col(f"label_{a}").isNotNull(), F.struct(F.lit(a).alias("attribute"), *_by_label(f"label_{a}", ATTRS))) for a in ATTRS]
    x = means.select("prompt_id", F.inline(F.array_compact(F.array(*own))))
    return x.select("attribute", "prompt_id", *[c for c in x.columns if c not in ("attribute", "prompt_id")])


@query("fit_reward_models")
def q_fit_reward_models(spark, sf):
    """U4: a Bradley-Terry model for each attribute, fitted to the end."""
    fitted = rf.fit_reward_models(_rated_features_by_attribute(spark, sf), ATTRS, reg=REWARD_REG)
    return rounded(rf.weights_table(spark, fitted, ATTRS), "weight", "loss")


@query("reward_newton_steps")
def q_reward_newton_steps(spark, sf):
    """U4: four Newton steps of the same fit on two features."""
    return rounded(rf.newton_steps(_rated_features_by_attribute(spark, sf), ["coherence", "verbosity"], 4, reg=REWARD_REG), "weight")


@query("fit_reward_model")
def q_fit_reward_model(spark, sf):
    """Coefficients of the linear BT reward model on annotation means."""
    pairs = _rated_features(spark, sf)
    return uf.fit_reward_model(pairs.drop("prompt_id").dropna(), REWARD_FEATURES, max_iter=50)[1]


@query("reward_model_scores")
def q_reward_model_scores(spark, sf):
    """Every pair's scores under the fitted model (null where a side lacks a feature)."""
    pairs = materialize(_rated_features(spark, sf), "reward-pairs")
    _, coefs = uf.fit_reward_model(pairs.drop("prompt_id").dropna(), REWARD_FEATURES, max_iter=50)
    w = {r.feature: r.weight for r in coefs.collect()}      # a row for each feature
    return pairs.select("prompt_id", *[uf.reward_scores(pairs, w, f"{side}_").alias(f"{side}_score") for side in ("chosen", "rejected")])


#: A sum of doubles depends on the order of its terms in the last digits.
ROLLED = ("sum_value", "mean_value")


@query("metric_rollup")
def q_metric_rollup(spark, sf):
    return rounded(sm.metric_rollup(fx.table(spark, sf, "events", "ts", "user_id", "event_type", "value")), *ROLLED)


@query("metric_rollup_sliding")
def q_metric_rollup_sliding(spark, sf):
    log = fx.table(spark, sf, "events", "ts", "user_id", "event_type", "value")
    return rounded(sm.metric_rollup(log, "2 days", "1 day"), *ROLLED)


@query("metric_rollup_stream")
def q_metric_rollup_stream(spark, sf):
    return rounded(sm.metric_rollup_stream(spark, f"{sf.rstrip('/')}/events*.parquet"), *ROLLED)


@query("metric_rollup_append")
def q_metric_rollup_append(spark, sf):
    """Windows closed by the watermark once the whole log has been read."""
    out = sm.metric_rollup_stream(spark, f"{sf.rstrip('/')}/events*.parquet", watermark="1 day", output_mode="append")
    return rounded(out, *ROLLED)


@query("select_rename")
def q_select_rename(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return sh.select_rename(docs, {"doc_id": "prompt_id", "text": "prompt"}, drop=["n_chars", "lang"])

"""Text filters and prompt shaping over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions import chat as ch
from prefspark.operators import labels as lb
from prefspark.operators.ids import seeded_shuffle
from prefspark.session import materialize


def filter_prompt_length(df: DataFrame, max_tokens: int, col: str = "prompt",
                         counter: ch.Counter | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep prompts with <= max_tokens tokens; stats = one aggregation
    (kept, removed, removed percent) computed from the same scan. A null prompt
    has no tokens and is kept."""
    n = F.coalesce(ch.token_count(F.col(col), counter), F.lit(0))
    keep = df.filter(n <= max_tokens)
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sum((n > max_tokens).cast("long")).alias("n_removed")).select(
        "n_rows", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        (F.coalesce("n_removed", F.lit(0)) * 100.0 / F.col("n_rows")).alias("removed_pct"))
    return keep, stats


def filter_pair_length(df: DataFrame, max_tokens: int, a: str = "chosen", b: str = "rejected",
                       counter: ch.Counter | None = None) -> DataFrame:
    """Keep a pair only when BOTH texts have <= max_tokens tokens. A null text has
    no tokens, as in C1."""
    fits = lambda c: F.coalesce(ch.token_count(F.col(c), counter), F.lit(0)) <= max_tokens
    return df.filter(fits(a) & fits(b))


def filter_message_length(df: DataFrame, max_tokens: int, col: str = "messages",
                          counter: ch.Counter | None = None) -> DataFrame:
    """Single-sequence form of C2; a null text has no tokens."""
    return df.filter(F.coalesce(ch.token_count(F.col(col), counter), F.lit(0)) <= max_tokens)


def filter_empty_post(df: DataFrame, compat: bool = False, prompt: str = "prompt", post: str = "post") -> DataFrame:
    """C4: drop rows whose post is empty. ``compat=True`` applies the literal
    suffix test on the rendered prompt (which never matches a built prompt)."""
    if compat:
        return df.filter(~F.col(prompt).endswith(ch.EMPTY_POST_SUFFIX))
    return df.filter(F.col(post).isNull() | (F.length(F.trim(F.col(post))) > 0) | F.col("site").isNotNull())


def tldr_prompts(raw: DataFrame, max_prompt_tokens: int, line_counter: ch.Counter | None = None) -> DataFrame:
    """B7 + B8: rendered, line-truncated TL;DR prompt per row (column ``prompt``).

    ``line_counter`` is a tokenizer hook over the array of lines (array<string> ->
    array<int>), such as a pandas UDF around a subword tokenizer."""
    p = ch.tldr_prompt("site", "subreddit", "title", "post", "article")
    counts = line_counter(F.split(p, "\n", -1)) if line_counter else None
    return raw.withColumn("prompt", ch.truncate_lines(p, max_prompt_tokens, counts=counts))


def source_annotated_summaries(raw: DataFrame, min_annotation_per_worker: int, max_prompt_tokens: int,
                               max_response_tokens: int, seed: int = 42, worker_id: str | None = None,
                               target_weight: float = 1.0, compat_empty_post: bool = False) -> DataFrame:
    """Worker filter (D4) -> prompt (B7, B8) -> empty-post filter (C4) ->
    pairs by choice (D3) -> pair length filter (C2) -> chat structure (B1) ->
    seeded shuffle rank (C6) -> loss weight on train (B14).

    The filtered rows are written once; their ids are ranked without the texts,
    and the messages are built after the ranks have been joined."""
    x = lb.worker_semi_join(raw, min_annotation_per_worker, worker_id)
    x = tldr_prompts(x, max_prompt_tokens)
    x = filter_empty_post(x, compat=compat_empty_post)
    x = lb.choice_pairs(x)
    x = filter_pair_length(x, max_response_tokens)
    x = materialize(x.select(F.col("id").alias("prompt_id"), "split", "worker", "prompt", "chosen", "rejected"), "annotated-summaries")
    x = seeded_shuffle(x, "prompt_id", seed)
    pm = ch.user_message(F.col("prompt"))
    x = x.withColumns({"prompt": pm, "chosen": ch.with_assistant(pm, F.col("chosen")), "rejected": ch.with_assistant(pm, F.col("rejected"))})
    if worker_id is not None:
        x = lb.loss_weight(x, worker_id, target_weight)
    return x


def correction_rounds(prompts: DataFrame, instruction: str) -> DataFrame:
    """Round r's prompt = original prompt + round r-1's completion + the
    instruction (history is not accumulated); round 0 is the original prompt.

    Input ``(prompt_id, prompt string, comps array<struct<turn, text>>)`` with
    the completions of successive rounds; output long (prompt_id, round, prompt
    messages). Each round reads only its predecessor: a posexplode, no join.
    """
    base = ch.user_message(F.col("prompt"))
    r0 = prompts.select("prompt_id", F.lit(0).alias("round"), base.alias("messages"))
    rn = prompts.select("prompt_id", "prompt", F.posexplode("comps").alias("pos", "c")).select(
        "prompt_id", (F.col("pos") + 1).alias("round"),
        ch.follower_prompt(ch.user_message(F.col("prompt")), F.col("c.text"), instruction).alias("messages"))
    return r0.unionByName(rn)

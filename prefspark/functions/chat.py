"""Column expressions for chat messages and prompt text (all JVM-side).

A chat is ``array<struct<role string, content string>>``.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The TL;DR prompt layout and suffix, and the empty-post pattern.
TLDR_SITE = ("SITE: ", "\n\nARTICLE: ")
TLDR_REDDIT = ("SUBREDDIT: r/", "\n\nTITLE: ", "\n\nPOST: ")
TLDR_SUFFIX = "\n\nTL;DR:"
EMPTY_POST_SUFFIX = "\n\nPOST:\n\nTL;DR:"

# Token = maximal run of non-whitespace characters (same class in Java and RE2).
TOKEN_RE = "[^ \\t\\n\\r\\f\\x0B]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def msg(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).alias("content"))


def user_message(content) -> Column:
    """B1: a prompt string as one user message."""
    return F.array(msg("user", content))


def assistant_message(content) -> Column:
    """B1: a completion string as one assistant message."""
    return F.array(msg("assistant", content))


def with_assistant(prompt_msgs, content) -> Column:
    """B1: prompt messages followed by one assistant message."""
    return F.concat(_c(prompt_msgs), F.array(msg("assistant", content)))


def chat_prompt_with_system(prompt, system: str | None = None, follower_instruction: str | None = None,
                            completion=None) -> Column:
    """B2: [system?] + user prompt [+ assistant completion + user follow-up]."""
    parts = []
    if system:
        parts.append(F.array(msg("system", F.lit(system))))
    parts.append(F.array(msg("user", prompt)))
    if follower_instruction:
        parts.append(F.array(msg("assistant", completion), msg("user", F.lit(follower_instruction))))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def follower_prompt(prompt_msgs, completion, instruction: str) -> Column:
    """Prompt ++ [assistant: completion] ++ [user: instruction]."""
    return F.concat(_c(prompt_msgs), F.array(msg("assistant", completion), msg("user", F.lit(instruction))))


def follower_prompt_text(prompt, completion, instruction: str) -> Column:
    """B3 for plain-string prompts: string concatenation."""
    return F.concat(_c(prompt), _c(completion), F.lit(instruction))


def render_chat(messages, template: str = "<|{role}|>\n{content}\n") -> Column:
    """Messages -> one text; ``template`` has {role} and {content} fields. A null
    role or content is rendered as an empty one, so no message is lost."""
    return F.array_join(F.transform(_c(messages), lambda m: format_fields(template, {
        "role": F.coalesce(m["role"], F.lit("")), "content": F.coalesce(m["content"], F.lit(""))})), "")


def scoring_text(prompt_msgs, completion_msgs, template: str = "<|{role}|>\n{content}\n") -> Column:
    """The text a scorer sees: rendered prompt followed by the rendered completion."""
    return F.concat(render_chat(prompt_msgs, template), render_chat(completion_msgs, template))


def format_fields(template: str, fields: dict) -> Column:
    """``str.format`` semantics with columns: the template (a user parameter) is
    split into literal text and named fields once, then concatenated."""
    parts = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in fields:
                raise KeyError(f"template field {field!r} has no column")
            parts.append(fields[field])
    return F.concat(*parts) if parts else F.lit("")


def judge_prompt(template: str, prompt, response0, response1, system: str | None = None) -> Column:
    """Judge messages: [system?] + user(template filled with the pair)."""
    text = format_fields(template, {"prompt": _c(prompt), "response0": _c(response0),
                                    "response1": _c(response1)})
    if system:
        return F.array(msg("system", F.lit(system)), msg("user", text))
    return F.array(msg("user", text))


def tldr_prompt(site, subreddit, title, post, article) -> Column:
    """SITE/ARTICLE text when site is set, else SUBREDDIT/TITLE/POST; else error."""
    site, subreddit = _c(site), _c(subreddit)
    return (F.when(site.isNotNull(), F.concat(F.lit(TLDR_SITE[0]), site, F.lit(TLDR_SITE[1]), _c(article)))
            .when(subreddit.isNotNull(), F.concat(F.lit(TLDR_REDDIT[0]), subreddit, F.lit(TLDR_REDDIT[1]),
                                                  _c(title), F.lit(TLDR_REDDIT[2]), _c(post)))
            .otherwise(F.raise_error(F.lit("neither site nor subreddit set"))))


#: A tokenizer hook: column of texts -> column of token numbers (native or a pandas UDF).
Counter = Callable[[Column], Column]


def token_count(text, counter: Counter | None = None) -> Column:
    """Number of tokens; by default whitespace-separated ones, else what ``counter`` says."""
    return counter(_c(text)) if counter else F.regexp_count(_c(text), F.lit(TOKEN_RE))


def truncate_lines(text, max_tokens: int, suffix: str = TLDR_SUFFIX, counts: Column | None = None) -> Column:
    """Drop trailing lines until the text has <= max_tokens tokens, then append
    ``suffix``. With a per-line additive tokenizer this is: keep the longest
    line prefix whose running token count fits (possibly none: empty text).
    Whole text is examined; running sums are one array pass. ``counts`` are the
    tokens of each line by another tokenizer (array<int>)."""
    lines = F.split(_c(text), "\n", -1)
    if counts is None:
        counts = F.transform(lines, lambda l: F.regexp_count(l, F.lit(TOKEN_RE)))
    run = F.aggregate(counts, F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")),
                      lambda st, c: F.struct((st["s"] + c).alias("s"),
                                             (st["k"] + F.when(st["s"] + c <= max_tokens, 1).otherwise(0))
                                             .alias("k")))
    kept = F.array_join(F.slice(lines, F.lit(1), run["k"]), "\n")
    return F.concat(kept, F.lit(suffix))


def first_completion(completions) -> Column:
    """completions[0] (null when empty)."""
    return F.get(_c(completions), 0)


def message_content(prompt, role: str | None = None) -> Column:
    """Content of the first message (or of the first ``role`` message)."""
    p = _c(prompt)
    if role is not None:
        p = F.filter(p, lambda m: m["role"] == role)
    return F.get(p, 0)["content"]

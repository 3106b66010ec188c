"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged into one block with array functions; blocks are joined to a
text ``### role: text<and>text</turn>``. ``&``, ``<`` and ``#`` inside roles and
texts are written ``&amp;``, ``&lt;`` and ``&num;`` (``:`` in a role ``&colon;``), so that
control strings occur only where the template puts them and reading back is exact. The loss mask is a run
length list over the formatted text's code points: (chars, in the loss).

Every step is linear in the size of a conversation. One conversation is one
string of the output, so its turns meet in one row by definition.

Defined results: null text counts as empty; null role as an empty role; null
turn numbers come first; equal turn numbers are ordered by role, then text;
repeated rows are turns of their own; rows with a null conv_id form a
conversation of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template; none holds an ampersand, escaped texts hold no < and no #.
HEAD, AFTER_ROLE, AND, END = "### ", ": ", "<and>", "</turn>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in (("#", "&num;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<chars long, loss boolean>>."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sorted_turns = (turns.select(F.col(conv_col).alias("conv"), F.struct(
        F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
        .groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    # first turn of each run of one role, and one past the last run
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[i - 1].role)")
    merged = F.expr("""transform(sequence(0, size(starts) - 1), k -> named_struct(
        'role', turns[starts[k]].role,
        'texts', transform(slice(turns, starts[k] + 1, coalesce(get(starts, k + 1), size(turns)) - starts[k]), t -> t.text)))""")
    blocks = sorted_turns.withColumn("starts", starts).select("conv", merged.alias("blocks"))
    # pieces of a block in turn: header, text, <and>, text, ..., end
    role = lambda b: F.replace(escape(b["role"]), F.lit(":"), F.lit("&colon;"))
    header = lambda b: F.concat(F.lit(HEAD), role(b), F.lit(AFTER_ROLE))
    body = lambda b: F.transform(b["texts"], escape)
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(header(b), F.array_join(body(b), AND), F.lit(END))), "")
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    out = F.lit(False)
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(run(F.length(header(b)), out)),
        F.flatten(F.transform(body(b), lambda t, i: F.array(
            run(F.when(i == 0, 0).otherwise(len(AND)), out), run(F.length(t), b["role"] == loss_role)))),
        F.array(run(F.lit(len(END)), out)))))
    return blocks.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), mask.alias("loss_mask"))


def _blocks(formatted: Column) -> Column:
    """Blocks of a formatted text without their end mark; every block ends with one."""
    cut = F.split(formatted, END)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def _written_role(block: Column) -> Column:
    """The escaped role of a block; it holds no colon."""
    return F.substring_index(F.substr(block, F.lit(len(HEAD) + 1)), AFTER_ROLE, 1)


def _written_texts(block: Column) -> Column:
    return F.split(F.substr(block, F.lit(len(HEAD) + len(AFTER_ROLE) + 1) + F.length(_written_role(block))), AND)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text: the turns as they went in."""
    return F.flatten(F.transform(_blocks(formatted), lambda b: F.transform(_written_texts(b), lambda t: F.struct(
        unescape(F.replace(_written_role(b), F.lit("&colon;"), F.lit(":"))).alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """Unescaped pieces of a formatted text under its loss mask; raises where a run's length differs."""
    pieces = F.flatten(F.transform(_blocks(formatted), lambda b: F.concat(
        F.array(F.concat(F.lit(HEAD), _written_role(b), F.lit(AFTER_ROLE))),
        F.flatten(F.transform(_written_texts(b), lambda t, i: F.array(F.when(i == 0, "").otherwise(AND), t))),
        F.array(F.lit(END)))))
    runs = F.arrays_zip(pieces.alias("piece"), mask.alias("run"))
    fits = F.size(pieces) == F.size(mask)
    fits &= F.forall(runs, lambda r: F.length(r["piece"]) == r["run"]["chars"])
    return F.when(fits, F.transform(F.filter(runs, lambda r: r["run"]["loss"]), lambda r: unescape(r["piece"]))).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the text")))


def chat_digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What formatted texts and their masks give back, as digests (a row for each conversation)."""
    line = F.lit("\n")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return (chats.withColumns({"turns": read_turns(F.col("formatted")),
                               "loss": F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "")})
            .select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))

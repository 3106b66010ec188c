"""B4 with a generator: completions corrected round by round.

Round 0 answers the prompt (or is given). Every further round answers the prompt, the
last completion and the instruction; earlier completions are not accumulated.
A round is a table under ``folder``, followed by a marker; a call that names the
folder of an interrupted one goes on after its last marked round. A row carries its
completions with it, so no round shuffles anything and the last table holds each
prompt's list.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from prefspark.functions import chat as ch
from prefspark.session import ensure_checkpoint_dir

#: A generator hook: column of prompts (text or messages) -> column of completion texts.
Generator = Callable[[Column], Column]


def text_generator(make_model: Callable[[], Callable[[list], list[str]]]) -> Generator:
    """A model as a hook: ``make_model`` is called once a task, the model once a batch of prompts."""
    @F.pandas_udf(StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()), dtype="object")

    return generate


def _marked(spark: SparkSession, folder: str, rounds: int, mark: str) -> int:
    """Number of finished rounds in the folder (at most ``rounds``); an error if other arguments made them."""
    done = 0
    while done < rounds:
        try:
            row = spark.read.schema("mark string").json(f"{folder}/done-{done}").first()
        except AnalysisException:
            row = None                                    # no such folder
        if row is None:
            break
        if row.mark != mark:
            raise ValueError(f"{folder} holds the rounds of another instruction or prompt form")
        done += 1
    return done


def correction_loop(prompts: DataFrame, generate: Generator, instruction: str, rounds: int, *, prompt: str = "prompt",
                    given: str = "leader_completion", return_sequences: int = 1, folder: str | None = None) -> DataFrame:
    """All columns of ``prompts`` (but ``given``) and ``completions``, the list of ``rounds`` completions.

    Prompts are texts, or messages (array of role and content); completions of
    messages are lists of one assistant message each. Where the column ``given`` exists and
    isn't null it is round 0 (a text, or messages whose first content is taken), else round 0 is
    generated. A null prompt or completion counts as an empty text in the next round's prompt.
    """
    if return_sequences != 1:
        raise ValueError("a correction round takes one completion a prompt: return_sequences must be 1")
    if rounds < 2:
        raise ValueError("correction needs at least two rounds: the first answer and one correction")
    if not instruction:
        raise ValueError("correction needs an instruction")
    spark = prompts.sparkSession
    chat = isinstance(prompts.schema[prompt].dataType, ArrayType)
    if not chat and not isinstance(prompts.schema[prompt].dataType, StringType):
        raise TypeError(f"{prompt} must be a text or an array of messages")
    kept = [c for c in prompts.columns if c not in (given, "completions")]
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex[:12]}"
    mark = hashlib.md5(f"{instruction}|{chat}".encode()).hexdigest()
    done = _marked(spark, folder, rounds, mark)

    def finish(table: DataFrame, number: int) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/round-{number}")
        spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").json(f"{folder}/done-{number}")
        return spark.read.parquet(f"{folder}/round-{number}")

    q = F.col(f"`{prompt}`")
    own = [F.col(f"`{c}`") for c in kept]
    if done:
        table = spark.read.parquet(f"{folder}/round-{done - 1}")
    else:
        asked = prompts
        first = generate(q)
        if given in prompts.columns:
            said = F.col(f"`{given}`")
            if isinstance(prompts.schema[given].dataType, ArrayType):
                said = F.get(said, 0)["content"]
            has = prompts.where(said.isNotNull()).select(*own, F.array(said).alias("completions"))
            asked = prompts.where(said.isNull())              # the generator sees only these
            table = finish(has.unionByName(asked.select(*own, F.array(first).alias("completions"))), 0)
        else:
            table = finish(asked.select(*own, F.array(first).alias("completions")), 0)
    for number in range(max(done, 1), rounds):
        last = F.coalesce(F.element_at("completions", -1), F.lit(""))
        asked = (ch.follower_prompt(F.coalesce(q, F.array().cast(table.schema[prompt].dataType)), last, instruction) if chat
                 else ch.follower_prompt_text(F.coalesce(q, F.lit("")), last, instruction))
        table = finish(table.select(*own, F.array_append("completions", generate(asked)).alias("completions")), number)
    shown = F.transform("completions", lambda c: F.array(ch.msg("assistant", c))) if chat else F.col("completions")
    return table.select(*own, shown.alias("completions"))

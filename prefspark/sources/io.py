"""Sources and sinks: named tables, multi-split datasets, JSON records and the
source registry that maps every supported dataset to one common schema
(A1-A4, A6, A7, A9)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions import chat as ch
from prefspark.operators import ids as idx
from prefspark.operators import labels as lb
from prefspark.operators import text as tx
from prefspark.sources.tables import table


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A1: load a named table (parquet), pruned to ``cols``."""
    return table(spark, sf_dir, name, *cols)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: all splits under one folder, ``split`` as the partition column."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """A2: a saved multi-split dataset; a split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split").isin(splits)) if splits else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A4: newline-delimited JSON with a declared schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def parse_json_records(df: DataFrame, col: str, schema: str) -> DataFrame:
    """A4 for JSON held in a string column: ``from_json`` with a declared schema."""
    return df.withColumn("_rec", F.from_json(F.col(col), schema)).select("*", "_rec.*").drop("_rec")


def expand_attribute_paths(template: str) -> dict[str, str]:
    """``prefix(a|b|c)suffix`` -> {a: prefix a suffix, ...} (driver-side string work
    on a user parameter)."""
    m = re.fullmatch(r"(.*)\(([^()]*)\)(.*)", template)
    if not m:
        return {"": template}
    prefix, names, suffix = m.groups()
    return {n: prefix + n + suffix for n in names.split("|")}


def read_attribute_tables(spark: SparkSession, template: str, cols: list[str] | None = None) -> DataFrame:
    """Union of the per-attribute parquet reads, tagged with ``attribute``."""
    out = None
    for attr, path in expand_attribute_paths(template).items():
        df = spark.read.parquet(path)
        df = (df.select(*cols) if cols else df).withColumn("attribute", F.lit(attr))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def split_row_counts(df: DataFrame, stage: str) -> DataFrame:
    """Rows per split at a named stage."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("stage", F.lit(stage))


# ---------------------------------------------------------------- A6 registry
def source_preference_mixture(df: DataFrame, prompts_only: bool) -> DataFrame:
    """Prompts only -> (prompt_id, prompt as one user message); else id, chosen, rejected."""
    if prompts_only:
        return df.select(F.col("id").alias("prompt_id"), ch.user_message(F.col("prompt")).alias("prompt"))
    return df.select(F.col("id").alias("prompt_id"), "chosen", "rejected")


def source_instruction_eval(df: DataFrame) -> DataFrame:
    """A6d: instruction -> prompt, dense ids in source order, one user message,
    a single 'validation' split. Input (order key ``item_id``, ``instruction``, further columns):
    ``output`` and ``generator`` are dropped, all others stay."""
    x = idx.dense_ids(df.drop("output", "generator"), "item_id", "prompt_id")
    kept = [F.col(f"`{c}`") for c in x.columns if c not in ("item_id", "instruction", "prompt_id", "split")]
    return x.select("prompt_id", ch.user_message(F.col("instruction")).alias("prompt"), *kept,
                    F.lit("validation").alias("split"))


def source_constraint_eval(df: DataFrame, prompts_only: bool) -> DataFrame:
    """A6e: dense ids, one user message; prompts only keeps (prompt_id, prompt);
    a single 'validation' split."""
    x = idx.dense_ids(df, "item_id", "prompt_id").withColumn("prompt", ch.user_message(F.col("prompt")))
    x = x.select("prompt_id", "prompt") if prompts_only else x.drop("item_id")
    return x.withColumn("split", F.lit("validation"))


def source_rated_pairs(pairs: DataFrame, prompts_only: bool, labels: DataFrame | None = None,
                       attribute: str | None = None) -> DataFrame:
    """Prompts only drops labels/completions and wraps the prompt; else D2 + B1."""
    if prompts_only:
        return pairs.select("prompt_id", "split", ch.user_message(F.col("prompt")).alias("prompt"))
    cr = lb.chosen_rejected(pairs, labels, attribute)
    pm = ch.user_message(F.col("prompt"))
    return cr.select("prompt_id", "split", ch.with_assistant(pm, F.col("chosen")).alias("chosen"),
                     ch.with_assistant(pm, F.col("rejected")).alias("rejected"))


def prompt_sources(named: dict[str, DataFrame]) -> DataFrame:
    """The prompt-only sources in one schema (source, prompt_id string, prompt, split).

    ``named`` maps source names to their raw tables. A source without splits of its
    own is all 'train'. Ids are texts, since sources number their prompts differently."""
    out = None
    for name, raw in named.items():
        x = normalize_source(name, raw, prompts_only=True)
        split = F.col("split") if "split" in x.columns else F.lit("train")
        x = x.select(F.lit(name.lower()).alias("source"), F.col("prompt_id").cast("string").alias("prompt_id"), "prompt", split.alias("split"))
        out = x if out is None else out.unionByName(x)
    return out


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "rated_pairs": source_rated_pairs,
    "annotated_summaries": tx.source_annotated_summaries,
    "preference_mixture": source_preference_mixture,
    "instruction_eval": source_instruction_eval,
    "constraint_eval": source_constraint_eval,
}


#: Sources that exist only as raw rows and have to be paired and split first.
UNSPLIT = ("rated_responses",)


def normalize_source(name: str, *args, prompts_only: bool = False, **kwargs) -> DataFrame:
    """Dispatch a dataset name (case-insensitive) to its adapter; unknown names, a
    source that must be split first and unsupported modes raise."""
    key = name.lower()
    if key in UNSPLIT:
        raise ValueError(f"{name} has to be split for training and validation first (A6a, C7)")
    if key not in SOURCES:
        raise ValueError(f"Dataset not supported: {name}")
    if key == "annotated_summaries":
        if prompts_only:
            raise NotImplementedError("annotated summaries have no prompts-only form")
        return SOURCES[key](*args, **kwargs)
    if key == "instruction_eval":
        return SOURCES[key](*args, **kwargs)
    return SOURCES[key](*args, prompts_only=prompts_only, **kwargs)

"""A training corpus from ``documents``: five stages, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; rows that a stage doesn't reject keep all their columns.
Nulls, empty texts, repeated rows and further columns pass through as the
operators' docstrings say. There is no SQL twin: the classifier is trained.

Stages pass whole texts to Python, so each sets Arrow batches of at most
``ROWS_A_BATCH`` rows and about ``BYTES_A_BATCH`` bytes in the session. The settings stay, since a
stage's result is written after it has returned; they bound what a task holds and change no result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import bpe, decontaminate, minhash, repeats, toxicity
from prefspark.llm.tables import read
from prefspark.session import ensure_checkpoint_dir

ORACLE_SQL = None
ROWS_A_BATCH, BYTES_A_BATCH = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ROWS_A_BATCH`` rows and about ``BYTES_A_BATCH`` bytes from here on."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= ROWS_A_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BYTES_A_BATCH}b")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those linked by a similarity of 0.8 of five-word shingles."""
    small_batches(spark)
    return minhash.deduplicated(docs, 5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has too are cut out of the texts.

    A character stays if a byte of it stays; null texts stay null; n_chars follows the text."""
    small_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.col("text").isNull().alias("__null"))
    got = repeats.remove_repeats(docs.select("doc_id", rest.alias("rest"), "text"), keep=("rest",), with_text=True)
    text = F.when(~F.col("rest.__null"), F.col("kept_text"))
    out = {c: F.col("rest").getField(c) for c in others} | {"text": text}
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(out["n_chars"])
    return got.select(*[out[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 percent of a benchmark item's five-word shingles go.

    Documents are told apart by their text's digest, so null and repeated ids do no harm."""
    small_batches(spark)
    keyed = docs.select(F.md5("text").alias("__key"), "text").where("text is not null")
    leaks = decontaminate.contained_items(keyed, read(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("__key").alias("__leak")).distinct()
    return docs.join(leaks, F.md5(docs["text"]) == leaks["__leak"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; stages are written under the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

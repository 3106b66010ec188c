"""Line dedup by a sharded minimal perfect hash over the corpus's distinct lines.

A line's key is the line without white space at its ends, A-Z lower-cased; keys
below ten code points are left alone. Keys are hashed to 128 bits and split into
shards by their first bits. A shard of the index is one row: a minimal perfect hash
over its distinct hashes and three arrays by slot, a 32-bit fingerprint, the number
of documents that hold the line and the smallest id among them. No line text and no
full hash is stored, so a distinct line costs some 17 bytes.

Documents are packed into blocks (``blocks.py``). A block sends each of its distinct
hashes once; Spark counts them with a partial aggregation in every task, so the line
that a third of all documents share is a row for each task. Documents then probe
the shards: a slot, a fingerprint, a count. All lines of the corpus are in the
index, so they never meet a stranger's slot; a line of other documents does
with a chance of 2**-32. A shard that many blocks probe is probed in slices, by block.
The number of shards follows the number of counted hashes. What returns to a block is
the owner of each repeated line; the block takes the lines out.

Defined results: a null or empty text is one empty line; a null id counts as the
smallest long and is returned as null; rows with equal ids never take lines from one
another; a line keeps all its occurrences in the smallest id that holds it; a text
whose lines all go becomes empty; an empty table gives no rows. Columns in ``keep``
pass through, others are ignored. Memory is bounded by a block (one longer text is a
block of its own), a shard's arrays and a slice of its probes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from prefspark.llm.blocks import text_blocks, unpack, visit
from prefspark.llm.tables import materialize
from prefspark.llm.token_index import NULL_KEY, PerfectHash

LEAST = 10                   # code points of a key
SHARD_KEYS = 1 << 19         # hashes a shard or a slice of probes holds, about
BLOCKS_A_TASK = 24
BLANK = b" \t\n\v\f\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ENTRY = "block long, pos int, h1 long, h2 long, first long, docs long"
SHARD = "shard int, n_keys long, n_entries long, sizes binary, words binary, prints binary, counts binary, owners binary"


def line_hashes(text: bytes) -> list[bytes]:
    """128-bit hash of each line's key; empty for a line that is left alone."""
    keys = [line.strip(BLANK) for line in text.translate(LOWER).split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if len(k) >= 4 * LEAST or len(k) >= LEAST and len(k.decode()) >= LEAST else b"" for k in keys]


def texts_of(rows: pa.Table) -> list[bytes]:
    return rows.column(rows.num_columns - 1).cast(pa.large_binary()).to_pylist()


def ids_of(rows: pa.Table) -> list[int]:
    return rows.column(0).cast(pa.int64()).fill_null(NULL_KEY).to_pylist()


def block_lines(rows: pa.Table) -> tuple[list[list[bytes]], dict[bytes, list[int]]]:
    """Each text's line hashes, and for each distinct one its position, smallest id and number of rows."""
    lines, seen = [], {}
    for key, text in zip(ids_of(rows), texts_of(rows)):
        own = line_hashes(text)
        lines.append(own)
        for h in dict.fromkeys(own):
            if h:
                at = seen.setdefault(h, [len(seen), key, 0])
                at[1], at[2] = min(at[1], key), at[2] + 1
    return lines, seen


def block_entries(block: int, rows: pa.Table, _replies: list) -> list[pa.RecordBatch]:
    _, seen = block_lines(rows)
    if not seen:
        return []
    h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
    pos, first, docs = (np.array(v, np.int64) for v in zip(*seen.values()))
    return [pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(pos), block)), pa.array(pos.astype(np.int32)), pa.array(np.ascontiguousarray(h[:, 0])),
         pa.array(np.ascontiguousarray(h[:, 1])), pa.array(first), pa.array(docs)], ["block", "pos", "h1", "h2", "first", "docs"])]


def build_shard(table: pa.Table) -> pa.Table:
    """One row of the index from the distinct hashes of a shard."""
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    index = PerfectHash.build(h1, h2)
    slot = index.slots(h1, h2)
    prints, counts, owners = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.int64)
    prints[slot] = fingerprints(h1, h2)
    counts[slot] = np.minimum(table.column("docs").to_numpy(), 2**32 - 1)
    owners[slot] = table.column("first").to_numpy()
    parts = [index.sizes.astype("<i8"), index.words.astype("<u8"), prints, counts, owners]
    return pa.table([table.column("shard").slice(0, 1), pa.array([len(slot)], pa.int64()),
                     pa.array([int(table.column("entries").to_numpy().sum())], pa.int64()),
                     *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                    names=["shard", "n_keys", "n_entries", "sizes", "words", "prints", "counts", "owners"])


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return ((h2 >> np.uint64(32)) ^ (h1 & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def probe_shard(_key, probes: pa.Table, shard: pa.Table) -> pa.Table:
    """(block, pos, owner) of the probes whose line at least two documents hold."""
    if probes.num_rows and shard.num_rows:
        read = {c: np.frombuffer(shard.column(c)[0].as_buffer(), t) for c, t in
                (("sizes", "<i8"), ("words", "<u8"), ("prints", "<u4"), ("counts", "<u4"), ("owners", "<i8"))}
        h1, h2 = (probes.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slot = PerfectHash(read["sizes"], read["words"]).slots(h1, h2)
        hit = slot >= 0
        hit[hit] = (read["prints"][slot[hit]] == fingerprints(h1[hit], h2[hit])) & (read["counts"][slot[hit]] > 1)
        picked = probes.select(["block", "pos"]).filter(pa.array(hit))
        return picked.append_column("owner", pa.array(read["owners"][slot[hit]]))
    return pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("owner", pa.int64())]).empty_table()


def shard_of(shards: int):
    """Shard of a signed first hash: its place among ``shards`` equal ranges."""
    return (F.shiftrightunsigned("h1", 32) * F.lit(shards) / F.lit(2**32)).cast("int")


def build_index(entries: DataFrame, shards: int) -> DataFrame:
    """The index table of all entries, a row a shard."""
    lines = (entries.withColumn("shard", shard_of(shards)).groupBy("shard", "h1", "h2")
             .agg(F.min("first").alias("first"), F.sum("docs").alias("docs"), F.count("*").alias("entries")))
    return materialize(lines.repartition(shards, "shard").groupBy("shard").applyInArrow(build_shard, SHARD), "line-index")


def probe(entries: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(block, pos, owner) of the entries that the index knows from two documents or more."""
    index = index.withColumn("slices", F.ceil(F.col("n_entries") / SHARD_KEYS).cast("int"))
    sliced = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    wide = index.where("slices > 1").select("shard", "slices")
    asked = (entries.withColumn("shard", shard_of(shards)).join(wide, "shard", "left")
             .withColumn("slice", F.pmod(F.xxhash64("block"), F.coalesce("slices", F.lit(1))).cast("int")))
    by = ["shard", "slice"]
    return (asked.select(*by, "block", "pos", "h1", "h2").repartition(shards, *by).groupBy(*by)
            .cogroup(sliced.select(*by, "sizes", "words", "prints", "counts", "owners").repartition(shards, *by).groupBy(*by))
            .applyInArrow(probe_shard, "block long, pos int, owner long"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, kept_text, n_lines, n_dropped) of every row."""
    spark = docs.sparkSession
    cols = [id_col, *keep, text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)])
    blocks = text_blocks(rows, *rows.columns)
    entries = materialize(visit(blocks, None, block_entries, ENTRY), "line-hashes")
    shards = max(1, math.ceil(entries.count() / SHARD_KEYS))
    index = build_index(entries, shards)
    owners = probe(entries, index, shards)
    last = len(cols) - 1
    schema = StructType([*rows.schema.fields[:last], StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def cut(block: pa.Table, replies: pa.Table) -> pa.Table:
        table = unpack(block.column("payload")[0].as_buffer())
        lines, seen = block_lines(table)
        hashes = list(seen)
        owner = {hashes[p]: o for p, o in zip(replies.column("pos").to_pylist(), replies.column("owner").to_pylist())}
        texts, n_lines, n_dropped = [], [], []
        for key, text, own in zip(ids_of(table), texts_of(table), lines):
            stays = [not h or owner.get(h, key) >= key for h in own]
            texts.append(text if all(stays) else b"\n".join(x for x, s in zip(text.split(b"\n"), stays) if s))
            n_lines.append(len(own))
            n_dropped.append(len(own) - sum(stays))
        out = [*table.columns[:last], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.table(out, names=schema.names)

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(blocks.count() / BLOCKS_A_TASK))
    got = blocks.repartition(tasks, "block").groupBy("block").cogroup(owners.repartition(tasks, "block").groupBy("block")).applyInArrow(cut, schema)
    return got.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols[:last])], "kept_text", "n_lines", "n_dropped")

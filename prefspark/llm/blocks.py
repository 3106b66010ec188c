"""Documents packed into blocks, for operators that visit whole texts several times.

A block is a few megabytes of consecutive rows in one compressed binary value.
The blocks are written once as a table, so block numbers hold for all later
visits, and what a group of rows has in common is counted within its block
before anything is shuffled. Replies to a block come back by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefspark.llm.tables import materialize, release, row_runs, text_buffers

BLOCK_BYTES = 2 << 20
PLANES = b"planes"


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _column(v: np.ndarray) -> pa.Array:
    """A vector, or the rows of a byte matrix as binary values of one width."""
    if v.ndim == 1:
        return pa.array(v)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(v.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(v))])


def _vector(v: pa.Array) -> np.ndarray:
    if not pa.types.is_fixed_size_binary(v.type):
        return v.to_numpy(zero_copy_only=False)
    width = v.type.byte_width
    return np.frombuffer(v.buffers()[1], np.uint8)[v.offset * width: (v.offset + len(v)) * width].reshape(-1, width)


def arrays(**columns: np.ndarray) -> bytes:
    """Named arrays of one length as a compressed value."""
    return pack(pa.RecordBatch.from_arrays([_column(v) for v in columns.values()], list(columns)))


def unpacked(blobs: Iterator[bytes]) -> dict[str, np.ndarray]:
    """The same of several values, one after the other; ``blob`` tells the value each row came from."""
    tables = [unpack(b) for b in blobs]
    out = pa.concat_tables(tables).combine_chunks()
    return {n: _vector(out.column(n).combine_chunks()) for n in out.column_names} | {"blob": np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])}


def planes(**columns: np.ndarray) -> bytes:
    """Named arrays of one length as a compressed value, like ``arrays``, but with the first bytes of all
    numbers together, then the second ones, without high bytes that no number needs."""
    head, raw = [], []
    for name, v in columns.items():
        size = v.dtype.itemsize
        need = size if v.dtype.kind != "u" else -(-int(v.max(initial=0)).bit_length() // 8)
        head.append((name, v.dtype.str, need))
        raw.append(np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), size)[:, :need].T))
    body, told = np.concatenate([r.ravel() for r in raw]), json.dumps([len(v), head]).encode()
    return PLANES + len(told).to_bytes(4, "little") + told + pa.Codec("zstd").compress(body, asbytes=True)


def unplaned(blob: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    """The arrays that ``planes`` packed."""
    blob = memoryview(blob)
    at = len(PLANES) + 4
    body = at + int.from_bytes(blob[at - 4: at], "little")
    n, head = json.loads(bytes(blob[at: body]))
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[body:], n * sum(need for *_, need in head)), np.uint8)
    out, x = {}, 0
    for name, kind, need in head:
        v = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        v[:, :need] = raw[x: x + n * need].reshape(need, n).T
        out[name], x = v.view(kind).ravel(), x + n * need
    return out


def has_planes(blob: bytes | pa.Buffer) -> bool:
    return bytes(memoryview(blob)[:len(PLANES)]) == PLANES


def text_blocks(docs: DataFrame, *cols: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block long, payload binary) of the columns; the last one is the text (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def full():
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(table)], pa.binary())], ["block", "payload"])

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            _, offs = text_buffers(text)
            for a, b in row_runs(offs, block_bytes):
                own = int(offs[b] - offs[a])
                if held and size + own > block_bytes:
                    yield full()
                    held, size, number = [], 0, number + 1
                held.append(batch.slice(a, b - a))
                size += own
        if held:
            yield full()
        held.clear()
        release()

    *others, text = cols
    rows = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text))
    return materialize(rows.mapInArrow(run, "block long, payload binary"), "blocks")


def visit(blocks: DataFrame, replies: DataFrame | None, fn: Callable[[int, pa.Table, list[bytes]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``fn(block, rows, replies)`` for every block; replies are (block, blob) rows."""
    if replies is None:
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from fn(block, unpack(payload.as_buffer()), [])
            release()

        return blocks.mapInArrow(alone, schema)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload")):
            out += fn(block, unpack(payload.as_buffer()), [b.as_buffer() for b in right.column("blob")])
        return pa.Table.from_batches(out) if out else None

    def grouped(left: pa.Table, right: pa.Table) -> pa.Table:
        got = together(left, right)
        release()
        return got if got is not None else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    empty = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()
    return blocks.groupBy("block").cogroup(replies.select("block", "blob").groupBy("block")).applyInArrow(grouped, schema)


def merge(entries: DataFrame, fn: Callable[[dict[str, np.ndarray]], Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]]) -> DataFrame:
    """Per bucket of (bucket, block, blob) rows: ``fn`` of all its entries together gives (mask, columns)
    pairs; what concerns a block's own entries returns as (block, blob)."""
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        rows = unpacked(b.as_buffer() for b in table.column("blob"))
        out_block, out_blob = [], []
        order_of = rows["blob"]
        for mask, columns in fn(rows):
            at = np.flatnonzero(mask)
            at = at[np.argsort(order_of[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(order_of[at], prepend=-1))
            for x, y in zip(cuts, [*cuts[1:], len(at)]):
                out_block.append(block[order_of[at[x]]])
                out_blob.append(arrays(**{n: np.ascontiguousarray(v[at[x:y]]) for n, v in columns.items()}))
        del rows
        release()
        return pa.table({"block": pa.array(out_block, pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, "block long, blob binary")


def by_bucket(block: int, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, block, blob) rows of entries, one for each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
    ends = [*cuts[1:].tolist(), len(order)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[order][cuts].astype(np.int64)), pa.array(np.full(len(cuts), block)),
         pa.array([arrays(**{n: v[order[x:y]] for n, v in columns.items()}) for x, y in zip(cuts.tolist(), ends)], pa.binary())],
        ["bucket", "block", "blob"])

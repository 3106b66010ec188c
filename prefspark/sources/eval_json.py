"""A5 sink: one JSON array file for each completion index.

``eval_json_parts`` is a batch sink of the Python Data Source API. A task writes one part
for each completion index it meets, under a name of its own attempt; what it
returns on success names its parts. The commit writes the list of exactly those
parts and deletes what failed attempts left; an abort deletes everything. The
records then become one array file each index: a Spark task an index copies the
listed parts in order, in pieces of bounded size, to a file that gets its name when it
is whole. Neither the driver nor a task holds more than a piece of a file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "eval_json_parts"
PIECE = 4 << 20
LIST = "_parts.json"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder as Spark names it (file:/x, hdfs://..., /x)."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", uri)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(uri)


@dataclass
class Parts(WriterCommitMessage):
    """(completion index, task, file name, records) of a successful attempt."""

    parts: list[tuple[int, int, str, int]]


class EvalJsonWriter(DataSourceWriter):
    """Rows (completion_idx, record): comma-separated records, a file for each index and attempt."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Parts:
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        files, names, counts = {}, {}, {}
        try:
            for i, record in rows:
                if i not in files:
                    names[i], counts[i] = f"part-{i}-{task}-{attempt}", 0
                    files[i] = fs.open_output_stream(f"{folder}/{names[i]}")
                else:
                    files[i].write(b",\n")
                files[i].write(record.encode())
                counts[i] += 1
        finally:
            for f in files.values():
                f.close()
        return Parts([(i, task, names[i], counts[i]) for i in names])

    def commit(self, messages: list[Parts | None]) -> None:
        fs, folder = filesystem(self.folder)
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        fs.create_dir(folder)
        known = {p[2] for p in parts}
        for f in fs.get_file_info(pafs.FileSelector(folder)):
            if f.base_name not in known:
                fs.delete_file(f.path)
        with fs.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[Parts | None]) -> None:
        fs, folder = filesystem(self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class EvalJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "completion_idx int, record string"

    def writer(self, schema: StructType, overwrite: bool) -> EvalJsonWriter:
        return EvalJsonWriter(self.options["path"])


def _array_file(folder: str, target: str, parts: list[list]) -> int:
    """The parts as one JSON array under the name ``target``."""
    fs, source = filesystem(folder)
    _, path = filesystem(target)
    made = f"{path}.{uuid.uuid4().hex[:12]}.tmp"
    with fs.open_output_stream(made) as out:
        out.write(b"[")
        for k, (_, _, name, _) in enumerate(parts):
            out.write(b",\n" if k else b"")
            with fs.open_input_stream(f"{source}/{name}") as f:
                while piece := f.read(PIECE):
                    out.write(piece)
        out.write(b"]")
    fs.move(made, path)
    return sum(p[3] for p in parts)


def write_eval_arrays(rows: DataFrame, path: str, order: str = "prompt_id", index: str = "completion_idx") -> DataFrame:
    """Writes ``{path}_completion_{i}.json`` for every index i and returns (completion_idx, file, n_records).

    A record holds all columns but ``order`` and ``index``; null fields are written as null.
    Records lie in the order of ``order`` (ties in no particular order). Existing files of
    these names are replaced one by one. Without rows nothing is written."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(EvalJsonSource)
    base = path.rstrip("/")
    parts_folder = f"{base}_parts-{uuid.uuid4().hex[:12]}"
    fields = [F.col(f"`{c}`") for c in rows.columns if c not in (order, index)]
    named = rows.select(F.col(f"`{order}`").alias("o"), F.col(f"`{index}`").cast("int").alias("completion_idx"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    records = named.repartitionByRange("o").sortWithinPartitions("o").select("completion_idx", "record")
    records.write.format(FORMAT).mode("append").option("path", parts_folder).save()
    fs, folder = filesystem(parts_folder)
    with fs.open_input_stream(f"{folder}/{LIST}") as f:
        parts = json.loads(f.read())
    by_index: dict[int, list[list]] = {}
    for p in parts:
        by_index.setdefault(p[0], []).append(p)
    work = spark.createDataFrame([(i, json.dumps(own)) for i, own in sorted(by_index.items())], "completion_idx int, parts string")

    def join(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for i, own in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{base}_completion_{i}.json"
                out.append((i, target, _array_file(parts_folder, target, json.loads(own))))
            if out:
                idx, files, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), pa.array(files), pa.array(n, pa.int64())], ["completion_idx", "file", "n_records"])

    if not by_index:
        fs.delete_dir(folder)
        return spark.createDataFrame([], "completion_idx int, file string, n_records long")
    done = work.repartition(len(by_index), "completion_idx").mapInArrow(join, "completion_idx int, file string, n_records long").collect()
    fs.delete_dir(folder)
    return spark.createDataFrame([(r.completion_idx, r.file, r.n_records) for r in done], "completion_idx int, file string, n_records long")


def read_eval_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All ``{path}_completion_*.json`` as rows of ``schema`` and ``file``."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{path.rstrip('/')}_completion_*.json").withColumn("file", F.input_file_name())

"""File sources and sinks: JSON lines (A4), eval export (A5), path templates (A7), splits (A2/A3)."""

import json

from pyspark.sql import functions as F

from prefspark.operators import shape as sh
from prefspark.sources import fixtures as fx
from prefspark.sources import io as sio

SF = "/root/testdata/sf0.001"


def test_read_jsonl_with_declared_schema(spark, tmp_path):
    ev = fx.table(spark, SF, "events", "event_id", "props")
    path = str(tmp_path / "props")
    ev.select(F.to_json(F.struct("event_id", F.from_json("props", "k long")["k"].alias("k"))).alias("value")) \
      .write.text(path)
    got = sio.read_jsonl(spark, path, "event_id long, k long")
    want = sio.parse_json_records(ev, "props", "k long").select("event_id", "k")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_export_eval_json_one_folder_per_completion(spark, tmp_path):
    rows = sh.export_eval_rows(fx.generations(spark, SF).select("prompt_id", "prompt", "comps"), "gen")
    path = str(tmp_path / "eval")
    sh.write_eval_json(rows, path)
    back = spark.read.json(path)
    assert back.count() == rows.count()
    assert set(r["completion_idx"] for r in back.select("completion_idx").distinct().collect()) == \
        set(r["completion_idx"] for r in rows.select("completion_idx").distinct().collect())
    one = back.filter(F.col("completion_idx") == 0).first()
    assert one["generator"] == "gen_completion_0" and one["dataset"] == "prefspark"
    assert json.loads(json.dumps(one.asDict()))["instruction"] is not None


def test_expand_attribute_paths():
    assert sio.expand_attribute_paths("/m/(a|b|c)/r") == {"a": "/m/a/r", "b": "/m/b/r", "c": "/m/c/r"}
    assert sio.expand_attribute_paths("/plain/path") == {"": "/plain/path"}


def test_write_then_read_splits_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "splits")
    raw = fx.tldr_raw(spark, SF).select("id", "worker", "split")
    sio.write_splits(raw, path)
    val = sio.read_splits(spark, path, ["validation"])
    assert val.count() == raw.filter(F.col("split") == "validation").count()
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        val.explain()
    assert "PartitionFilters: [isnotnull(split" in buf.getvalue() and "validation" in buf.getvalue()


def test_unknown_source_raises():
    import pytest
    with pytest.raises(ValueError):
        sio.normalize_source("no_such_source", None)

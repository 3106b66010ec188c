"""A5 sink: array files, order, failed attempts."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from prefspark.operators import shape as sh
from prefspark.sources import eval_json as ej


def gens(spark, n=120):
    rows = [(k, f"prompt \"{k}\"\n", [(1, f"é {k}/0"), (2, None if k % 7 == 0 else f"b{k}")], "x" if k % 2 else None) for k in range(n)]
    return spark.createDataFrame(rows, "prompt_id int, prompt string, comps array<struct<turn:int,text:string>>, tag string")


def test_one_array_file_for_each_completion(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = sh.export_eval_rows(gens(spark).repartition(6), "gen")
    done = sorted((r.completion_idx, os.path.basename(r.file), r.n_records) for r in ej.write_eval_arrays(rows, path).collect())
    assert done == [(0, "out_completion_0.json", 120), (1, "out_completion_1.json", 120)]
    for i in (0, 1):
        with open(f"{path}_completion_{i}.json") as f:
            got = json.load(f)
        assert [g["instruction"] for g in got] == [f"prompt \"{k}\"\n" for k in range(120)]
        assert got[8] == {"tag": None, "instruction": "prompt \"8\"\n", "output": ["é 8/0", "b8"][i], "generator": f"gen_completion_{i}", "dataset": "prefspark", "datasplit": "eval"}
        assert got[7]["tag"] == "x" and got[7]["output"] == ["é 7/0", None][i]
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/*")) == ["out_completion_0.json", "out_completion_1.json"]
    back = ej.read_eval_arrays(spark, path, "instruction string, output string, generator string")
    assert back.count() == 240 and back.where("output is null").count() == 18
    again = ej.write_eval_arrays(rows.where("prompt_id < 3"), path).collect()
    assert sum(r.n_records for r in again) == 6 and ej.read_eval_arrays(spark, path, "instruction string").count() == 6


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    rows = sh.export_eval_rows(gens(spark).repartition(4), "gen")
    bad = rows.withColumn("output", F.when(F.col("prompt_id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="lost"):
        ej.write_eval_arrays(bad, str(tmp_path / "out"))
    assert glob.glob(f"{tmp_path}/*") == []
    assert ej.write_eval_arrays(rows.where("false"), str(tmp_path / "none")).collect() == [] and glob.glob(f"{tmp_path}/*") == []


def test_commit_lists_only_reported_parts(tmp_path):
    """What an attempt that failed, or was repeated, wrote is deleted and never read."""
    folder = tmp_path / "parts"
    folder.mkdir()
    for name, text in (("part-0-0-a", "1"), ("part-0-1-b", "2,\n3"), ("part-0-1-lost", "9")):
        (folder / name).write_text(text)
    ej.EvalJsonWriter(str(folder)).commit([ej.Parts([(0, 0, "part-0-0-a", 1)]), None, ej.Parts([(0, 1, "part-0-1-b", 2)])])
    assert sorted(os.listdir(folder)) == ["_parts.json", "part-0-0-a", "part-0-1-b"]
    parts = json.loads((folder / "_parts.json").read_text())
    assert ej._array_file(str(folder), str(tmp_path / "x.json"), parts) == 3 and json.loads((tmp_path / "x.json").read_text()) == [1, 2, 3]
    ej.EvalJsonWriter(str(folder)).abort([None])
    assert not folder.exists()

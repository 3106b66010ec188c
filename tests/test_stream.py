"""The streaming rollup equals its batch twin (complete mode, any file order)."""

from pyspark.sql import functions as F

from prefspark.sources import fixtures as fx
from prefspark.streaming import metrics as sm

SF = "/root/testdata/sf0.001"


def _rows(df):
    # a sum of doubles depends on the order of its terms in the last digits
    return sorted(tuple(r) for r in df.select("window_start", "metric", "n", F.round("sum_value", 6)).collect())


def test_stream_equals_batch(spark):
    batch = sm.metric_rollup(fx.table(spark, SF, "events"))
    stream = sm.metric_rollup_stream(spark, f"{SF}/events*.parquet")
    assert _rows(stream) == _rows(batch)


def test_small_values_are_not_rounded(spark, tmp_path):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1, i), 0, "kl", v, None) for i, v in enumerate((0.001, 0.004, 0.0049, -2e-7))]
    log = spark.createDataFrame(rows, sm.METRIC_SCHEMA)
    log.write.parquet(str(tmp_path / "log"))
    for out in (sm.metric_rollup(log), sm.metric_rollup_stream(spark, str(tmp_path / "log"))):
        r, = out.collect()
        assert r.n == 4 and abs(r.sum_value - 0.0098998) < 1e-15 and abs(r.mean_value - 0.00247495) < 1e-15


def test_restart_reads_only_new_files(spark, tmp_path):
    ev = fx.table(spark, SF, "events")
    src, where = str(tmp_path / "log"), {"out_path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}
    ev.where(F.col("event_id") % 2 == 0).write.parquet(src)
    sm.metric_rollup_stream(spark, src, **where)
    ev.where(F.col("event_id") % 2 == 1).write.mode("append").parquet(src)
    assert _rows(sm.metric_rollup_stream(spark, src, **where)) == _rows(sm.metric_rollup(ev))
    assert _rows(sm.metric_rollup_stream(spark, src, **where)) == _rows(sm.metric_rollup(ev))     # nothing new


def test_stream_over_many_files_in_random_order(spark, tmp_path):
    ev = fx.table(spark, SF, "events")
    src = str(tmp_path / "log")
    ev.repartition(6, F.col("event_id") % 6).write.parquet(src)    # 6 files, time-disordered
    stream = sm.metric_rollup_stream(spark, src, max_files_per_trigger=1)
    assert _rows(stream) == _rows(sm.metric_rollup(ev))


def test_append_mode_drops_late_rows(spark, tmp_path):
    """One file per trigger on time-disordered files: after the first file the
    watermark is near the end of the range, so older rows in later files are
    late and dropped, and windows still open at the end are not emitted."""
    ev = fx.table(spark, SF, "events")
    src = str(tmp_path / "log")
    ev.repartition(6, F.col("event_id") % 6).write.parquet(src)
    out = sm.metric_rollup_stream(spark, src, max_files_per_trigger=1, output_mode="append")
    batch = {(r[0], r[1]): r[2] for r in _rows(sm.metric_rollup(ev))}
    got = _rows(out)
    total = sum(r[2] for r in got)
    assert total < ev.count()
    assert all(n <= batch[(w, m)] for w, m, n, _ in got)


def test_append_mode_on_time_ordered_files_matches_closed_windows(spark, tmp_path):
    ev = fx.table(spark, SF, "events")
    src = str(tmp_path / "log")
    day = F.date_format("ts", "yyyyMMdd")
    for d in sorted(r[0] for r in ev.select(day).distinct().collect()):
        ev.filter(day == d).coalesce(1).write.mode("append").parquet(src)   # files arrive in time order
    out = sm.metric_rollup_stream(spark, src, max_files_per_trigger=1, watermark="1 hour", output_mode="append")
    batch = {(r[0], r[1]): (r[2], r[3]) for r in _rows(sm.metric_rollup(ev))}
    got = _rows(out)
    assert got and all(batch[(w, m)] == (n, s) for w, m, n, s in got)

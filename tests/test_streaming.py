import datetime as dt
import os

from weftwork.operators import collab as CO
from weftwork.streaming import jobs as ST

SCHEMA = "domain string, agent string, ts_ms bigint, event_id bigint"


def _age(folder, k):
    """Files are taken in order of age."""
    for f in folder.iterdir():
        os.utime(f, (1_700_000_000 + k * 60, 1_700_000_000 + k * 60))


def test_leases_over_micro_batches_equal_the_fold(spark, tmp_path):
    rows = [(f"d{i % 3}", f"a{i * 7 % 4}", i * 3, i) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k:20 * k + 20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        _age(tmp_path / "in" / f"p{k}", k)
    src = ST.file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    got = ST.run_to_table(ST.lease_stream(src, 10), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = CO.lease_requests(spark.createDataFrame(rows, SCHEMA), 10)
    key = lambda df: sorted((r.event_id, r.granted, r.owner) for r in df.collect())
    assert key(got) == key(want) and got.select("batch_no").distinct().count() == 3


def test_late_rows_leave_closed_windows(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    batches = [[(t, "a"), (t + dt.timedelta(minutes=5), "a")], [(t + dt.timedelta(hours=9), "a")], [(t + dt.timedelta(hours=10), "a")], [(t, "a"), (t + dt.timedelta(hours=20), "b")], [(t + dt.timedelta(hours=40), "b")]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        _age(tmp_path / "in" / f"p{k}", k)
    src = ST.file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], "ts timestamp, k string").schema, files_per_trigger=1)
    got = ST.run_to_table(ST.windowed_counts(src, "ts", ["k"], "1 hour", "2 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert (t, 2) in {(r.start, r.n) for r in got.collect()}  # the late row does not count


def test_directory_delta(spark):
    now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, "z"), ("c", 1, 9, "y"), ("n", 1, 1, "q")], "path string, size int, modified int, sha256 string")
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "y"), ("d", 1, 1, "w")], "path string, size int, modified int, sha256 string")
    assert {tuple(r) for r in ST.directory_delta(now, old).collect()} == {("b", "modified"), ("d", "deleted"), ("n", "added")}

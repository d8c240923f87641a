from pyspark.sql import functions as F

from tidemark.streaming import events as S


def folder(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    for k in range(2):
        df.filter(F.col("event_id") % 2 == k).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


ROWS = [(1, "2024-01-01 10:00:00", 1, "a", 1.0, None), (2, "2024-01-01 10:10:00", 1, "a", 2.0, None), (3, "2024-01-01 11:00:00", 1, "b", 4.0, None), (4, "2024-01-01 10:05:00", 2, "a", 8.0, None), (2, "2024-01-01 10:10:00", 1, "a", 2.0, None)]


def test_windows(spark, tmp_path):
    found = S.run_to_end(S.windowed(S.stream(spark, folder(spark, tmp_path, ROWS))), f"file://{tmp_path}", "complete")
    assert sorted((r.event_type, r.n, r.total) for r in found.collect()) == [("a", 4, 13.0), ("b", 1, 4.0)]


def test_duplicates(spark, tmp_path):
    found = S.run_to_end(S.deduplicated(S.stream(spark, folder(spark, tmp_path, ROWS)), ["event_id"]), f"file://{tmp_path}")
    assert sorted(r.event_id for r in found.collect()) == [1, 2, 3, 4]


def test_sessions(spark, tmp_path):
    late = [*ROWS, (9, "2024-01-02 00:00:00", 9, "z", 0.0, None)]  # moves the watermark past the others
    found = S.run_to_end(S.sessions(S.stream(spark, folder(spark, tmp_path, late), files_per_trigger=1)), f"file://{tmp_path}")
    assert {(r.user_id, r.n) for r in found.collect()} >= {(2, 1)}

"""Sessions of a stream over restarts: each once, late rows by the watermark, and all of them closed at the end."""

from pyspark.sql import functions as F

from dossierlake.streaming import sessions as streams

KIND = "user string, ts timestamp, value double"


def drop(spark, folder, rows):
    frame = spark.createDataFrame(rows, "user string, at string, value double").select("user", F.to_timestamp("at").alias("ts"), "value")
    frame.write.mode("append").parquet(folder)
    return frame


def test_restarts_late_rows_and_the_end(spark, tmp_path):
    root = f"file://{tmp_path}"
    make = lambda rows: streams.sessions(rows, "user", "ts", "10 minutes", "30 minutes", F.max("value").alias("most"))
    run = lambda schema: streams.run_available(f"{root}/in", schema, make, f"{root}/out", f"{root}/state")
    read = lambda: sorted((r.user or "", r.n, r.most) for r in spark.read.parquet(f"{root}/out").collect())
    day = "2024-05-01 "
    first = drop(spark, f"{root}/in", [("a", day + "10:00:00", 1.0), ("a", day + "10:09:59", 5.0), ("a", day + "10:30:00", 2.0), ("b", day + "11:00:00", 3.0), (None, day + "10:00:00", 4.0), ("a", None, 9.0)])
    run(first.schema)
    assert read() == [("", 1, 4.0), ("a", 2, 5.0)]  # the watermark is 10:30
    run(first.schema)
    assert read() == [("", 1, 4.0), ("a", 2, 5.0)]  # nothing new, nothing twice
    drop(spark, f"{root}/in", [("a", day + "10:35:00", 7.0), ("b", day + "10:00:00", 8.0), ("c", day + "10:25:00", 6.0), ("b", day + "11:00:00", 3.0)])
    everything = spark.read.schema(first.schema).parquet(f"{root}/in")
    streams.closing_row(everything, "user", "ts", "1 hours").write.mode("append").parquet(f"{root}/in")
    run(first.schema)
    # b's row of 10:00 came too late; c's still counted, and a's session at 10:30 was open
    assert read() == sorted([("", 1, 4.0), ("a", 2, 5.0), ("a", 2, 7.0), ("b", 2, 3.0), ("c", 1, 6.0)])


def test_a_table_has_the_sessions_of_its_stream(spark):
    rows = [("a", "2024-05-01 10:00:00", 1.0), ("a", "2024-05-01 10:05:00", 1.0), ("a", "2024-05-01 10:20:00", 1.0), (None, None, 2.0)]
    frame = spark.createDataFrame(rows, "user string, at string, value double").select("user", F.to_timestamp("at").alias("ts"), "value")
    assert sorted(r.n for r in streams.sessions(frame, "user", "ts", "10 minutes", "1 hour").collect()) == [1, 2]
    assert streams.closing_row(frame.limit(0), "user", "ts", "1 hours").count() == 0

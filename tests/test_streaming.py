from quillon.streaming import windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    folder = f"{tmp_path}/in"
    events.repartition(3).write.parquet(folder)
    from pyspark.sql import functions as F

    want = {tuple(r) for r in events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*")).select("window.start", "window.end", "event_type", "count(1)").collect()}
    stream = windows.windowed(windows.read_events(spark, folder, events.schema, 1), "ts", "1 day", "3650 days", "event_type")
    got = {tuple(r) for r in windows.run_once(stream, "windowed", f"{tmp_path}/cp", "complete").collect()}
    assert got == want


def test_sessions(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, at(0)), (1, at(4)), (1, at(20)), (2, at(1))], "u int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.sessions(windows.read_events(spark, f"{tmp_path}/in", "u int, ts timestamp"), "ts", "5 minutes", "1 hour", "u")
    got = sorted((r.u, r.n) for r in windows.run_once(stream, "sessions", f"{tmp_path}/cp", "complete").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]

import datetime as dt

from chunklake.streaming import feed

T0 = dt.datetime(2024, 1, 1, 10)


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, tmp_path, rows, ddl):
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    df.write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    stream = source(spark, tmp_path, [(at(1), "a"), (at(5), "a"), (at(7), "b"), (at(61), "a"), (at(300), "z")], "ts timestamp, kind string")
    rows = {(r["window_start"], r["kind"]): r["n"] for r in run(spark, feed.windowed_counts(stream, "ts", "kind", "1 hour", "10 minutes"), "windows")}
    assert rows == {(T0, "a"): 2, (T0, "b"): 1, (T0 + dt.timedelta(hours=1), "a"): 1}


def test_sessions(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    stream = source(spark, tmp_path, [(at(0), 1), (at(4), 1), (at(30), 1), (at(500), 9)], "ts timestamp, key int")
    rows = sorted((r["key"], r["n"]) for r in run(spark, feed.session_counts(stream, "ts", "key", "10 minutes", "5 minutes"), "sessions"))
    assert rows == [(1, 1), (1, 2)]


def test_first_seen(spark, tmp_path):
    stream = source(spark, tmp_path, [(T0, bytearray(b"a")), (T0, bytearray(b"a")), (T0, bytearray(b"b"))], "ts timestamp, payload binary")
    rows = run(spark, feed.first_seen(stream, "ts", "payload", "1 hour"), "seen")
    assert sorted(bytes(r["payload"]) for r in rows) == [b"a", b"b"]


def test_batch_and_stream_agree(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert feed.windowed_counts(events, "ts", "event_type", "1 hour").groupBy().sum("n").first()[0] == events.count()

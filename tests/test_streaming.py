import datetime as dt

from tidemark.streaming import activity


def test_streamed_days_and_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("h1", "a", t, 1, 0), ("h1", "a", t, 1, 0), ("h2", "a", t + dt.timedelta(minutes=30), 2, 1), ("h3", "b", t + dt.timedelta(days=1), 4, 0)]
    schema = "hash string, author_key string, activity_ts timestamp, insertions long, deletions long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    found = []
    writer = activity.daily(activity.unique_commits(stream), lateness=None).writeStream.outputMode("append")
    writer = writer.foreachBatch(lambda batch, _: found.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/days")
    for late in ([], [("h2", "a", t, 9, 9), ("h4", "c", t + dt.timedelta(days=30), 1, 1)], [("h5", "c", t + dt.timedelta(days=31), 1, 1)]):
        if late:
            spark.createDataFrame(late, schema).write.mode("append").parquet(f"{tmp_path}/in")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.date.day, r.commits, r.additions) for r in found) == [(1, 2, 3), (2, 1, 4)]
    runs = activity.bursts(stream, lateness="1 second").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    runs.awaitTermination()
    assert sorted((r.author_key, r.commits) for r in spark.table("bursts").where("start < '2024-01-05'").collect()) == [("a", 4), ("b", 1)]
    done = activity.replace_partitions(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "author_key").trigger(availableNow=True).start()
    done.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_a_repository_over_two_batches(spark, tmp_path):
    schema = "repo_id long, run_id long, hash string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 1, "c")], [(2, 2, "d")], [(2, 2, "e")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        activity.replace_partitions(stream, f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = activity.latest_runs(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted((r.repo_id, r.hash) for r in got.collect()) == [(1, "a"), (1, "c"), (2, "d"), (2, "e")]

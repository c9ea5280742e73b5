"""Streams against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import chunks, drift
from fieldglass.plans import Tables
from fieldglass.plans.profiling import EVENT_TYPES, daily_mix
from fieldglass.sources import versions
from fieldglass.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def drain(df, name, tmp_path, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()


def test_events_per_second(spark, tmp_path, rows):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    # one far later event moves the watermark past all others
    spark.createDataFrame([("2030-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    drain(jobs.events_per_second(stream, "ts"), "eps", tmp_path)
    want = jobs.events_per_window(events, "ts", "1 second")
    got = spark.table("eps").filter("start < '2030-01-01'")
    assert rows(got) == rows(want)


def test_drift_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = Tables(spark, FOLDER)
    batch = drift.drift_scores(daily_mix(t), ["user_id"], "day", EVENT_TYPES, how="sum")
    want = {(r.user_id, str(r.day)): round(r.score, 9) for r in batch.collect()}
    source = str(tmp_path / "mix")
    mix = daily_mix(t).withColumn("day", F.col("day").cast("timestamp"))
    cut = "2024-01-12"
    mix.filter(F.col("day") < cut).coalesce(1).write.parquet(source)
    mix.filter(F.col("day") >= cut).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(mix.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    drain(jobs.drift_stream(stream, "user_id", "day", EVENT_TYPES), "drift", tmp_path)
    got = {(r.user_id, str(r.day)): round(r.score, 9) for r in spark.table("drift").collect()}
    assert got == want


def test_event_time_drift_of_shuffled_rows_equals_batch(spark, tmp_path):
    """Single events in random order over several batches, within the lateness, give the batch query's scores."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = Tables(spark, FOLDER)
    batch = drift.drift_scores(daily_mix(t), ["user_id"], "day", EVENT_TYPES, how="sum")
    want = {(r.user_id, str(r.day)): round(r.score, 9) for r in batch.collect()}
    one = [F.when(F.col("event_type") == e, 1.0).alias(e) for e in EVENT_TYPES]
    events = t.events.select("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), *one, F.rand(5).alias("_r"))
    source = str(tmp_path / "mix")
    for part in range(3):
        picked = events.filter(F.floor(F.col("_r") * 3) == part).orderBy(F.rand(part)).drop("_r")
        picked.coalesce(1).write.mode("append").parquet(source)
    end = spark.createDataFrame([(-1, "2031-01-01 00:00:00")], "user_id long, day string").withColumn("day", F.col("day").cast("timestamp"))
    end.select(F.col("user_id").cast(events.schema["user_id"].dataType), "day", *[F.lit(1.0).alias(e) for e in EVENT_TYPES]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.drop("_r").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.drift_stream_by_event_time(stream, "user_id", "day", EVENT_TYPES, late="2000 days", keep=timedelta(days=4000))
    drain(out, "event_drift", tmp_path)
    found = spark.table("event_drift").filter("user_id >= 0").collect()
    got = {(r.user_id, str(r.day)): round(r.score, 9) for r in found}
    assert got == want and len(found) == len(want)


@pytest.mark.parametrize("method", ["jensenshannon", "euclidean", "wasserstein"])
def test_event_time_drift_forgets_and_drops(spark, tmp_path, method):
    """A gap over ``keep`` starts anew, a row behind the watermark is dropped, a step without mass becomes the baseline."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    schema = "k string, t timestamp, a double, b double"

    def put(*rows):
        frame = spark.createDataFrame([(k, datetime.fromisoformat(t), a, b) for k, t, a, b in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        out = jobs.drift_stream_by_event_time(stream, "k", "t", ["a", "b"], method, late="1 day", keep=timedelta(days=10))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()

    put(("x", "2024-01-02", 0.0, 2.0), ("x", "2024-01-01", 1.0, None), ("x", "2024-01-02", 2.0, 0.0), ("x", "2024-01-03", 0.0, 0.0), ("x", "2024-01-04", 1.0, 1.0))
    run()
    put(("z", "2024-02-01", 1.0, 1.0))
    run()
    put(("x", "2024-01-02", 9.0, 0.0), ("x", "2024-02-02", 0.0, 1.0), ("x", "2024-02-03", 1.0, 0.0))
    run()
    put(("z", "2024-06-01", 1.0, 1.0))
    run()
    got = {(r.k, str(r.t.date())): r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    score = lambda p, q: jobs._score(p, q, method)
    want = {
        ("x", "2024-01-01"): 0.0, ("x", "2024-01-02"): score([0.5, 0.5], [1.0, 0.0]), ("x", "2024-01-03"): 0.0, ("x", "2024-01-04"): 0.0,
        ("z", "2024-02-01"): 0.0, ("x", "2024-02-02"): 0.0, ("x", "2024-02-03"): score([1.0, 0.0], [0.0, 1.0]),
    }
    assert {k: round(v, 12) for k, v in got.items()} == {k: round(v, 12) for k, v in want.items()}


def test_ingest_again_changes_nothing(spark, tmp_path, rows):
    source, target = str(tmp_path / "docs"), str(tmp_path / "chunks")
    schema = "id string, doc_type string, text string"
    spark.createDataFrame([("a", "mop", "one two three"), ("b", "mop", "four")], schema).coalesce(1).write.parquet(source)
    chunker = lambda df: chunks.chunk_fixed(df, "id", "mop", size=2)

    def run(name):
        stream = spark.readStream.schema(schema).parquet(source)
        q = jobs.ingest_documents(stream, chunker, target, str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()

    run("c1")
    first = rows(versions.read_live(spark, target, "source_doc"), "source_doc", "text")
    assert first == [("a", "one two"), ("a", "three"), ("b", "four")]
    run("c2")
    assert rows(versions.read_live(spark, target, "source_doc"), "source_doc", "text") == first
    spark.createDataFrame([("a", "mop", "new")], schema).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    assert rows(versions.read_live(spark, target, "source_doc"), "source_doc", "text") == [("a", "new"), ("b", "four")]

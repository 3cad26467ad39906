"""Streams of shuffled micro-batches against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shopspark.operators import drawing
from shopspark.streaming import events, replay

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, rows, schema, build, name):
    """The rows in five files in another order, some twice, then two that only move the watermark; all results."""
    r = random.Random(3)
    rows = rows + r.sample(rows, len(rows) // 5)
    r.shuffle(rows)
    end = [(-1, 10**6 + i, BEGIN + dt.timedelta(days=9 + i), None, None) for i in range(2)]
    for i, part in enumerate([*[rows[k::5] for k in range(5)], end[:1], end[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"batch={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_status_stream_equals_batch(rocks, tmp_path):
    r = random.Random(7)
    rows = [(p, 100 * p + i, BEGIN + dt.timedelta(minutes=r.randrange(60)), r.choice(events.STATES), None) for p in range(5) for i in range(12)]
    schema = "plan_id long, event_id long, ts timestamp, to_status string, extra string"
    out = streamed(rocks, tmp_path, rows, schema, lambda s: replay.status_stream(s, "1 hour"), "status_rows")
    want = events.replay(rocks.createDataFrame(rows, schema).drop("extra"))
    assert sorted(map(tuple, out.filter("plan_id >= 0").collect())) == sorted(map(tuple, want.select("plan_id", "event_id", "from_status", "to_status", "legal").collect()))


def test_link_stream_equals_batch(rocks, tmp_path):
    r = random.Random(8)
    actions = ["confirm", "confirm", "reassign", "mark_drawing_only", "comment"]
    rows = [(p, 100 * p + i, BEGIN + dt.timedelta(minutes=r.randrange(60)), r.choice(actions), r.choice([1, 2, None])) for p in range(12) for i in range(r.randrange(1, 6))]
    schema = "requirement_id long, event_id long, ts timestamp, action string, feature_id long"
    out = streamed(rocks, tmp_path, rows, schema, lambda s: replay.link_stream(s, "1 hour"), "link_rows")
    when = rocks.createDataFrame(rows, schema).select("event_id", "ts")
    last = out.join(when, "event_id").groupBy("requirement_id").agg(F.max_by(F.struct("feature_id", "status"), F.struct("ts", "event_id")).alias("x")).select("requirement_id", "x.*")
    assert sorted(map(repr, map(tuple, last.collect()))) == sorted(map(repr, map(tuple, drawing.link_state(rocks.createDataFrame(rows, schema)).collect())))

"""Stateful first-seen over several batches and a restart."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from newsgauge.streaming import first_seen


def test_first_late_and_silent_rows(spark, tmp_path):
    first_seen.use_state_store(spark)
    day = lambda d: dt.datetime(2026, 7, d)

    def batch(*rows):
        spark.createDataFrame(list(rows), "k string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = first_seen.first_seen(spark.readStream.schema("k string, at timestamp").parquet(f"{tmp_path}/in"), "k", "at")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True)
        query.start(f"{tmp_path}/out").awaitTermination()
        return sorted((r["key"], r["at"].day, r["kind"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert batch(("a", day(5)), ("a", day(3)), ("b", day(9)), (None, day(1)), ("c", None)) == [("a", 3, "first"), ("b", 9, "first")]
    # the query is started anew: state comes from the checkpoint
    assert batch(("a", day(2)), ("a", day(4)), ("b", day(9)), ("c", day(1))) == [("a", 2, "late"), ("a", 3, "first"), ("b", 9, "first"), ("c", 1, "first")]


class Store:
    """A value that counts how often it is asked for and written."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_keys_of_a_bucket_share_the_calls_of_the_store():
    told = first_seen.FirstSeen(ttl_ms=100)
    told.seen = Store()
    batch = lambda now, *rows: [tuple(r) for r in told.handleInputRows((0,), iter([Row(key=k, at=at) for k, at in rows]), Clock(now))]
    assert batch(0, *[(f"k{i % 500}", i) for i in range(2_000)]) == [(f"k{i}", i, "first") for i in range(500)]
    assert told.seen.calls == 2
    assert batch(60, ("k7", 3), ("k7", 9), ("new", 5)) == [("k7", 3, "late"), ("new", 5, "first")]
    # only what was heard of within the time to live is still known
    assert batch(120, ("k7", 4), ("k8", 1)) == [("k7", 4, "late"), ("k8", 1, "first")]
    assert sorted(told.seen.value[0]) == ["k7", "k8", "new"] and told.seen.calls == 6

"""First-seen mentions with state: what is new is told by a keyed state store, not by joining a table each batch.

Each key keeps when it was first seen. Its first row comes out as ``first``; a row of a later batch that is dated
before that is ``late`` (stored, not alerted); all others are silent. State of a key that nothing was
heard of for the time to live is dropped, so the store holds the keys of a window and not of all
time; a key that is heard again after that is new again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Rows of one bucket of keys: (bucket, key, at in microseconds). Emits (key, at, kind).

    Every call of the store goes from Python to the JVM and back, so one get and one update serve all keys of a bucket.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "keys array<string>, firsts array<bigint>, heard array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.seen.get()
        alive = {k: (first, heard) for k, first, heard in zip(*held, strict=True) if self.ttl_ms is None or now - heard < self.ttl_ms} if held else {}
        least: dict[str, int] = {}
        for row in rows:
            of, at = row["key"], row["at"]
            if of in alive and at < alive[of][0]:
                yield Row(key=of, at=at, kind="late")
            least[of] = min(at, least.get(of, at))
        for of, at in least.items():
            if of not in alive:
                yield Row(key=of, at=at, kind="first")
            alive[of] = (alive[of][0] if of in alive else at, now)  # heard of again: the time to live starts anew
        self.seen.update((list(alive), [first for first, _ in alive.values()], [heard for _, heard in alive.values()]))

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, at: str, ttl_days: int | None = 120, buckets: int = 16_384) -> DataFrame:
    """key, at, kind of a stream: the first sighting of each key, and rows that came later but are dated earlier.

    Rows without a key or a date are left out. Needs use_state_store on the session. State is kept by bucket of
    a key's hash: a batch rewrites the buckets that it touches, and ``buckets`` stays as it is for a checkpoint.
    """
    given = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).dropna()
    ttl = None if ttl_days is None else ttl_days * 86_400_000
    told = given.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithState(
        statefulProcessor=FirstSeen(ttl), outputStructType="key string, at bigint, kind string", outputMode="Append", timeMode="ProcessingTime"
    )
    return told.select("key", F.timestamp_micros("at").alias("at"), "kind")


def use_state_store(spark: SparkSession) -> None:
    """State on local disk with changes in the checkpoint, so that it may outgrow memory and outlive an executor.

    Batches without rows are not run: a clock-driven operator would ask for them for ever, and an availableNow
    query would not end. Old state goes when the next rows come.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

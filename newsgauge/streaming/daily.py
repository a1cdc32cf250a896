"""The daily check as a micro-batch stream: first-seen mentions, kept tables, alerts at least once.

An ``availableNow`` stream over the landed mentions replaces the scheduled job: its
checkpoint is the single-writer lock and remembers which files were read. Whether a
mention is new is decided against the key table, not by a clock; late articles are
stored and not alerted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.operators.alerts import Sink, candidates, dispatch
from newsgauge.operators.ledger import Keyed, Ledger

def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="newsgauge-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


SENT = "id string, run_id string, mention_id string, channel string, sent_at timestamp, payload string"


def run_daily(
    spark: SparkSession,
    landed: str,
    schema: str,
    to_mentions: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    companies: DataFrame,
    root: str,
    sinks: dict[str, Sink],
    now: Column,
    mention_schema: str,
    article_schema: str,
    lookback_hours: int = 48,
    only_new: bool = False,
    dry_run: bool = False,
) -> list[dict]:
    """Read what has landed since the last run and alert on it; one summary row for each channel and batch.

    to_mentions turns raw rows into (mentions, articles), keyed by id and article_id.
    root holds the tables and the stream's checkpoint. only_new limits alerts to mentions
    of this batch; by default whatever is recent and not recorded is offered again.

    A batch's mentions and articles become visible together, marked with its number, and its mentions
    carry it: a batch that comes again after a failure writes nothing and alerts on the same mentions. What
    was sent is recorded in a second step, so a failure between the two offers an alert again.
    """
    books = ledger(spark, root, mention_schema, article_schema)
    said: list[dict] = []

    def batch(rows: DataFrame, number: int) -> None:
        if (books.mark("batch") if books.mark("batch") is not None else -1) < number:
            found, their = to_mentions(rows)
            commit = books.begin()
            commit.insert("mentions", found.withColumn("batch", F.lit(number)))
            commit.insert("articles", their)
            for name in ("mentions", "articles"):
                commit.compact(name)
            commit.publish(batch=number)
        mentions = books.read("mentions")
        new = mentions.where(F.col("batch") == number).select("id")
        due = candidates(mentions, books.read("articles"), companies, now, lookback_hours, new if only_new else None)
        record, summary = dispatch(due, books.read("sent"), sinks, f"batch-{number}", now, dry_run)
        if not dry_run:
            commit = books.begin()
            commit.insert("sent", record)
            commit.compact("sent")
            commit.publish()
        fresh = new.count()
        said.extend(r.asDict() | {"new_mentions": fresh} for r in summary.collect())  # one row a channel

    stream = spark.readStream.schema(schema).parquet(landed)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return said


def ledger(spark: SparkSession, root: str, mention_schema: str, article_schema: str, buckets: int = 64) -> Ledger:
    """The tables of the daily check."""
    return Ledger(spark, f"{root}/tables", {
        "mentions": Keyed(f"{mention_schema}, batch bigint", ("id",), buckets), "articles": Keyed(article_schema, ("article_id",), buckets),
        "sent": Keyed(SENT, ("mention_id", "channel"), buckets),
    })


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Counts by tumbling window and key with a watermark; for batch and stream alike."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, lateness)
    out = timed.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "n")

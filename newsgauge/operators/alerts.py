"""Alerts: candidates, delivery to sinks, and the record that keeps a channel from hearing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsgauge.functions.text import alert_id, alert_line

from .linking import stored
from .persist import pending_alerts


def candidates(
    mentions: DataFrame, articles: DataFrame, companies: DataFrame, now: Column, lookback_hours: int = 48, only: DataFrame | None = None
) -> DataFrame:
    """Relevant mentions of recent articles. ``only`` limits them to given mention ids (those a run created).

    Without ``only`` a mention whose delivery failed is a candidate until it is recorded
    or too old; with it, only what the run saw first is.
    """
    found = mentions.where("relevant")
    if only is not None:
        found = found.join(only.select(F.col("id")), "id", "left_semi")
    recent = now.cast("timestamp") - F.make_dt_interval(hours=F.lit(lookback_hours))
    fresh = articles.where(F.col("published_at").isNotNull() & (F.col("published_at") >= recent))
    joined = found.join(fresh, "article_id").join(companies.select("company_id", F.col("name").alias("company")), "company_id")
    return joined.select(
        F.col("id").alias("mention_id"), "company_id", "company", "article_id", "title", "url", "published_at", "sentiment",
        alert_line(F.col("published_at").cast("string"), F.col("sentiment"), F.col("company"), F.col("title")).alias("line"),
    )


#: Sends the pending alerts of one channel and returns how many went out; raises if none could.
Sink = Callable[[DataFrame], int]


def json_sink(path: str) -> Sink:
    def send(alerts: DataFrame) -> int:
        sent = Observation()
        alerts.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
        return sent.get["n"]  # counted by the write itself

    return send


def console_sink(out: Callable[[str], None]) -> Sink:
    """The candidates' lines, newest first, to out one by one; the driver holds one partition of them at a time."""

    def send(alerts: DataFrame) -> int:
        n = 0
        for row in alerts.orderBy(F.col("published_at").desc_nulls_last()).select("line").toLocalIterator():
            out(row["line"])
            n += 1
        return n

    return send


def dispatch(alerts: DataFrame, sent: DataFrame, sinks: dict[str, Sink], run_id: str, now: Column, dry_run: bool = False):
    """(rows to append to the sent table, summary by channel).

    Rows are recorded only after their sink has succeeded, all of a channel's pending rows
    together; a failing sink records nothing and does not stop the others. A dry run
    computes the candidates and neither sends nor records.
    """
    offered = Observation()
    every = alerts.observe(offered, F.count(F.lit(1)).alias("n"))
    due = stored(pending_alerts(every, sent, list(sinks)), "due")  # written once; candidates are counted on the way
    pending = {r[0]: r[1] for r in due.groupBy("channel").count().collect()}  # a row a channel
    done, summary, total = [], [], offered.get["n"]
    for channel, send in sinks.items():
        n = pending.get(channel, 0)
        row = {"channel": channel, "candidates": total, "delivered": 0, "skipped": total - n, "failed": 0, "outcome": "nothing-new"}
        if n and dry_run:
            row["outcome"] = "dry-run"
        elif n:
            try:
                row |= {"delivered": send(due.where(F.col("channel") == channel).drop("channel")), "outcome": "sent"}
                done.append(channel) if row["delivered"] else None
            except Exception as problem:  # a sink is outside code: its failure is its own
                row |= {"failed": n, "outcome": f"failed: {problem}"[:200]}
        summary.append(row)
    record = due.where(F.col("channel").isin(*done) if done else F.lit(False)).select(
        alert_id("mention_id", "channel").alias("id"), F.lit(run_id).alias("run_id"), "mention_id", "channel",
        now.cast("timestamp").alias("sent_at"), F.to_json(F.struct("company", "title", "url", "sentiment")).alias("payload"),
    )
    schema = "channel string, candidates long, delivered long, skipped long, failed long, outcome string"
    return record, alerts.sparkSession.createDataFrame([tuple(r.values()) for r in summary], schema)

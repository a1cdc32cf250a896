"""Tables by bucket under one manifest: what a write touches, what a failure leaves, what a batch that comes again does."""

import os

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import alerts
from newsgauge.operators.ledger import Commit, Keyed, Ledger
from newsgauge.streaming import daily

TABLES = {"a": Keyed("id long, v string, first string", ("id",), 8), "b": Keyed("x string, y int", ("x", "y"), 4)}


def files(root, name):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/{name}") for f in names if f.endswith(".parquet")}


def rows(spark, ids, v):
    return spark.createDataFrame([(i, v, v) for i in ids], "id long, v string, first string")


def test_writes_touch_their_buckets_only(spark, tmp_path):
    books = Ledger(spark, str(tmp_path), TABLES)
    assert books.read("a").count() == 0 and books.table("a").insert(rows(spark, range(200), "x")).count() == 200
    before = files(tmp_path, "a")
    assert len(before) == 8
    assert books.table("a").insert(rows(spark, [1, 2, 500], "y")).count() == 1  # two are there already
    added = files(tmp_path, "a") - before
    assert len(added) == 1 and before <= files(tmp_path, "a")
    held = books.manifest()["tables"]["a"]
    books.table("a").upsert(rows(spark, [7], "z"), keep=("first",))
    now = books.manifest()["tables"]["a"]
    assert sum(now[b] != held[b] for b in now) == 1 and now.keys() == held.keys()
    got = {r["id"]: (r["v"], r["first"]) for r in books.read("a").collect()}
    assert len(got) == 201 and got[7] == ("z", "x") and got[500] == ("y", "y") and got[1] == ("x", "x")
    assert books.vacuum() == 1 and len(books.read("a").collect()) == 201


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    books = Ledger(spark, str(tmp_path), TABLES)
    commit = books.begin()
    commit.insert("a", rows(spark, [1], "x"))
    commit.insert("b", spark.createDataFrame([("p", 1), ("p", 1), (None, 2)], "x string, y int"))
    assert books.read("a").count() == books.read("b").count() == 0
    commit.publish(batch=3)
    assert books.read("a").count() == 1 and books.read("b").count() == 2 and books.mark("batch") == 3


def test_compaction_keeps_rows(spark, tmp_path):
    books = Ledger(spark, str(tmp_path), {"a": Keyed("id long, v string, first string", ("id",), 1)})
    for k in range(4):
        books.table("a").insert(rows(spark, [k], "x"))
    commit = books.begin()
    commit.compact("a", 2)
    commit.publish()
    assert [len(f) for f in books.manifest()["tables"]["a"].values()] == [1] and books.read("a").count() == 4


MENTION = "id string, company_id long, article_id string, relevant boolean, sentiment string"
ARTICLE = "article_id string, published_at timestamp, title string, url string"
NOW = "2026-08-01 12:00:00"


@pytest.mark.parametrize("fails_at", ["insert-2", "publish-1", "send-1", "publish-2"])
def test_a_batch_that_fails_and_comes_again_alerts_on_the_same(spark, tmp_path, monkeypatch, fails_at):
    """A kill between two tables, before the manifest, while sending or before what was sent is recorded."""
    spark.createDataFrame([("m1",), ("m2",)], "id string").write.parquet(f"{tmp_path}/landed")
    companies = spark.createDataFrame([(7, "Acme")], "company_id long, name string")
    sent: list[str] = []
    calls = {"insert": 0, "publish": 0, "send": 0}

    def failing(name, real):
        def run(*args, **more):
            calls[name] += 1
            if f"{name}-{calls[name]}" == fails_at:
                raise RuntimeError("killed")
            return real(*args, **more)

        return run

    for name in ("insert", "publish"):
        monkeypatch.setattr(Commit, name, failing(name, getattr(Commit, name)))

    monkeypatch.setattr(daily, "dispatch", failing("send", daily.dispatch))

    def sink(due):
        sent.extend(r["mention_id"] for r in due.collect())
        return due.count()

    def to_mentions(raw):
        m = raw.select("id", F.lit(7).cast("long").alias("company_id"), F.concat(F.lit("a"), "id").alias("article_id"), F.lit(True).alias("relevant"), F.lit("neutral").alias("sentiment"))
        at = F.lit(NOW).cast("timestamp")
        return m, m.select("article_id", at.alias("published_at"), F.lit("t").alias("title"), F.lit("u").alias("url"))

    def go():
        return daily.run_daily(
            spark, f"{tmp_path}/landed", "id string", to_mentions, companies, f"{tmp_path}/root", {"log": sink}, F.lit(NOW).cast("timestamp"), MENTION, ARTICLE, only_new=True
        )

    with pytest.raises(Exception):  # noqa: B017
        go()
    said = go()
    assert [(r["new_mentions"], r["delivered"], r["outcome"]) for r in said] == [(2, 2, "sent")]
    assert set(sent) == {"m1", "m2"} and len(sent) == (4 if fails_at == "publish-2" else 2)
    books = daily.ledger(spark, f"{tmp_path}/root", MENTION, ARTICLE)
    assert books.read("mentions").count() == books.read("sent").count() == 2 and books.mark("batch") == 0
    assert go() == []


def test_json_sink_counts_without_reading_again(spark, tmp_path):
    due = spark.range(7)
    assert alerts.json_sink(f"{tmp_path}/out")(due) == 7 and spark.read.json(f"{tmp_path}/out").count() == 7

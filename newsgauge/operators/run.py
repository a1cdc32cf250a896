"""A whole run: collect, write what is pending, classify, write the answers; and taking a run up again.

What is pending is written before the model is asked, so a run that stops loses no
article, and classify_waiting goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions.text import mention_id

from .classify import Model, classify, rejections, results
from .collect import collect, collection_totals
from .ledger import Keyed, Ledger
from .linking import stored
from .persist import Table, set_state

MENTIONS = (
    "id string, company_id {0}, article_id string, relevant boolean, rejection_reason string, sentiment string, "
    "confidence double, rationale string, evidence string, model string, prompt_version string, classified_at timestamp"
)
ARTICLES = "article_id string, url string, title string, source_name string, published_at timestamp"
RUNS = "id string, started_at timestamp, finished_at timestamp, status string, companies long, articles long, with_no_coverage long, failed long"


class Store:
    """The tables of a run below one folder; one manifest names them all."""

    def __init__(self, spark: SparkSession, folder: str, company_type: str = "bigint", buckets: int = 64):
        self.ledger = Ledger(spark, folder, {
            "mentions": Keyed(MENTIONS.format(company_type), ("id",), buckets), "articles": Keyed(ARTICLES, ("article_id",), buckets),
            "cache": Keyed("key string, raw string", ("key",), buckets), "runs": Keyed(RUNS, ("id",), 1),
        })
        self.mentions, self.articles, self.runs, self.cache = (self.ledger.table(n) for n in ("mentions", "articles", "runs", "cache"))
        self.state = Table(spark, f"{folder}/state", "key string, value string")


def write_pending(store: Store, kept: DataFrame, rejected: DataFrame, now: Column) -> None:
    """Articles, mentions that wait for the model, and rejected ones with their reason; what is there already stays."""
    named = lambda rows: rows.withColumnRenamed("id", "article_id").withColumn("id", mention_id("company_id", "article_id"))
    kept, rejected = named(kept), named(rejected)
    seen = kept.unionByName(rejected).drop("url").withColumnRenamed("canonical_url", "url")
    waiting = kept.select("id", "company_id", "article_id")
    commit = store.ledger.begin()
    commit.insert("articles", seen)
    commit.insert("mentions", waiting.unionByName(rejections(rejected, now), allowMissingColumns=True))
    commit.publish()


def classify_waiting(store: Store, companies: DataFrame, model: Model, name: str, prompt_version: str, now: Column) -> DataFrame:
    """Ask the model about mentions without an answer and write what it said. Returns one row: waiting, lost, answered.

    A mention whose company or article is missing is counted as lost and stays pending.
    """
    waiting = store.mentions.read().where("classified_at IS NULL").select("id", "company_id", "article_id")
    known = companies.select("company_id", F.col("name").alias("company"), "sector", "aliases", "negative_keywords")
    full = waiting.join(known, "company_id", "left").join(store.articles.read().select("article_id", "title"), "article_id", "left")
    counts = full.agg(F.count("*").alias("waiting"), F.count_if(F.col("company").isNull() | F.col("title").isNull()).alias("lost")).first()
    asked = full.where("company IS NOT NULL AND title IS NOT NULL")
    done, fresh = classify(asked, store.cache.read(), model, name, prompt_version)
    said = stored(results(done, name, prompt_version, now), "results")
    commit = store.ledger.begin()
    commit.upsert("mentions", said)
    commit.insert("cache", fresh)
    commit.publish()
    return companies.sparkSession.createDataFrame([(*counts, said.count())], "waiting long, lost long, answered long")


def run_pipeline(
    raw: DataFrame, companies: DataFrame, calls: DataFrame, store: Store, model: Model, name: str, prompt_version: str,
    run_id: str, now: Column, most: int = 25,
) -> DataFrame:
    """One run from raw items to answered mentions; returns its counts by company (see collect).

    The run is recorded as running and, at its end, as completed or failed (failed if every
    company failed). State ``watermark`` then holds the start of a completed run, for audit only.
    """
    spark = raw.sparkSession
    started = spark.range(1).select(F.lit(run_id).alias("id"), now.cast("timestamp").alias("started_at"), F.lit("running").alias("status"))
    store.runs.upsert(started)
    kept, rejected, stats = collect(raw, companies, calls, most)
    write_pending(store, kept, rejected, now)
    classify_waiting(store, companies, model, name, prompt_version, now)
    state = F.when(F.col("failed") == F.col("companies"), "failed").otherwise("completed")
    ended = collection_totals(stats, most).select(
        F.lit(run_id).alias("id"), "*", now.cast("timestamp").alias("finished_at"), state.alias("status")
    )
    store.runs.upsert(ended, ("started_at",))
    last = store.runs.read().where(F.col("id") == run_id).select("status", F.col("started_at").cast("string")).first()
    if last[0] == "completed":
        set_state(store.state, {"watermark": last[1]})
    return stats

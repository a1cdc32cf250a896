"""Collection for all companies at once: normalise, de-duplicate, pre-filter, keep the newest, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.text import article_id
from newsgauge.functions.urls import BLOCKED_DOMAINS

from .linking import stored
from .normalize import normalize_items, recency_cap, remaining_items
from .prefilter import prefilter, prefilter_stats

CALL_STATES = ("ok", "failed", "skipped")


def collect(
    raw: DataFrame, companies: DataFrame, calls: DataFrame, most: int = 25, blocked: tuple[str, ...] = BLOCKED_DOMAINS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles within the budget, rejected articles with their verdict, one row of counts for each company).

    raw: company_id, position (unique), url, title, snippet, source_name, published_at. calls:
    company_id, provider, status, one row for each source that was asked. The newest ``most``
    articles of a company stay, whatever order the sources returned them in.
    """
    made = stored(normalize_items(raw).drop("id"), "normalized")
    left = remaining_items(made.where("skip_reason IS NULL").drop("skip_reason"), "company_id", "canonical_url")
    judged = stored(prefilter(left.withColumn("id", article_id("canonical_url")), companies, blocked), "judged")
    newest = recency_cap(judged.where("verdict.keep"), "company_id", "published_at", "position", most)
    return newest, judged.where("NOT verdict.keep"), collection_stats(companies, made, judged, calls, most)


def collection_stats(companies: DataFrame, made: DataFrame, judged: DataFrame, calls: DataFrame, most: int) -> DataFrame:
    """fetched, normalized, deduped, kept, capped and the outcomes of calls by company; zeros where nothing came."""
    came = made.groupBy("company_id").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("skip_reason").isNull()).alias("normalized")
    )
    passed = judged.groupBy("company_id").agg(F.count("*").alias("deduped"), F.count_if(F.col("verdict.keep")).alias("kept"))
    asked = calls.groupBy("company_id").agg(*[F.count_if(F.col("status") == s).alias(f"providers_{s}") for s in CALL_STATES])
    out = companies.select("company_id")
    for part in (came, passed, asked):
        out = out.join(part, "company_id", "left")
    return out.fillna(0).withColumn("capped", F.greatest(F.col("kept") - most, F.lit(0)))


def collection_totals(stats: DataFrame, most: int = 25) -> DataFrame:
    """One row for a run: companies, articles within the budget, companies without any, companies that failed.

    A company failed if sources were asked and none answered.
    """
    taken = F.least(F.col("kept"), F.lit(most))
    failed = (F.col("providers_ok") == 0) & (F.col("providers_failed") + F.col("providers_skipped") > 0)
    return stats.agg(
        F.count("*").alias("companies"), F.coalesce(F.sum(taken), F.lit(0)).alias("articles"),
        F.count_if(taken == 0).alias("with_no_coverage"), F.count_if(failed).alias("failed"),
    )


def company_outcomes(companies: DataFrame, calls: DataFrame, kept: DataFrame) -> DataFrame:
    """company_id, kept, providers_ok, warnings, error: what went wrong is a column of the company, never the end of a run.

    calls: company_id, provider, status, detail. kept: company_id, kept. warnings name each source that did not
    answer with its least detail (its status where there is none), in order of source; they are the error of a
    company of which no source answered. A company that was not asked about has neither.
    """
    ok, said = F.col("status") == "ok", F.coalesce("detail", "status")
    each = calls.groupBy("company_id", "provider").agg(F.count_if(ok).alias("ok"), F.min(F.when(~ok, said)).alias("said"))
    line = F.when(F.col("said").isNotNull(), F.concat(F.coalesce("provider", F.lit("")), F.lit(": "), "said"))
    asked = each.groupBy("company_id").agg(  # a row a source
        F.sum("ok").alias("providers_ok"), F.nullif(F.array_join(F.array_sort(F.collect_list(line)), "; "), F.lit("")).alias("warnings")
    )
    out = companies.select("company_id").join(kept.select("company_id", "kept"), "company_id", "left").join(asked, "company_id", "left")
    return out.fillna(0, ["kept", "providers_ok"]).withColumn("error", F.when(F.col("providers_ok") == 0, F.col("warnings")))


def audit_rows(companies: DataFrame, judged: DataFrame, failed: DataFrame) -> DataFrame:
    """name, ambiguity, fetched, kept, reasons of every company; -1 and no reasons for those in failed (company_id)."""
    counted = prefilter_stats(judged, "company_id")
    names = [c for c in counted.columns if c not in ("company_id", "received")]
    reasons = F.create_map(*[x for c in names for x in (F.lit(c), F.coalesce(c, F.lit(0)))])
    lost = failed.select("company_id").distinct().withColumn("lost", F.lit(True))
    every = companies.select("company_id", "name", "ambiguity").join(counted, "company_id", "left").join(lost, "company_id", "left")
    number = lambda c: F.when(F.col("lost"), -1).otherwise(F.coalesce(c, F.lit(0)))
    return every.select(
        "company_id", "name", "ambiguity", number("received").alias("fetched"), number("kept").alias("kept"),
        F.when(F.col("lost").isNull(), reasons).otherwise(F.create_map().cast("map<string,bigint>")).alias("reasons"),
    )

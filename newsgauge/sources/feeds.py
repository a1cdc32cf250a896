"""Landed feed payloads as raw items: JSON corpora, JSON article lists, RSS, seed lists, registries.

Every reader returns RAW: url, title, snippet, source_name, published_at, language,
provider, position. A window and a limit are applied again after reading, whatever the
source was asked for. position is the order of arrival within the provider.
"""

from __future__ import annotations

import math
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import compact_stamp, format_stamp, mail_date, relative_or_iso
from newsgauge.functions.query_language import compile_query
from newsgauge.functions.text import text_or_empty
from newsgauge.functions.urls import host

RAW = ("url", "title", "snippet", "source_name", "published_at", "language", "provider")
#: Languages as the article list names them.
LANGUAGES = {
    "english": "en", "hebrew": "he", "spanish": "es", "french": "fr", "german": "de", "portuguese": "pt", "italian": "it",
    "dutch": "nl", "russian": "ru", "chinese": "zh", "japanese": "ja", "korean": "ko", "arabic": "ar",
}


def window(items: DataFrame, since: Column, until: Column, closed: bool) -> DataFrame:
    """Dated items from since on, up to until: included if closed."""
    at = F.col("published_at")
    return items.where((at >= since) & ((at <= until) if closed else (at < until)))


def newest(items: DataFrame, most: int) -> DataFrame:
    return items.orderBy(F.desc("published_at"), "url").limit(max(0, most))


CORPUS = (
    "items ARRAY<STRUCT<url: STRING, title: STRING, snippet: STRING, sourceName: STRING, publishedAt: STRING, language: STRING>>"
)


def corpus(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """An offline JSON corpus; relative dates count from now. A malformed file fails."""
    rows = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    item = rows.select(F.explode("items").alias("i")).select("i.*")
    return item.select(
        "url", "title", "snippet", F.col("sourceName").alias("source_name"),
        relative_or_iso("publishedAt", now).alias("published_at"), "language", F.lit("corpus").alias("provider"),
    )


def search_corpus(items: DataFrame, query: str, since: Column, until: Column, most: int) -> DataFrame:
    text = F.trim(F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("snippet")))
    return newest(window(items.where(compile_query(query, text)), since, until, closed=False), most)


ARTICLE_LIST = (
    "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, language: STRING>>"
)


def article_list(payloads: DataFrame, body: str = "value") -> DataFrame:
    """JSON bodies with an array of articles; a body without one is no item, incomplete articles are skipped."""
    item = payloads.select(F.from_json(body, ARTICLE_LIST).alias("b")).select(F.explode("b.articles").alias("a"))
    name = F.trim("a.language")
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    made = item.select(
        "a.url", F.trim("a.title").alias("title"), F.lit(None).cast("string").alias("snippet"),
        F.col("a.domain").alias("source_name"), compact_stamp("a.seendate").alias("published_at"),
        F.coalesce(F.try_element_at(codes, F.lower(name)), name).alias("language"), F.lit("article-list").alias("provider"),
    )
    return made.where("url <> '' AND title <> '' AND published_at IS NOT NULL")


def article_list_request(query: Column, since: Column, until: Column, most: int) -> Column:
    """The request's parameters; the limit is kept within 1 and 250."""
    fixed = urlencode({"mode": "ArtList", "format": "json", "sort": "DateDesc", "maxrecords": min(250, max(1, most))})
    return F.concat(
        F.lit(f"{fixed}&query="), F.url_encode(query), F.lit("&startdatetime="), format_stamp(since),
        F.lit("&enddatetime="), format_stamp(until),
    )


RSS_ITEM = (
    "title STRING, link STRING, guid STRING, pubDate STRING, description STRING, "
    "source STRUCT<_url: STRING, _VALUE: STRING>"
)


def rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS files by the built-in XML reader; none, one or many items. Items without title, link or date are skipped."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    publisher = F.trim("source._VALUE")
    ending = F.concat(F.lit(" - "), publisher)
    title = F.trim("title")
    bare = F.when(title.endswith(ending), F.substr(title, F.lit(1), F.length(title) - F.length(ending))).otherwise(title)
    made = raw.select(
        F.trim("link").alias("url"), F.trim(F.coalesce(bare, title)).alias("title"), F.lit(None).cast("string").alias("snippet"),
        F.coalesce(host("source._url"), publisher).alias("source_name"), mail_date("pubDate").alias("published_at"),
        F.lit(None).cast("string").alias("language"), F.lit("rss").alias("provider"),
    )
    return made.where("url <> '' AND title <> '' AND published_at IS NOT NULL")


def rss_query(query: str, since_days: float) -> str:
    """The search text of an RSS request: the query within so many days, at least one."""
    if not since_days > 0:
        raise ValueError("the window must have a length")
    return f"{query} when:{max(1, math.ceil(since_days))}d"


def seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, position: lines of one small text file in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("position", "value"))


REGISTRY = (
    "id STRING, name STRING, slug STRING, aliases ARRAY<STRING>, domain STRING, sector STRING, ambiguity STRING, "
    "volume STRING, query STRING, negativeKeywords ARRAY<STRING>, querySource STRING, enrichedBy STRING, enrichedAt STRING"
)
TRIAGE = "idx INT, name STRING, tier STRING, volume STRING, reason STRING, query STRING, neg STRING, sector STRING"


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def combine(sources: list[DataFrame]) -> DataFrame:
    """Bag union of sources in their configured order, with provider_rank and a position over all of them.

    Arrival is by rank, then newest first, then URL. Where there is a company_id, position
    numbers it within each company; else it grows along a range sort, with gaps, so that no
    window holds everything.
    """
    ranked = [s.withColumn("provider_rank", F.lit(i)) for i, s in enumerate(sources)]
    whole = ranked[0]
    for s in ranked[1:]:
        whole = whole.unionByName(s)
    order = ["provider_rank", F.desc_nulls_last("published_at"), "url", "title"]
    if "company_id" not in whole.columns:
        return whole.orderBy(*order).withColumn("position", F.monotonically_increasing_id())
    return whole.withColumn("position", F.row_number().over(Window.partitionBy("company_id").orderBy(*order)))


def select_sources(known: dict[str, DataFrame], names: str) -> list[DataFrame]:
    """The known sources named in a comma list, in its order; unknown names are ignored."""
    return [known[n] for n in dict.fromkeys(x.strip() for x in names.split(",")) if n in known]

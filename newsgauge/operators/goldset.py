"""Gold sets for the evaluation of a classifier: a pool of candidates, strata, a fixed choice, labels left to people.

Strata are what is known before anyone judges (the pre-filter's verdict, the company's tier, words of
loss in the headline), never the answer. The same pool gives the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import round_robin, stratum

#: How many items of each stratum a gold set holds.
TARGETS = {"kept-distinctive": 18, "kept-ambiguous": 14, "softpass": 20, "negative-signal": 8}
SENTIMENT_WORDS = ("positive", "negative", "neutral")
LABEL = "struct<relevant: boolean, sentiment: string, note: string>"


def candidates(judged: DataFrame, companies: DataFrame) -> DataFrame:
    """The pool: one row for each item that the pre-filter kept, with its stratum.

    judged: company_id, title, url, source_name, published_at, verdict (as the pre-filter gives it).
    companies: company_id, name, ambiguity, query_source. Items of companies that are not there are
    left out, as are null ids; a null tier counts as low. Repeats of an item (company and URL) are one
    candidate, the one with the least title, so that reruns agree; a null URL reads as empty.
    """
    known = companies.select("company_id", F.col("name").alias("company"), F.coalesce("ambiguity", F.lit("low")).alias("ambiguity"), "query_source")
    url = F.coalesce("url", F.lit(""))
    kept = judged.where("verdict.keep").select(
        F.substring(F.sha2(F.concat(F.col("company_id").cast("string"), F.lit(":"), url), 256), 1, 16).alias("id"), "company_id",
        F.coalesce("title", F.lit("")).alias("title"), url.alias("url"), "source_name", "published_at",
        F.when(F.col("verdict.soft_pass"), "soft-pass").otherwise("kept").alias("verdict"),
    )
    rest = [c for c in kept.columns if c not in ("id", "company_id", "url")]
    once = kept.groupBy("id", "company_id", "url").agg(F.min(F.struct(*rest)).alias("r")).select("id", "company_id", "url", "r.*")
    named = once.join(known, "company_id")
    return named.withColumn("stratum", stratum(F.col("title"), F.col("verdict") == "soft-pass", F.col("ambiguity")))


def choose(pool: DataFrame, targets: dict[str, int] = TARGETS) -> DataFrame:
    """Items of the gold set with place in their stratum and an empty label.

    A round takes one item of each company in order of name, so none fills a stratum; a company's items come by id.
    A stratum that has fewer than its target gives all it has.
    """
    picked = round_robin(pool, "stratum", "company", F.struct("id", "company_id", "url"), targets)
    empty = F.struct(F.lit(None).cast("boolean").alias("relevant"), F.lit(None).cast("string").alias("sentiment"), F.lit("").alias("note"))
    return picked.withColumn("label", empty)


def header(chosen: DataFrame, created_at: Column, window_days: int, provider: str, targets: dict[str, int] = TARGETS) -> DataFrame:
    """One row on a gold set: what made it, its items by stratum (zeros included), items and companies."""
    strata = F.create_map(*[x for s in targets for x in (F.lit(s), F.count_if(F.col("stratum") == s))])
    return chosen.agg(strata.alias("strata"), F.count("*").alias("items"), F.count_distinct("company").alias("companies")).select(
        F.lit(1).alias("version"), created_at.alias("created_at"), F.lit(window_days).alias("window_days"), F.lit(provider).alias("provider"),
        F.array(F.lit("company"), F.lit("title")).alias("input_fields"), F.lit("unlabelled").alias("labelling"), "strata", "items", "companies",
    )


def write_gold_set(
    pool: DataFrame, folder: str, created_at: Column, window_days: int = 90, provider: str = "landed", targets: dict[str, int] = TARGETS
) -> DataFrame:
    """Write pool, items and header as JSON lines below folder; the choice is made from the pool as written. Returns the header.

    An existing gold set is not overwritten, since people may have labelled it.
    """
    spark = pool.sparkSession
    pool.write.json(f"{folder}/pool")
    chosen = choose(spark.read.schema(pool.schema).json(f"{folder}/pool"), targets)
    chosen.coalesce(1).write.option("ignoreNullFields", False).json(f"{folder}/items")
    items = spark.read.schema(chosen.schema).json(f"{folder}/items")
    header(items, created_at, window_days, provider, targets).write.json(f"{folder}/header")
    return spark.read.json(f"{folder}/header")


def label_faults(items: DataFrame) -> DataFrame:
    """id, fault of items whose label is not as asked for: none yet, or a sentiment missing, unknown or out of place."""
    relevant, mood = F.col("label.relevant"), F.col("label.sentiment")
    fault = F.when(relevant.isNull(), "unlabelled").when(~relevant & mood.isNotNull(), "sentiment of an irrelevant item")
    fault = fault.when(relevant & mood.isNull(), "no sentiment").when(relevant & ~mood.isin(*SENTIMENT_WORDS), "unknown sentiment")
    return items.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def labelled(items: DataFrame) -> DataFrame:
    """Items with gold_relevant and gold_sentiment in place of the label, those without a fault in it only."""
    good = items.join(label_faults(items), "id", "left_anti")
    return good.withColumn("gold_relevant", F.col("label.relevant")).withColumn("gold_sentiment", F.col("label.sentiment")).drop("label")

"""The company registry: seed list, triage and enrichment merged by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.text import (
    company_id, enrichment_query, quote, same_name, slugify, split_negatives, squash, text_or_empty,
)

#: Sectors that say nothing.
NO_SECTOR = ("", "null", "undefined", "unknown", "n/a", "na", "none")


def parse_seed(lines: DataFrame, value: str = "value", position: str = "position") -> DataFrame:
    """index, name: one name a line, numbering and comments dropped, the first spelling of a name kept."""
    line = F.trim(value)
    name = F.trim(F.regexp_replace(line, r"^\d+[.)\t ]\s*", ""))
    named = lines.where((line != "") & ~line.startswith("#")).select(name.alias("name"), F.col(position).alias("at"))
    first = Window.partitionBy(F.lower("name")).orderBy("at")
    kept = named.where("name <> ''").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    return kept.select(F.row_number().over(Window.orderBy("at")).alias("index"), "name")


def _distinct_squashed(values):
    keys = F.transform(values, squash)
    kept = F.filter(values, lambda v, i: (squash(v) != "") & (F.array_position(keys, squash(v)) == i + 1))
    return kept


def _trimmed(values):
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v))


def sanitize(enrichments: DataFrame) -> DataFrame:
    """Enrichment answers reduced to what may be stored; answers that do not know the company are dropped.

    Aliases must resemble the name, the domain's first label too, placeholder sectors
    are blank, and no negative keyword may be contained in the name or an alias.
    """
    name = F.col("name")
    aliases = F.filter(_distinct_squashed(_trimmed(F.col("aliases"))), lambda a: same_name(a, name) & (squash(a) != squash(name)))
    label = F.regexp_replace(F.regexp_replace(text_or_empty("domain"), r"^https?://", ""), r"^www\.", "")
    label = F.substring_index(F.substring_index(label, "/", 1), ".", 1)
    sector = F.trim(text_or_empty("sector"))
    known = enrichments.where("known").withColumn("aliases", aliases)
    owned = F.concat(F.array(squash("name")), F.transform("aliases", squash))
    negatives = F.filter(
        _distinct_squashed(_trimmed(F.col("negative_keywords"))), lambda k: ~F.exists(owned, lambda o: o.contains(squash(k)))
    )
    return known.select(
        "name", "aliases",
        F.when(F.lower(sector).isin(*NO_SECTOR), "").otherwise(sector).alias("sector"),
        F.when(same_name(label, name), F.lower(F.trim("domain"))).alias("domain"),
        "ambiguity", "context_terms", negatives.alias("negative_keywords"),
    )


def build_registry(seed: DataFrame, triage: DataFrame, enrichments: DataFrame, model: str | None, now) -> DataFrame:
    """One record for each seed name: human over enrichment over triage over the bare name.

    triage: position, name, tier, volume, query, neg, sector (the last of a repeated name
    counts, names meet in any case). enrichments: raw answers, met by exact name.
    """
    last = Window.partitionBy("_key").orderBy(F.desc("position"))
    t = triage.withColumn("_key", F.lower("name")).withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    t = t.select("_key", *[F.col(c).alias(f"t_{c}") for c in ("tier", "volume", "query", "neg", "sector")])
    e = sanitize(enrichments)
    e = e.select("name", *[F.col(c).alias(f"e_{c}") for c in e.columns if c != "name"], F.lit(True).alias("enriched"))
    rows = seed.withColumn("_key", F.lower("name")).join(t, "_key", "left").join(e, "name", "left")
    human = F.coalesce(F.col("t_tier").isin("CRITICAL", "HIGH"), F.lit(False))
    enriched, triaged = F.col("enriched").isNotNull(), F.col("t_tier").isNotNull()
    none = F.array().cast("array<string>")
    t_sector = F.when(~F.col("t_sector").startswith("TBD"), F.nullif("t_sector", F.lit("")))
    return rows.select(
        company_id("name").alias("id"), "name", slugify("name").alias("slug"),
        F.coalesce("e_aliases", none).alias("aliases"), F.col("e_domain").alias("domain"),
        F.coalesce(F.nullif("e_sector", F.lit("")), t_sector).alias("sector"),
        F.when(triaged, F.lower("t_tier")).otherwise(F.coalesce("e_ambiguity", F.lit("low"))).alias("ambiguity"),
        F.when(F.col("t_volume") == "HIGH", "high").otherwise("normal").alias("volume"),
        F.when(human, F.col("t_query"))
        .when(enriched, enrichment_query(F.col("name"), F.col("e_ambiguity"), F.col("e_context_terms")))
        .when(triaged, F.col("t_query")).otherwise(quote("name")).alias("query"),
        F.array_union(split_negatives("t_neg"), F.coalesce("e_negative_keywords", none)).alias("negative_keywords"),
        F.when(human, "human-approved").when(enriched, "llm-enriched").when(triaged, "triage-default")
        .otherwise("fallback").alias("query_source"),
        F.when(enriched, F.lit(model)).alias("enriched_by"), F.when(enriched, now).alias("enriched_at"),
    )


def registry_summary(registry: DataFrame) -> DataFrame:
    """One row of counts by source and tier, zeros included."""
    sources = ("human-approved", "llm-enriched", "triage-default", "fallback")
    return registry.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("query_source") == s).alias(s.replace("-", "_")) for s in sources],
        *[F.count_if(F.col("ambiguity") == a).alias(a) for a in ("critical", "high", "medium", "low")],
        F.count_if(F.col("volume") == "high").alias("high_volume"),
        F.count_if(text_or_empty("sector") != "").alias("with_sector"),
    )

"""Classification of pending mentions by an injected model, each distinct request once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.repair import parse_answer, repair_answer
from newsgauge.functions.text import cache_key, classify_prompt

from .linking import stored

#: prompts -> raw answers, None for a failed call; must not raise for a single prompt.
Model = Callable[[list[str]], list[str | None]]


def keyword_model(prompts: list[str]) -> list[str | None]:
    """An offline stand-in: mood by a few words of the headline."""
    out = []
    for prompt in prompts:
        line = prompt.rpartition("Headline: ")[2].lower()
        bad = any(w in line for w in ("lawsuit", "breach", "loss", "layoff"))
        good = any(w in line for w in ("wins", "raises", "launch", "growth"))
        mood = "negative" if bad else "positive" if good else "neutral"
        out.append(f'{{"relevant": true, "sentiment": "{mood}", "confidence": 0.6, "rationale": "keywords", "evidence": ""}}')
    return out


def requests(pending: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """pending (company, sector, aliases, negative_keywords, title, ...) with prompt and cache key."""
    prompt = classify_prompt(F.col("company"), F.col("sector"), F.col("aliases"), F.col("negative_keywords"), F.col("title"))
    keyed = pending.withColumn("prompt", prompt)
    return keyed.withColumn("key", cache_key(F.lit(model), F.lit(prompt_version), F.col("prompt")))


def ask(misses: DataFrame, model: Model) -> DataFrame:
    """key, raw for distinct requests that the cache lacks; the only step that leaves the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "raw": model(pdf["prompt"].tolist())})

    distinct = misses.groupBy("key").agg(F.first("prompt").alias("prompt"))
    return distinct.mapInPandas(run, "key string, raw string")


def classify(pending: DataFrame, cache: DataFrame, model: Model, name: str, prompt_version: str) -> tuple[DataFrame, DataFrame]:
    """(pending rows with ``answer``, new cache rows). cache: key, raw. A null answer is a failed call.

    Cached answers must fit the present schema, otherwise they are asked for again.
    The model is asked once; answers and new cache rows both read what it said.
    """
    asked = requests(pending, name, prompt_version)
    hits = cache.where(parse_answer("raw").isNotNull()).select("key", "raw")
    fresh = stored(ask(asked.join(hits, "key", "left_anti").select("key", "prompt"), model), "answers")  # each call is made once
    answered = asked.join(hits.unionByName(fresh), "key", "left").withColumn("_a", parse_answer("raw"))
    out = answered.withColumn("answer", F.when(F.col("_a").isNotNull(), repair_answer(F.col("_a")))).drop("_a")
    return out, fresh.where("raw IS NOT NULL")


def results(classified: DataFrame, name: str, prompt_version: str, now) -> DataFrame:
    """Mention rows of usable answers; failures and repair errors stay pending."""
    good = classified.where("answer IS NOT NULL AND answer.repair_error IS NULL")
    return good.select(
        "id", "company_id", "article_id", F.col("answer.relevant").alias("relevant"),
        F.when(~F.col("answer.relevant"), "llm-irrelevant").alias("rejection_reason"),
        F.col("answer.sentiment").alias("sentiment"), F.col("answer.confidence").alias("confidence"),
        F.col("answer.rationale").alias("rationale"), F.col("answer.evidence").alias("evidence"),
        F.lit(name).alias("model"), F.lit(prompt_version).alias("prompt_version"), now.alias("classified_at"),
    )


def rejections(judged: DataFrame, now) -> DataFrame:
    """Rejected pairs kept for audit: the reason, what decided it, and that the filter did."""
    no = judged.where("NOT verdict.keep")
    return no.select(
        "id", "company_id", "article_id", F.lit(False).alias("relevant"), F.col("verdict.reason").alias("rejection_reason"),
        F.col("verdict.evidence").alias("rationale"), F.lit("pre-filter").alias("prompt_version"), now.alias("classified_at"),
    )


def run_status(outcomes: DataFrame) -> DataFrame:
    """One row of a run's manifest: failed only if every company failed, so also without any."""
    return outcomes.agg(
        F.count("*").alias("companies"), F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.count_if(F.col("error").isNull() & (F.col("kept") == 0)).alias("no_coverage"),
        F.when(F.count("*") == F.count_if(F.col("error").isNotNull()), "failed").otherwise("completed").alias("status"),
    )

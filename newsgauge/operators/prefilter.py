"""Layered pre-filter, its counters, and the phrase join that feeds it at scale."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.phrases import MOST_CHARS, found_phrases, send_phrases
from newsgauge.functions.query_language import PROGRAM, postfix, run_program, shape
from newsgauge.functions.text import contains_phrase, text_or_empty
from newsgauge.functions.urls import BLOCKED_DOMAINS, article_domain, blocking_entry

#: Reasons of rejection, in the order of the layers.
REASONS = ("blocked-domain", "no-name-match", "negative-keyword", "missing-qualifier")


def query_program(query: Column | str) -> Column:
    """Each query as steps for run_program; for the company dimension, not for articles."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda q: [{"op": op, "phrase": p} for op, p in postfix(None if pd.isna(q) else q)])

    return F.pandas_udf(run, PROGRAM)(query)


def query_shape(query: Column | str) -> Column:
    """struct(disambiguates, conjunctive) of each query."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape(None if pd.isna(q) else q) for q in s], columns=["disambiguates", "conjunctive"])

    return F.pandas_udf(run, "disambiguates boolean, conjunctive boolean")(query)


def article_text(title: Column | str, snippet: Column | str) -> Column:
    return F.trim(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(snippet)))


def trusted(query_source: Column | str) -> Column:
    """Whether a query's qualifiers count: approved by a human, or of no stated source."""
    source = F.col(query_source) if isinstance(query_source, str) else query_source
    return source.isNull() | (source == "human-approved")


def first_phrase(found: Column, phrases: Column) -> Column:
    """The first of the phrases that is among those found, null if none."""
    known = F.coalesce(phrases, F.array().cast("array<string>"))
    return F.get(F.filter(known, lambda p: F.array_contains(found, F.trim(p))), F.lit(0))


def verdict(
    found: Column, domain: Column, name: Column, aliases: Column, negatives: Column, query: Column, program: Column,
    conjunctive: Column, enforce: Column, blocked: tuple[str, ...] = BLOCKED_DOMAINS,
) -> Column:
    """struct(keep, reason, evidence, soft_pass); the first layer that applies decides, cheapest first.

    found: the (trimmed) phrases that the text contains. A text that names the company but
    lacks a qualifier of its query is kept, marked as passed softly, for the classifier to judge.
    """
    make = lambda keep, reason, evidence, soft=False: F.struct(
        F.lit(keep).alias("keep"), F.lit(reason).cast("string").alias("reason"),
        evidence.cast("string").alias("evidence"), F.lit(soft).alias("soft_pass"),
    )
    block = blocking_entry(domain, blocked)
    named = first_phrase(found, F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))
    negative = first_phrase(found, negatives)
    lacking = conjunctive & enforce & ~run_program(program, lambda p: F.array_contains(found, F.trim(p)))
    return (
        F.when(block.isNotNull(), make(False, "blocked-domain", block))
        .when(named.isNull(), make(False, "no-name-match", F.lit(None)))
        .when(negative.isNotNull(), make(False, "negative-keyword", negative))
        .when(lacking, make(True, "missing-qualifier", query, True))
        .otherwise(make(True, None, named))
    )


def _company_phrases() -> Column:
    """All that a company may be matched by: name, aliases, exclusions and the phrases of its query."""
    lists = [F.array("name"), *[F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "negative_keywords")], F.col("program")["phrase"]]
    return F.filter(F.array_distinct(F.transform(F.concat(*lists), F.trim)), lambda p: F.coalesce(p, F.lit("")) != "")


def prefilter(
    items: DataFrame, companies: DataFrame, blocked: tuple[str, ...] = BLOCKED_DOMAINS, most_chars: int = MOST_CHARS
) -> DataFrame:
    """items (company_id, url, title, snippet, source_name, ...) with their verdict column.

    companies: company_id, name, aliases, negative_keywords, query, query_source. Queries
    are read once for each company; the join is an equi-join and items keep all columns. A text is
    read once by an automaton of all companies' phrases; where these are more than
    ``most_chars`` characters, each text is held to the phrases of its own company instead.
    """
    dimension = companies.select(
        "company_id", "name", "aliases", "negative_keywords", "query", "query_source",
        query_program("query").alias("program"), query_shape("query")["conjunctive"].alias("conjunctive"),
    )
    dimension = dimension.withColumn("phrases", _company_phrases())
    sent = send_phrases(dimension.select(F.explode("phrases").alias("p")), "p", most_chars)
    body = article_text("title", "snippet")
    own = F.filter("phrases", lambda p: contains_phrase(body, p)) if sent is None else found_phrases(body, sent)
    said = verdict(
        F.col("_found"), article_domain("url", "source_name"), F.col("name"), F.col("aliases"), F.col("negative_keywords"), F.col("query"),
        F.col("program"), F.col("conjunctive"), trusted("query_source"), blocked,
    )
    if sent is None:
        joined = items.join(dimension, "company_id").withColumn("_found", own)
    else:  # companies of so few phrases are sent to the items: a company of very many items would be one task of a shuffle
        joined = items.withColumn("_found", own).join(F.broadcast(dimension), "company_id")
    return joined.select(*[items[c] for c in items.columns if c != "company_id"], "company_id", said.alias("verdict"))


def prefilter_stats(judged: DataFrame, *by: str) -> DataFrame:
    """Counters: kept, soft_pass and one for each reason. Missing qualifiers never reject, so theirs stays 0."""
    v = lambda f: F.col(f"verdict.{f}")
    reasons = [
        F.count_if(~v("keep") & (v("reason") == r)).alias(r.replace("-", "_")) for r in REASONS
    ]
    return judged.groupBy(*by).agg(
        F.count("*").alias("received"), F.count_if(v("keep")).alias("kept"), F.count_if(v("soft_pass")).alias("soft_pass"),
        *reasons,
    )


_GAP = r"[^\p{L}\p{N}]+"


def _tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), _GAP), lambda t: t != "")


def phrase_join(
    texts: DataFrame, phrases: DataFrame, text_id: str, text: str, phrase_id: str, phrase: str, most_chars: int = MOST_CHARS
) -> DataFrame:
    """(text_id, phrase_id) of every text that contains a phrase as whole words.

    Up to ``most_chars`` characters of phrases go to the texts, which an automaton reads once,
    without a shuffle of texts. Beyond that the two meet on tokens (see token_join).
    """
    sent = send_phrases(phrases, phrase, most_chars)
    if sent is None:
        return token_join(texts, phrases, text_id, text, phrase_id, phrase)
    hits = texts.select(F.col(text_id).alias("_t"), F.explode(found_phrases(F.col(text), sent)).alias("_p"))
    named = phrases.select(F.col(phrase_id), F.trim(F.col(phrase)).alias("_p"))
    return hits.join(named, "_p").select(F.col("_t").alias(text_id), phrase_id)


def token_join(texts: DataFrame, phrases: DataFrame, text_id: str, text: str, phrase_id: str, phrase: str) -> DataFrame:
    """phrase_join for any number of phrases: distinct tokens of texts meet phrases on their rarest token.

    Survivors are verified. Every token of a phrase occurs in a text that contains it, so any of them may
    serve; a phrase without letters or digits has none and matches nothing here. Ties go to the longer token.
    """
    t = texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_text"))
    p = phrases.select(F.col(phrase_id).alias("_p"), F.col(phrase).alias("_phrase"))
    wanted = p.select("_p", "_phrase", F.explode(F.array_distinct(_tokens(F.col("_phrase")))).alias("tok"))
    posted = t.select("_t", F.explode(F.array_distinct(_tokens(text_or_empty("_text")))).alias("tok"))
    counts = posted.join(wanted.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("n"))
    key = F.min(F.struct("n", (-F.length("tok")).alias("l"), "tok"))["tok"]
    rarest = wanted.join(counts, "tok").groupBy("_p", "_phrase").agg(key.alias("tok"))
    near = posted.join(rarest, "tok").select("_t", "_p", "_phrase")
    found = near.join(t, "_t").where(contains_phrase("_text", F.col("_phrase")))
    return found.select(F.col("_t").alias(text_id), F.col("_p").alias(phrase_id))

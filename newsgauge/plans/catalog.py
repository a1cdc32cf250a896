"""The query catalogue: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.functions import dates, query_language, repair, text, urls
from newsgauge.operators import (
    alerts, breaker, classify, collect, evaluate, exports, goldset, normalize, persist, planner, prefilter, registry_build, run, status,
)
from newsgauge.operators.ledger import Keyed, Ledger
from newsgauge.sources import feeds, landed, records
from newsgauge.streaming import daily, first_seen

from .standins import (
    NOW_TEXT, SQL_COMPANIES, SQL_MENTIONS, SQL_ROLLUP, articles, companies, mentions, now, table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_rollup(companies(spark, sf), mentions(spark, sf), status.window_start(now(), 90), now())


# --- status -----------------------------------------------------------------------------------


@query(f"""WITH {SQL_ROLLUP}
    SELECT company_id, name, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_mentioned_at, days AS days_since_last_mention,
      mentions_in_window, positive, negative, neutral, status,
      CASE WHEN days IS NULL THEN 'no coverage found' WHEN days = 0 THEN 'mentioned today'
           WHEN days = 1 THEN 'last mentioned yesterday' ELSE 'last mentioned ' || days || ' days ago' END AS status_text
    FROM rollup_""")
def company_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = _rollup(spark, sf).withColumn("last_mentioned_at", F.date_format("last_mentioned_at", "yyyy-MM-dd HH:mm:ss"))
    return out.drop("slug", "sector", "ambiguity")


@query(f"""WITH {SQL_COMPANIES},{SQL_MENTIONS}
    SELECT c.company_id, count(m.id) FILTER (WHERE m.relevant AND m.published_at >= DATE '{NOW_TEXT[:10]}' - INTERVAL 90 DAY) AS mentions_in_window
    FROM companies c LEFT JOIN mentions m ON m.company_id = c.company_id GROUP BY c.company_id""")
def status_view_dateonly(spark: SparkSession, sf: str) -> DataFrame:
    since = status.window_start(now(), 90, by_date=True)
    return status.status_rollup(companies(spark, sf), mentions(spark, sf), since, now()).select("company_id", "mentions_in_window")


@query(f"WITH {SQL_ROLLUP} SELECT status, count(*) AS n FROM rollup_ GROUP BY status")
def companies_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.counts_by(_rollup(spark, sf), "status")


@query(f"""WITH {SQL_MENTIONS} SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM mentions
    WHERE relevant AND classified_at IS NOT NULL GROUP BY 1""")
def mentions_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return status.mentions_by_month(status.coverage(mentions(spark, sf)))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def articles_by_month(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("article_id"))
    return status.articles_by_month(articles(spark, sf), lines)


@query(f"WITH {SQL_ROLLUP} SELECT name, mentions_in_window, status FROM rollup_ ORDER BY mentions_in_window DESC, name LIMIT 20")
def top_companies(spark: SparkSession, sf: str) -> DataFrame:
    return status.top_companies(_rollup(spark, sf))


@query(f"""WITH {SQL_MENTIONS} SELECT (SELECT count(*) FROM customer) AS companies, count(*) AS mentions,
      count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
      count(*) FILTER (WHERE sentiment = 'neutral') AS neutral
    FROM mentions WHERE relevant AND classified_at IS NOT NULL""")
def portfolio_summary_export(spark: SparkSession, sf: str) -> DataFrame:
    return status.totals_of_export(companies(spark, sf), status.coverage(mentions(spark, sf)))


@query(f"""WITH {SQL_ROLLUP} SELECT count(*) AS companies, sum(mentions_in_window)::BIGINT AS mentions,
      count(*) FILTER (WHERE status <> 'NO_COVERAGE') AS with_coverage,
      count(*) FILTER (WHERE status = 'NO_COVERAGE') AS without_coverage,
      sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative, sum(neutral)::BIGINT AS neutral FROM rollup_""")
def portfolio_summary_api(spark: SparkSession, sf: str) -> DataFrame:
    return status.totals_of_service(_rollup(spark, sf))


@query(f"""WITH {SQL_COMPANIES},{SQL_MENTIONS} SELECT m.id, c.name, m.sentiment, strftime(m.published_at, '%Y-%m-%d') AS published
    FROM mentions m JOIN companies c USING (company_id)
    WHERE slug = 'customer#000000007' AND relevant AND classified_at IS NOT NULL""")
def company_detail(spark: SparkSession, sf: str) -> DataFrame:
    found = status.company_detail(companies(spark, sf), mentions(spark, sf).drop("published_at"), articles(spark, sf), "customer#000000007")
    return found.select("id", "name", "sentiment", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query(f"""WITH {SQL_ROLLUP} SELECT name, row_number() OVER (ORDER BY last_at DESC NULLS LAST, mentions_in_window DESC, name) AS place
    FROM rollup_ WHERE status IN ('FRESH', 'RECENT', 'STALE') AND positive > 0""")
def activity_order(spark: SparkSession, sf: str) -> DataFrame:
    shown = status.grid_filter(_rollup(spark, sf), statuses=("FRESH", "RECENT", "STALE"), sentiment="positive")
    return shown.select("name", F.row_number().over(Window.orderBy(*status.activity_order())).alias("place"))


@query(f"""WITH {SQL_ROLLUP} SELECT company_id, name, status, coalesce(ambiguity, 'low') AS ambiguity, sector FROM rollup_
    WHERE lower(name || ' ' || coalesce(sector, '')) LIKE '%build%' AND coalesce(ambiguity, 'low') = 'low'""")
def company_grid(spark: SparkSession, sf: str) -> DataFrame:
    summaries = status.company_summaries(_rollup(spark, sf).drop("sector", "ambiguity"), companies(spark, sf))
    shown = status.grid_filter(summaries, search="Build", tier="low")
    return shown.select("company_id", "name", "status", "ambiguity", "sector")


@query(f"""WITH {SQL_ROLLUP} SELECT company_id, round(positive / nullif(positive + negative + neutral, 0), 9) AS positive_share,
      round(negative / nullif(positive + negative + neutral, 0), 9) AS negative_share,
      round(neutral / nullif(positive + negative + neutral, 0), 9) AS neutral_share FROM rollup_""")
def sentiment_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = status.sentiment_shares(_rollup(spark, sf))
    return shares.select("company_id", *[F.round(c, 9).alias(c) for c in shares.columns[1:]])


@query("""SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders) AS mentions,
    (SELECT arg_max(o_orderstatus = 'P', o_orderkey) FROM orders) AS run_in_progress""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("finished_at")
    )
    return status.health(companies(spark, sf), mentions(spark, sf), runs)


@query(f"""WITH {SQL_MENTIONS} SELECT (SELECT count(*) FROM customer) AS companies, count(*) AS mentions,
    count(*) FILTER (WHERE classified_at IS NULL) AS pending, count(*) FILTER (WHERE relevant) AS relevant FROM mentions""")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    counted = m.agg(
        F.count("*").alias("mentions"), F.count_if(F.col("classified_at").isNull()).alias("pending"), F.count_if("relevant").alias("relevant")
    )
    return counted.withColumn("companies", companies(spark, sf).agg(F.count("*")).scalar())


# --- identity and text ------------------------------------------------------------------------

_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
SQL_CANONICAL = rf"""
    parts AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):/*([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s','h','p','q']) AS u FROM pages),
    cut AS (SELECT page_id, url, CASE WHEN lower(u.s) = 'http' THEN 'https' ELSE lower(u.s) END AS s,
        regexp_replace(regexp_replace(lower(u.h), '^www\.', ''), ':(80|443)$', '') AS h,
        CASE WHEN length(u.p) > 1 THEN regexp_replace(u.p, '/+$', '') ELSE u.p END AS p,
        list_filter(string_split(u.q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_TRACK})) AS q FROM parts),
    keyed AS (SELECT page_id, url, s, h, CASE WHEN p = '' THEN '/' ELSE p END AS p,
        list_transform(list_sort(list_transform(range(1, len(q) + 1), lambda i: {{'n': string_split(q[i], '=')[1], 'i': i, 'v': q[i]}})), lambda x: x.v) AS q FROM cut),
    canonical AS (SELECT page_id, url, s || '://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url, h FROM keyed)"""


@query(f"WITH {SQL_CANONICAL} SELECT page_id, canonical_url, sha256(canonical_url) AS id FROM canonical")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    made = urls.canonical_url("url")
    return table(spark, sf, "pages").select("page_id", made.alias("canonical_url"), text.article_id(made).alias("id"))


#: What is made of a page's number: a link in one of five spellings, and the form that all readers of it must give.
_SPELLINGS = (
    ("HTTP://WWW.Müller.Example:80/a/./b/../seite {n}/é?q=x+y&utm_source=z&b=%7E&a&B={n}#top", "https://xn--mller-kva.example/a/seite%20{n}/%C3%A9?B={n}&a=&b=%7E&q=x+y"),
    ("http://news.example:443/%2e%2E/{n}//?b=1&a=2&b=0", "https://news.example/{n}?a=2&b=1&b=0"),
    ("https:\\\\News.Example\\{n}\\?GCLID=1&q=100%", "https://news.example/{n}?q=100%25"),
    ("https://u@n%65ws.example:8443/{n}/..?x=%41%2B%2b", "https://u@news.example:8443/?x=A%2B%2B"),
    ("https://new s.example/{n}", None),
)


def _spelled(which: int) -> str:
    """SQL of the n-th column of the spellings for a page."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("\\", "\\\\" if which == 0 else "\\").replace("{n}", "' || page_id || '") + "'"
    return "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {text(pair[which])}" for i, pair in enumerate(_SPELLINGS)) + " END"


@query(f"SELECT page_id, {_spelled(1)} AS canonical_url FROM pages")
def canonical_spellings(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "pages").select("page_id", F.expr(_spelled(0)).alias("url"))
    return made.select("page_id", urls.canonical_url("url").alias("canonical_url"))


@query("""SELECT o_orderkey, sha256(sha256('company:' || lower(trim(c_name))) || ':' || sha256(o_orderkey::VARCHAR)) AS mention_id
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def mention_ids(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = text.mention_id(text.company_id("c_name"), text.article_id(F.col("o_orderkey").cast("string")))
    return joined.select("o_orderkey", made.alias("mention_id"))


def _page_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as raw items; some titles blank and some dates missing, by number."""
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    day = F.make_dt_interval((n % 40).cast("int"))
    return p.select(
        n.alias("position"), F.regexp_replace("url", r"\d+", "1").alias("url"),
        F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("Story "), (n % 30).cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("snippet"), F.when(n % 4 == 0, F.lit("Daily Paper")).when(n % 4 == 1, F.lit("www.paper.example")).alias("source_name"),
        F.when(n % 13 != 0, F.lit(NOW_TEXT).cast("timestamp") - day).alias("published_at"), (n % 5).alias("company_id"),
    )


SQL_ITEMS = f"""
    pages_ AS (SELECT page_id, regexp_replace(url, '\\d+', '1', 'g') AS url FROM pages),
    {SQL_CANONICAL.replace('FROM pages)', 'FROM pages_)')},
    items AS (SELECT page_id AS position, url, canonical_url,
      CASE WHEN page_id % 11 = 0 THEN ' ' ELSE 'Story ' || (page_id % 30) END AS title,
      CASE WHEN page_id % 4 = 0 THEN 'Daily Paper' WHEN page_id % 4 = 1 THEN 'www.paper.example' END AS source_name,
      CASE WHEN page_id % 13 <> 0 THEN TIMESTAMP '{NOW_TEXT}' - INTERVAL (page_id % 40) DAY END AS published_at,
      page_id % 5 AS company_id, regexp_replace(h, ':.*', '') AS host FROM canonical)"""


@query(f"""WITH {SQL_ITEMS} SELECT position, CASE WHEN trim(title) = '' THEN 'no-title' WHEN published_at IS NULL THEN 'no-date' END AS skip_reason,
      CASE WHEN position % 4 = 1 THEN 'paper.example' ELSE host END AS publisher FROM items""")
def normalize_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_items(_page_items(spark, sf)).select("position", "skip_reason", "publisher")


@query(f"""WITH {SQL_ITEMS} SELECT canonical_url, arg_min(position, (published_at, position)) AS position, count(*) AS reports
    FROM items WHERE trim(title) <> '' AND published_at IS NOT NULL GROUP BY canonical_url""")
def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    stored = normalize.normalize_items(_page_items(spark, sf)).where("skip_reason IS NULL")
    return normalize.best_of_url(stored, ["canonical_url"]).select("canonical_url", "position", "reports")


@query(f"""WITH RECURSIVE {SQL_ITEMS}, n AS (SELECT company_id AS c, {{'pos': position, 'id': canonical_url, 'k': title || '|' ||
        CASE WHEN position % 4 = 1 THEN 'paper.example' ELSE host END, 'o': host = 'news.google.com', 'd': epoch_us(published_at)}} AS r,
        row_number() OVER (PARTITION BY company_id ORDER BY position) AS rn
      FROM items WHERE trim(title) <> '' AND published_at IS NOT NULL),
    f AS (SELECT c, rn, [r] AS slots, [{{'id': r.id, 's': 1::BIGINT}}] AS urls, [{{'k': r.k, 's': 1::BIGINT}}] AS named, NULL::BIGINT AS lost, '' AS why
        FROM n WHERE rn = 1
      UNION ALL
      SELECT c, rn, CASE WHEN slot IS NULL THEN list_append(slots, r) WHEN stays THEN slots ELSE slots[:slot - 1] || [r] || slots[slot + 1:] END,
        CASE WHEN stays OR len(list_filter(urls, lambda u: u.id = r.id)) > 0 THEN urls ELSE list_append(urls, {{'id': r.id, 's': ix}}) END,
        CASE WHEN stays OR len(list_filter(named, lambda x: x.k = r.k AND x.s = ix)) > 0 THEN named ELSE list_append(named, {{'k': r.k, 's': ix}}) END,
        CASE WHEN slot IS NULL THEN NULL WHEN stays THEN r.pos ELSE slots[slot].pos END, why
      FROM (SELECT *, coalesce(slot, len(slots) + 1) AS ix, slot IS NOT NULL AND CASE WHEN slots[slot].o <> r.o THEN NOT slots[slot].o
                ELSE slots[slot].d <= r.d END AS stays
        FROM (SELECT *, coalesce(by_url, by_key) AS slot, CASE WHEN by_url IS NULL THEN 'same-content' ELSE 'same-url' END AS why
          FROM (SELECT f.c, n.rn, f.slots, f.urls, f.named, n.r, list_filter(f.urls, lambda u: u.id = n.r.id)[1].s AS by_url,
              list_filter(f.named, lambda x: x.k = n.r.k AND abs(f.slots[x.s].d - n.r.d) <= 604800000000)[1].s AS by_key
            FROM f JOIN n ON n.c = f.c AND n.rn = f.rn + 1)))),
    skipped AS (SELECT position, CASE WHEN trim(title) = '' THEN 'no-title' WHEN published_at IS NULL THEN 'no-date' END AS skip_reason FROM items)
    SELECT position, skip_reason, f.why AS duplicate_reason,
      CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN f.why IS NOT NULL THEN 'duplicate' ELSE 'stored' END AS outcome
    FROM skipped LEFT JOIN f ON f.lost = position""")
def item_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of the pages with what became of it; held against a plain loop in the tests."""
    made = normalize.normalize_items(_page_items(spark, sf))
    kept = normalize.dedupe_items(made.where("skip_reason IS NULL"), "company_id")
    every = made.where("skip_reason IS NOT NULL").withColumn("duplicate_reason", F.lit(None).cast("string"))
    made_of = normalize.outcome(F.col("skip_reason"), F.col("duplicate_reason")).alias("outcome")
    return every.unionByName(kept).select("position", "skip_reason", "duplicate_reason", made_of)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT user_id, event_type, rn, ts, event_id, ts AS slot, event_id AS holder FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_type, e.rn, e.ts, e.event_id,
        CASE WHEN e.ts - r.slot <= INTERVAL 7 DAY THEN r.slot ELSE e.ts END,
        CASE WHEN e.ts - r.slot <= INTERVAL 7 DAY THEN r.holder ELSE e.event_id END
      FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
    SELECT event_id, user_id, event_type FROM r WHERE holder = event_id""")
def content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    arrival = Window.partitionBy("user_id").orderBy("ts", "event_id")
    items = e.select(
        "event_id", "user_id", "event_type", F.row_number().over(arrival).alias("position"), F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("content_key"), F.lit(False).alias("opaque"), F.col("ts").alias("published_at"),
    )
    kept = normalize.dedupe_items(items, "user_id").where("duplicate_reason IS NULL")
    return kept.select("event_id", "user_id", "event_type")


@query(f"WITH {SQL_CANONICAL} SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'paper.example' ELSE regexp_replace(h, ':.*', '') END AS domain FROM canonical")
def publisher_domain(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    declared = F.when(n % 4 == 1, "www.Paper.example ").when(n % 4 == 2, "The Daily Paper")
    return table(spark, sf, "pages").select("page_id", urls.publisher_domain("url", declared).alias("domain"))


@query(f"WITH {SQL_CANONICAL} SELECT page_id, regexp_replace(h, ':.*', '') AS domain FROM canonical")
def article_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.article_domain("url", F.lit("www.other.example")).alias("domain"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM documents")
def title_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_title("text").alias("title_key"))


@query("""SELECT 'customer' AS kind, c_custkey AS id, substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM customer
    UNION ALL SELECT 'part', p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) FROM part""")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), text.slugify("c_name").alias("slug"))
    p = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), text.slugify("p_name").alias("slug"))
    return c.unionByName(p)


_TERMS = ("the", "Éan", "ing", "token", "that this", "öge", "MIT License")


def _has(term: str, column: str = "text") -> str:
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)', 'i')"


@query("UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM documents WHERE {_has(t)} " for t in _TERMS))
def whole_word_match(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.array(*[F.when(text.contains_phrase("text", t), F.lit(t)) for t in _TERMS])
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_compact(hits)).alias("term"))


#: name, query, the same by hand for the oracle
_BOOLEAN = (
    ("phrase", '"license"', _has("license")),
    ("nested", '"the" AND ("token" OR ("license" AND "released"))', f"{_has('the')} AND ({_has('token')} OR ({_has('license')} AND {_has('released')}))"),
    ("adjacent", 'the "that" token', f"{_has('the')} AND {_has('that')} AND {_has('token')}"),
    ("alternatives", '"und" OR "les" OR "los"', f"{_has('und')} OR {_has('les')} OR {_has('los')}"),
    ("unbalanced", '"the" AND ("of" OR "token', f"{_has('the')} AND ({_has('of')} OR {_has('token')})"),
    ("empty", "()", "true"),
)


@query("UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS docs, sum(doc_id)::BIGINT AS ids FROM documents WHERE {s} HAVING count(*) > 0 " for n, _, s in _BOOLEAN))
def boolean_query_match(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.array(*[F.when(query_language.compile_query(q, "text"), F.lit(n)) for n, q, _ in _BOOLEAN])
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.array_compact(hits)).alias("query"))
    return found.groupBy("query").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


@query(r"""WITH d AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents), q AS MATERIALIZED (SELECT item_id, lower(trim(text)) AS p FROM benchmark),
    near AS MATERIALIZED (SELECT doc_id, item_id, t, p FROM d JOIN q ON contains(t, p))
    SELECT doc_id, item_id FROM near WHERE regexp_matches(t, '(^|[^\p{L}\p{N}])' || regexp_escape(p) || '([^\p{L}\p{N}]|$)')""")
def phrase_join(spark: SparkSession, sf: str) -> DataFrame:
    return prefilter.phrase_join(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@query(r"""SELECT doc_id, CASE WHEN len(w) <= 15 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:15], ' ') || '…' END AS capped
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def cap_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.cap_words("text").alias("capped"))


# --- pre-filter and plans ---------------------------------------------------------------------

#: language -> name, aliases, negatives, query, source of the query
_REGISTRY = {
    "en": ("the", [], ["token"], '"the" AND ("this" OR "Erinst")', "human-approved"),
    "de": ("und", ["der"], [], '"und" AND "nicht"', "llm-enriched"),
    "fr": ("de", ["les"], ["Released"], '"de" OR "les"', None),
    "es": ("cióndoez", ["del"], ["see license"], '"del" AND "para"', None),
}


def _registry(spark: SparkSession) -> DataFrame:
    schema = "company_id string, name string, aliases array<string>, negative_keywords array<string>, query string, query_source string"
    return spark.createDataFrame([(k, *v) for k, v in _REGISTRY.items()], schema)


def _doc_items(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    site = F.when(F.col("source") == "src3", "https://www.biggo.com/a").when(F.col("source") == "src4", "https://x.newswav.com/")
    return d.select(
        "doc_id", F.col("lang").alias("company_id"), "source", site.alias("url"), F.col("text").alias("title"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("source_name"),
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return prefilter.prefilter(_doc_items(spark, sf), _registry(spark))


SQL_VERDICT = f"""
    v AS (SELECT doc_id, lang, source, CASE
      WHEN source = 'src3' THEN {{'r': 'blocked-domain', 'e': 'biggo.com'}}
      WHEN source = 'src4' THEN {{'r': 'blocked-domain', 'e': 'newswav.com'}}
      WHEN lang = 'en' THEN CASE WHEN NOT {_has('the')} THEN {{'r': 'no-name-match', 'e': NULL}}
        WHEN {_has('token')} THEN {{'r': 'negative-keyword', 'e': 'token'}}
        WHEN NOT ({_has('this')} OR {_has('Erinst')}) THEN {{'r': 'missing-qualifier', 'e': '"the" AND ("this" OR "Erinst")'}}
        ELSE {{'r': NULL, 'e': 'the'}} END
      WHEN lang = 'de' THEN CASE WHEN {_has('und')} THEN {{'r': NULL, 'e': 'und'}} WHEN {_has('der')} THEN {{'r': NULL, 'e': 'der'}}
        ELSE {{'r': 'no-name-match', 'e': NULL}} END
      WHEN lang = 'fr' THEN CASE WHEN NOT ({_has('de')} OR {_has('les')}) THEN {{'r': 'no-name-match', 'e': NULL}}
        WHEN {_has('Released')} THEN {{'r': 'negative-keyword', 'e': 'Released'}}
        WHEN {_has('de')} THEN {{'r': NULL, 'e': 'de'}} ELSE {{'r': NULL, 'e': 'les'}} END
      ELSE CASE WHEN NOT ({_has('cióndoez')} OR {_has('del')}) THEN {{'r': 'no-name-match', 'e': NULL}}
        WHEN {_has('see license')} THEN {{'r': 'negative-keyword', 'e': 'see license'}}
        WHEN NOT ({_has('del')} AND {_has('para')}) THEN {{'r': 'missing-qualifier', 'e': '"del" AND "para"'}}
        WHEN {_has('cióndoez')} THEN {{'r': NULL, 'e': 'cióndoez'}} ELSE {{'r': NULL, 'e': 'del'}} END END AS v
      FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')),
    verdicts AS (SELECT doc_id, lang, source, v.r AS reason, v.e AS evidence, v.r IS NULL OR v.r = 'missing-qualifier' AS keep,
      v.r IS NOT DISTINCT FROM 'missing-qualifier' AS soft_pass FROM v)"""


@query(f"WITH {SQL_VERDICT} SELECT doc_id, keep, reason, evidence, soft_pass FROM verdicts")
def prefilter_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("doc_id", "verdict.*")


@query(f"""WITH {SQL_VERDICT} SELECT lang AS company_id, count(*) AS received, count(*) FILTER (WHERE keep) AS kept,
      count(*) FILTER (WHERE soft_pass) AS soft_pass, count(*) FILTER (WHERE reason = 'blocked-domain') AS blocked_domain,
      count(*) FILTER (WHERE reason = 'no-name-match') AS no_name_match,
      count(*) FILTER (WHERE reason = 'negative-keyword') AS negative_keyword, 0::BIGINT AS missing_qualifier
    FROM verdicts GROUP BY lang""")
def prefilter_stats(spark: SparkSession, sf: str) -> DataFrame:
    return prefilter.prefilter_stats(_judged(spark, sf), "company_id")


@query(f"""WITH {SQL_VERDICT}, g AS (SELECT source, count(*) AS fetched, count(*) FILTER (WHERE keep) AS kept FROM verdicts GROUP BY ROLLUP (source))
    SELECT source, fetched, kept, fetched - kept AS dropped, (floor((fetched - kept) * 100.0 / fetched + 0.5))::BIGINT || '%' AS dropped_pct FROM g""")
def prefilter_measurement(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.prefilter_measurement(_judged(spark, sf), "source")


@query(f"""WITH {SQL_VERDICT}, r AS (SELECT source, CASE WHEN source = 'src5' THEN -1 ELSE count(*) END AS fetched,
        CASE WHEN source = 'src5' THEN -1 ELSE count(*) FILTER (WHERE keep) END AS kept FROM verdicts GROUP BY source)
    SELECT count(*) AS companies, sum(greatest(0, fetched))::BIGINT AS fetched, sum(greatest(0, kept))::BIGINT AS kept,
      count(*) FILTER (WHERE fetched = 0) AS zero_fetched, count(*) FILTER (WHERE kept = 0) AS zero_kept,
      count(*) FILTER (WHERE fetched < 0) AS failed FROM r""")
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = prefilter.prefilter_stats(_judged(spark, sf), "source")
    failed = F.col("source") == "src5"
    marked = lambda c: F.when(failed, F.lit(-1)).otherwise(F.col(c)).cast("bigint").alias(c)
    return evaluate.coverage_audit(rows.select("source", marked("received").alias("fetched"), marked("kept")))


@query(f"""WITH {SQL_VERDICT}, g AS (SELECT source, count(*) AS fetched, count(*) FILTER (WHERE keep) AS kept,
        count(*) FILTER (WHERE reason = 'no-name-match') AS unnamed FROM verdicts GROUP BY source)
    SELECT s.source AS name, CASE WHEN s.source = 'src5' THEN -1 ELSE coalesce(fetched, 0) END AS fetched,
      CASE WHEN s.source = 'src5' THEN -1 ELSE coalesce(kept, 0) END AS kept, CASE WHEN s.source <> 'src5' THEN coalesce(unnamed, 0) END AS no_name_match
    FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL UNION ALL SELECT DISTINCT 'no ' || lang FROM documents WHERE lang IS NOT NULL) s LEFT JOIN g USING (source)""")
def coverage_audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as companies, one of them failed, and a company without items for each language."""
    d = table(spark, sf, "documents")
    names = d.select(F.col("source").alias("name")).dropna().distinct().union(d.select(F.concat(F.lit("no "), "lang")).dropna().distinct())
    audited = names.select(F.col("name").alias("company_id"), "name", F.lit("critical").alias("ambiguity"))
    judged = _judged(spark, sf).withColumn("company_id", F.col("source"))
    rows = collect.audit_rows(audited, judged, audited.where("name = 'src5'"))
    return rows.select("name", "fetched", "kept", F.try_element_at("reasons", F.lit("no_name_match")).alias("no_name_match"))


_TIERS = {"en": "high", "de": None, "fr": "low", "es": "critical"}


def _gold_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates from documents: each twice, some headed by a word of loss."""
    items = _doc_items(spark, sf).withColumn("url", F.coalesce("url", F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string"))))
    items = items.withColumn("title", F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("Layoff: "), "title")).otherwise(F.col("title")))
    known = _registry(spark)
    tier = spark.createDataFrame(list(_TIERS.items()), "company_id string, ambiguity string")
    judged = prefilter.prefilter(items, known).withColumn("published_at", F.lit(None).cast("timestamp"))
    return goldset.candidates(judged.union(judged), known.join(tier, "company_id"))


SQL_GOLD = f"""{SQL_VERDICT}, named AS (SELECT doc_id, text AS title, lang, soft_pass FROM verdicts JOIN documents USING (doc_id, lang) WHERE keep),
    pool AS (SELECT sha256(lang || ':https://n.example/' || doc_id)[1:16] AS id, CASE lang {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _REGISTRY.items())} END AS company,
      CASE WHEN doc_id % 17 = 0 OR regexp_matches(title, '(?i)(^|[^A-Za-z0-9_])({evaluate.LOSS_WORDS})([^A-Za-z0-9_]|$)') THEN 'negative-signal' WHEN soft_pass THEN 'softpass'
        WHEN lang IN ('en', 'es') THEN 'kept-ambiguous' ELSE 'kept-distinctive' END AS stratum FROM named),
    rounds AS (SELECT *, row_number() OVER (PARTITION BY stratum, company ORDER BY id) AS round FROM pool),
    placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round, company) AS place FROM rounds),
    chosen AS (SELECT * FROM placed WHERE place <= CASE stratum {" ".join(f"WHEN '{k}' THEN {v}" for k, v in goldset.TARGETS.items())} END)"""


@query(f"WITH {SQL_GOLD} SELECT id, company, stratum, place, NULL::BOOLEAN AS relevant, '' AS note FROM chosen")
def gold_set(spark: SparkSession, sf: str) -> DataFrame:
    return goldset.choose(_gold_pool(spark, sf)).select("id", "company", "stratum", "place", "label.relevant", "label.note")


@query(f"""WITH {SQL_GOLD} SELECT (SELECT count(*) FROM pool) AS candidates, (SELECT count(DISTINCT stratum) FROM pool) AS strata, count(*) AS items,
    count(DISTINCT company) AS companies, {", ".join(f"count(*) FILTER (WHERE stratum = '{s}') AS {s.replace('-', '_')}" for s in goldset.TARGETS)} FROM chosen""")
def gold_set_header(spark: SparkSession, sf: str) -> DataFrame:
    pool = _gold_pool(spark, sf)
    of_pool = pool.agg(F.count("*").alias("candidates"), F.count_distinct("stratum").alias("strata"))
    made = goldset.header(goldset.choose(pool), now(), 90, "landed")
    by = [F.col("strata")[s].alias(s.replace("-", "_")) for s in goldset.TARGETS]
    return made.select(*[of_pool.select(c).scalar().alias(c) for c in of_pool.columns], "items", "companies", *by)


SQL_PLANS = """
    c AS (SELECT c_custkey AS k, '"' || c_name || '"' AS n, '"' || c_mktsegment || '"' AS seg FROM customer),
    plans AS (SELECT k AS company_id, CASE k % 6 WHEN 0 THEN n || ' AND ' || seg WHEN 1 THEN n || ' OR ("x" AND "y")' WHEN 5 THEN seg ELSE n END AS query,
      CASE k % 6 WHEN 0 THEN 'override' WHEN 1 THEN 'qualified' ELSE 'exact-phrase' END AS strategy, k % 6 < 2 AS qualified FROM c)"""


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as companies: approved, unsourced and unapproved qualifiers, their name, nothing, another phrase."""
    k = F.col("c_custkey") % 6
    n, segment = text.quote("c_name"), text.quote("c_mktsegment")
    both = F.concat(n, F.lit(" AND "), segment)
    asked = F.when(k.isin(0, 2), both).when(k == 1, F.concat(n, F.lit(' OR ("x" AND "y")'))).when(k == 3, n).when(k == 5, segment)
    source = F.when(k.isin(0, 5), "human-approved").when(k == 2, "llm-enriched").when(k == 3, "triage-default").when(k == 4, "fallback")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), asked.alias("query"), source.alias("query_source"))
    return planner.plan_queries(rows)


@query(f"WITH {SQL_PLANS} SELECT * FROM plans")
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf).drop("rationale")


@query(f"WITH {SQL_PLANS} SELECT strategy, count(*) AS companies, count(*) FILTER (WHERE qualified) AS qualified FROM plans GROUP BY strategy")
def query_plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plan_summary(_planned(spark, sf))


# --- windows, caps, samples -------------------------------------------------------------------


@query("""SELECT event_id, ts < TIMESTAMP '2024-01-20' AS half_open FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""")
def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp"))
    since, until = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    closed = feeds.window(e, since, until, closed=True)
    return closed.select("event_id", (F.col("published_at") < until).alias("half_open"))


@query(f"""WITH {SQL_MENTIONS} SELECT id, sentiment FROM mentions WHERE relevant AND published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 48 HOUR""")
def lookback_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.candidates(mentions(spark, sf).drop("published_at"), articles(spark, sf), companies(spark, sf), now())
    return found.select(F.col("mention_id").alias("id"), "sentiment")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def recency_cap(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.recency_cap(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY sha256(event_id::VARCHAR)) AS round FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round, user_id) AS place FROM r)
    SELECT event_id, event_type, user_id, place FROM p WHERE place <= CASE event_type WHEN 'click' THEN 18 WHEN 'view' THEN 14 WHEN 'purchase' THEN 20 END""")
def stratified_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    order = F.sha2(F.col("event_id").cast("string"), 256)
    taken = evaluate.round_robin(e, "event_type", "user_id", order, {"click": 18, "view": 14, "purchase": 20})
    return taken.select("event_id", "event_type", "user_id", "place")


@query("""WITH k AS (SELECT doc_id, lang, source, sha256(source || ':' || doc_id) AS hash FROM documents),
    g AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY hash) AS rn FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hash) AS place FROM g WHERE rn <= 2)
    SELECT doc_id, lang, source, place FROM p WHERE place <= CASE lang WHEN 'en' THEN 14 WHEN 'de' THEN 10 WHEN 'fr' THEN 10 END""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    taken = evaluate.hash_sample(table(spark, sf, "documents"), "lang", "source", key, 2, {"en": 14, "de": 10, "fr": 10})
    return taken.select("doc_id", "lang", "source", "place")


# --- writes and alerts ------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-15')""")
def new_mentions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return persist.new_pairs(o.where("o_orderdate < '2001-07-15'"), o.where("o_orderdate >= '2001-07-01'"), ["o_orderkey"])


@query("""SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) AS new_keys FROM
    (SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY ALL) GROUP BY 1""")
def first_seen_counts(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))
    return first.groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("new_keys"))


@query(f"""WITH {SQL_MENTIONS},{SQL_COMPANIES} SELECT m.id AS mention_id, strftime(m.published_at, '%Y-%m-%d') || '  ' || rpad(upper(sentiment), 11, ' ') || '  ' || rpad(name, 22, ' ') || '  ' || 'Order ' || m.id AS line
    FROM mentions m JOIN companies USING (company_id) WHERE relevant AND published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 480 HOUR""")
def alert_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.candidates(mentions(spark, sf).drop("published_at"), articles(spark, sf), companies(spark, sf), now(), 480)
    return found.select("mention_id", "line")


@query("""SELECT o_orderkey AS mention_id, channel FROM orders, (VALUES ('console'), ('file')) AS c(channel)
    WHERE o_orderpriority = '1-URGENT' AND NOT (o_orderstatus = 'F' AND channel = 'file')""")
def pending_alerts(spark: SparkSession, sf: str) -> DataFrame:
    relevant = mentions(spark, sf).where("relevant")
    due = relevant.select(F.col("id").alias("mention_id"))
    sent = relevant.where("sentiment = 'positive'").select(F.col("id").alias("mention_id"), F.lit("file").alias("channel"))
    return persist.pending_alerts(due, sent, ["console", "file"]).select("mention_id", "channel")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'old' ELSE 'new' END AS first_seen_at,
      CASE WHEN o_orderstatus <> 'F' THEN 'new' ELSE 'old' END AS label FROM orders""")
def upsert_preserve_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Stored: finished and partial orders; incoming: open and partial ones."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("first_seen_at"), F.lit("old").alias("label"))
    new = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("first_seen_at"), F.lit("new").alias("label"))
    return persist.upsert(old, new, ["id"], keep=("first_seen_at",))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'old' ELSE 'new' END AS label FROM orders")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("label"))
    new = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("label"))
    return persist.insert_if_absent(old, new.unionByName(new), ["id"], "label")[0]


# --- evaluation -------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    word = lambda c: F.when(c, "relevant").otherwise("irrelevant")
    return joined.select(word(F.col("quality") == 1).alias("actual"), word(F.length("text") > 1000).alias("predicted"))


SQL_PAIRS = """
    pairs AS (SELECT CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS actual,
      CASE WHEN length(text) > 1000 THEN 'relevant' ELSE 'irrelevant' END AS predicted FROM labels JOIN documents USING (doc_id)),
    wanted AS (SELECT unnest(['relevant', 'irrelevant', 'unclear']) AS label),
    counted AS (SELECT label, count(*) FILTER (WHERE actual = label) AS support,
      count(*) FILTER (WHERE actual = label AND predicted = label) AS tp,
      count(*) FILTER (WHERE predicted = label) AS predicted_as FROM wanted, pairs GROUP BY label),
    rates AS (SELECT *, coalesce(tp / nullif(predicted_as, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM counted),
    metrics AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates)"""
_LABELS = ("relevant", "irrelevant", "unclear")


@query(f"""WITH {SQL_PAIRS} SELECT a.label AS actual, p.label AS predicted,
    (SELECT count(*) FROM pairs WHERE actual = a.label AND predicted = p.label) AS n FROM wanted a, wanted p""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(_pairs(spark, sf), _LABELS)


@query(f"""WITH {SQL_PAIRS} SELECT label, support, tp, predicted_as, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM metrics""")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.class_metrics(_pairs(spark, sf), _LABELS)
    return m.select("label", "support", "tp", "predicted_as", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {SQL_PAIRS} SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(avg((actual = predicted)::INT), 9) FROM pairs) AS accuracy,
    (SELECT round(avg(f1), 9) FROM metrics) AS macro_f1""")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.scores(_pairs(spark, sf), _LABELS)
    return s.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE rn = least(n - 1, floor(n * 0.5))) AS p50,
      max(value) FILTER (WHERE rn = least(n - 1, floor(n * 0.95))) AS p95 FROM r GROUP BY event_type""")
def nearest_rank_latency(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.nearest_rank("value", ["event_type"], table(spark, sf, "events"), {"p50": 0.5, "p95": 0.95})


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("wall_ms"), (F.col("user_id") % 20).cast("double").alias("tokens_per_second"),
        (F.col("user_id") % 90).alias("output_tokens"), F.lit(600000.0).alias("total_ms"),
    )


@query("""WITH r AS (SELECT event_type AS model, value, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT model, count(*) AS samples, floor(coalesce(avg(CASE WHEN user_id % 20 > 0 THEN (user_id % 20)::DOUBLE END), 0) * 10 + 0.5) / 10 AS mean_tokens_per_second,
      floor(avg(user_id % 90) + 0.5)::BIGINT AS mean_output_tokens,
      max(value) FILTER (WHERE rn = least(n - 1, floor(n * 0.5))) AS p50_wall_ms, max(value) FILTER (WHERE rn = least(n - 1, floor(n * 0.95))) AS p95_wall_ms,
      floor(count(*) * 60000.0::DOUBLE / 600000.0::DOUBLE * 10 + 0.5) / 10 AS throughput_per_minute,
      floor(2000 / (count(*) * 60000.0::DOUBLE / 600000.0::DOUBLE) * 10 + 0.5) / 10 AS projected_minutes FROM r GROUP BY model""")
def bench_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bench_rows(_samples(spark, sf), ["model"])


@query("""WITH g AS (SELECT event_type AS model, rank() OVER (ORDER BY event_type) AS ladder, round(avg(value), 6) / 1000 AS combined FROM events GROUP BY event_type)
    SELECT arg_min(model, ladder) FILTER (WHERE combined = (SELECT max(combined) FROM g)) AS best,
      arg_min(model, ladder) FILTER (WHERE combined >= (SELECT max(combined) FROM g) - 0.02) AS ship, round(max(combined), 9) AS best_combined FROM g""")
def ship_rule(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg((F.round(F.avg("value"), 6) / 1000).alias("relevance_f1"))
    g = g.withColumn("sentiment_f1", F.col("relevance_f1")).withColumn("ladder", F.rank().over(Window.orderBy("model")))
    return evaluate.ship_choice(g).withColumn("best_combined", F.round("best_combined", 9))


@query("""WITH j AS (SELECT CASE lang WHEN 'en' THEN 'critical' WHEN 'de' THEN 'high' ELSE 'low' END AS tier, quality = 1 AS hit,
      CASE WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS s, CASE WHEN doc_id % 3 = 0 THEN 'negative' WHEN doc_id % 3 = 1 THEN 'neutral' END AS a
      FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT *, unnest(['all', CASE WHEN tier IN ('critical', 'high') THEN 'critical+high' ELSE 'medium+low' END]) AS tiers FROM j),
    c AS (SELECT tiers, count(*) AS reviewed, count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE hit AND a IS NOT NULL) AS sentiment_judged,
      count(*) FILTER (WHERE hit AND a = s) AS sentiment_correct FROM t GROUP BY tiers)
    SELECT *, CASE WHEN reviewed = 0 THEN 'n/a' ELSE floor(correct * 100.0 / reviewed + 0.5)::BIGINT || '%' END AS precision,
      CASE WHEN sentiment_judged = 0 THEN 'n/a' ELSE floor(sentiment_correct * 100.0 / sentiment_judged + 0.5)::BIGINT || '%' END AS sentiment_accuracy FROM c""")
def spot_check_report(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return evaluate.spot_check(j.select(
        F.when(F.col("lang") == "en", "critical").when(F.col("lang") == "de", "high").otherwise("low").alias("tier"),
        (F.col("quality") == 1).alias("relevant_actually"), F.when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("sentiment"),
        F.when(F.col("doc_id") % 3 == 0, "negative").when(F.col("doc_id") % 3 == 1, "neutral").alias("sentiment_actually"),
    ))


# --- repair and JSON --------------------------------------------------------------------------


@query(r"""SELECT event_id, round(CASE WHEN n IS NULL THEN 0.5 WHEN n > 1 THEN least(1, n / 100) ELSE greatest(0, n) END, 9) AS confidence FROM
    (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE nullif(regexp_extract(CASE WHEN event_id % 3 = 0 THEN value || '%' ELSE value::VARCHAR END, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'), '')::DOUBLE END AS n FROM events)""")
def confidence_repair(spark: SparkSession, sf: str) -> DataFrame:
    n, raw = F.col("event_id"), F.col("value").cast("string")
    given = F.when(n % 7 == 0, "high").when(n % 3 == 0, F.concat(raw, F.lit("%"))).otherwise(raw)
    return table(spark, sf, "events").select("event_id", F.round(repair.to_confidence(given), 9).alias("confidence"))


_MOODS = ["Positive", "good ", "NEG", "mixed", "n/a", "not applicable", "", "Balanced", "great", "Irrelevant"]
_MOOD_LABELS = ["positive", "positive", "negative", "neutral", None, None, None, "neutral", None, None]
_sql_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


@query(f"SELECT conv_id, turn, {_sql_list(_MOOD_LABELS)}[(conv_id + turn) % 10 + 1] AS label, (conv_id + turn) % 10 <> 8 AS known FROM conversations")
def sentiment_repair(spark: SparkSession, sf: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _MOODS)), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", repair.to_sentiment(word)["label"].alias("label"), repair.to_sentiment(word)["known"].alias("known"))


#: An answer of each type as a model may give it, and what it comes to: relevant, sentiment, confidence, error.
_ANSWERS = (
    ('{"relevant": true, "sentiment": "Positive", "confidence": 0.9}', (True, "positive", 0.9, None)),
    ('{"relevant": 1.0, "sentiment": "neg", "confidence": "85%"}', (True, "negative", 0.85, None)),
    ('{"relevant": 2, "sentiment": "mixed", "confidence": 40}', (True, "neutral", 0.4, None)),
    ('{"relevant": "2", "sentiment": "bad"}', (False, None, 0.5, None)),
    ('{"relevant": "Yes", "sentiment": "great", "confidence": "high"}', (True, None, 0.5, 'unrecognised sentiment: "great"')),
    ('{"relevant": 0, "sentiment": null, "confidence": -3}', (False, None, 0.0, None)),
    ('Sure! {"relevant": "relevant", "sentiment": "n/a"} as asked', (True, None, 0.5, "relevant article returned no sentiment")),
    ('{"relevant": null, "sentiment": "good"}', None),
    ('{"relevant": true, "sentiment": 3}', None),
    ("I cannot tell.", None),
)


def _said(at: int, kind: str) -> str:
    """SQL of one field of what the answer by number comes to."""
    literal = lambda v: f"NULL::{kind}" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) + f"::{kind}" if not isinstance(v, str) else f"'{v}'"
    return "CASE (conv_id * 7 + turn) % 10 " + " ".join(f"WHEN {n} THEN {literal(w and w[at])}" for n, (_, w) in enumerate(_ANSWERS)) + " END"


@query(f"""SELECT conv_id, turn, (conv_id * 7 + turn) % 10 < 7 AS usable, {_said(0, "BOOLEAN")} AS relevant, {_said(1, "VARCHAR")} AS sentiment,
    {_said(2, "DOUBLE")} AS confidence, {_said(3, "VARCHAR")} AS repair_error FROM conversations""")
def typed_answers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(a) for a, _ in _ANSWERS]), ((F.col("conv_id") * 7 + F.col("turn")) % 10 + 1).cast("int"))
    parsed = table(spark, sf, "conversations").select("conv_id", "turn", repair.parse_answer(raw).alias("answer"))
    made = F.when(F.col("answer").isNotNull(), repair.repair_answer(F.col("answer")))
    fields = [made[f].alias(f) for f in ("relevant", "sentiment", "confidence", "repair_error")]
    return parsed.select("conv_id", "turn", F.col("answer").isNotNull().alias("usable"), *fields)


@query("""SELECT conv_id, turn, lower(trim(word)) IN ('true', 'yes', 'y', '1', 'relevant') AS relevant FROM
    (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN role ELSE NULL END AS word FROM conversations)
    WHERE word IS NOT NULL UNION ALL SELECT conv_id, turn, false FROM conversations WHERE (conv_id + turn) % 6 = 5""")
def boolean_repair(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 6
    word = F.when(k == 0, "Yes").when(k == 1, " TRUE ").when(k == 2, "1").when(k == 3, "no").when(k == 4, F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", repair.to_boolean_text(word).alias("relevant"))


@query(r"SELECT event_id, regexp_extract(props, '\"k\"\s*:\s*(-?\d+)', 1)::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    parsed = repair.tolerant_json("props", "k BIGINT", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query(r"SELECT event_id, regexp_extract(props, '\{[^}]*\}') AS found FROM events")
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit('Sure: "quoted" '), "props", F.lit(" done }"))
    return table(spark, sf, "events").select("event_id", repair.extract_json_object(wrapped).alias("found"))


# --- registry, classification, streaming ------------------------------------------------------


SQL_REGISTRY = """
    c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, c_nationkey AS nation, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS sq,
      c_custkey % 4 <> 3 AS triaged, c_custkey % 5 = 1 AS enriched, CASE WHEN c_custkey % 6 = 0 THEN 'LOW' WHEN c_custkey % 3 = 0 THEN 'CRITICAL'
        WHEN c_custkey % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM customer),
    registry AS (SELECT n AS name, CASE WHEN triaged THEN lower(tier) WHEN enriched THEN 'medium' ELSE 'low' END AS ambiguity,
      CASE WHEN triaged AND k % 2 = 0 THEN 'high' ELSE 'normal' END AS volume,
      CASE WHEN triaged AND tier = 'CRITICAL' THEN '"' || n || '" AND "' || seg || '"' WHEN enriched THEN '"' || n || '" AND ("cloud" OR "edge")'
        WHEN triaged THEN '"' || n || '" AND "' || seg || '"' ELSE '"' || n || '"' END AS query,
      CASE WHEN triaged AND tier = 'CRITICAL' THEN 'human-approved' WHEN enriched THEN 'llm-enriched' WHEN triaged THEN 'triage-default' ELSE 'fallback' END AS query_source,
      coalesce(CASE WHEN enriched AND k % 2 = 1 THEN 'Sector ' || nation END, CASE WHEN triaged AND k % 5 <> 0 THEN seg END) AS sector,
      list_concat(CASE WHEN triaged THEN ['fake ' || k] ELSE [] END, CASE WHEN enriched THEN ['fan club'] ELSE [] END)::VARCHAR[] AS negative_keywords,
      CASE WHEN enriched THEN [n || ' Labs'] ELSE []::VARCHAR[] END AS aliases,
      CASE WHEN enriched AND k % 10 = 1 THEN 'https://www.' || sq || '.example' END AS domain FROM c)"""


def _built_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of the customers: a seed of all, triage of three in four (some twice), enrichment of two in five."""
    c, k, n = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_name")
    seed = c.select(k.alias("index"), n.alias("name"))
    triage = c.where(k % 4 != 3).select(
        k.alias("position"), F.lower(n).alias("name"), F.when(k % 3 == 0, "CRITICAL").when(k % 3 == 1, "MEDIUM").otherwise("LOW").alias("tier"),
        F.when(k % 2 == 0, "HIGH").otherwise("NORMAL").alias("volume"), F.concat(text.quote(n), F.lit(" AND "), text.quote("c_mktsegment")).alias("query"),
        F.concat(F.lit('"fake '), k.cast("string"), F.lit('", —')).alias("neg"), F.when(k % 5 == 0, "TBD later").otherwise(F.col("c_mktsegment")).alias("sector"),
    )
    again = triage.where("position % 6 = 0").withColumn("position", F.col("position") + 1_000_000_000).withColumn("tier", F.lit("LOW"))
    host = F.when(k % 10 == 1, text.squash(n)).otherwise("other")
    enriched = c.where((k % 5).isin(1, 2)).select(
        n.alias("name"), (k % 5 == 1).alias("known"), F.when(k % 2 == 0, "N/A").otherwise(F.concat(F.lit("Sector "), F.col("c_nationkey").cast("string"))).alias("sector"),
        F.array(F.concat(n, F.lit(" Labs")), F.lit("Other"), F.upper(n)).alias("aliases"), F.concat(F.lit("https://www."), host, F.lit(".example")).alias("domain"),
        F.lit("medium").alias("ambiguity"), F.array(F.lit("cloud"), F.lit(" edge ")).alias("context_terms"),
        F.array(F.lit("fan club"), n, F.lit("Fan Club")).alias("negative_keywords"),
    )
    return registry_build.build_registry(seed, triage.unionByName(again), enriched, "offline", now())


@query(f"WITH {SQL_REGISTRY} SELECT * FROM registry")
def registry_build_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return _built_registry(spark, sf).select("name", "ambiguity", "volume", "query", "query_source", "sector", "negative_keywords", "aliases", "domain")


@query(f"""WITH {SQL_REGISTRY} SELECT count(*) AS total, count(*) FILTER (WHERE query_source = 'human-approved') AS human_approved,
    count(*) FILTER (WHERE query_source = 'llm-enriched') AS llm_enriched, count(*) FILTER (WHERE query_source = 'triage-default') AS triage_default,
    count(*) FILTER (WHERE query_source = 'fallback') AS fallback, count(*) FILTER (WHERE ambiguity = 'critical') AS critical,
    count(*) FILTER (WHERE ambiguity = 'high') AS high, count(*) FILTER (WHERE ambiguity = 'medium') AS medium, count(*) FILTER (WHERE ambiguity = 'low') AS low,
    count(*) FILTER (WHERE volume = 'high') AS high_volume, count(*) FILTER (WHERE sector <> '') AS with_sector FROM registry""")
def registry_totals(spark: SparkSession, sf: str) -> DataFrame:
    return registry_build.registry_summary(_built_registry(spark, sf))


@query("""SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS "index", s_name AS name FROM supplier WHERE s_suppkey % 5 IN (1, 3)""")
def seed_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as lines of a list: comments, two numberings, blank lines, names again in capitals."""
    k, n, number = F.col("s_suppkey") % 5, F.col("s_name"), F.col("s_suppkey").cast("string")
    again = F.concat(F.regexp_extract(F.upper(n), r"^\D*", 0), F.lpad((F.col("s_suppkey") - 1).cast("string"), 9, "0"))
    line = F.when(k == 0, F.concat(F.lit("# "), n)).when(k == 1, F.concat(number, F.lit(". "), n)).when(k == 2, again)
    line = line.when(k == 3, F.concat(F.lit(" "), number, F.lit("\t"), n, F.lit(" "))).otherwise("")
    return registry_build.parse_seed(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), line.alias("value")))


def _triage_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as lines of triage, in eight a kind: sound, and with each sort of fault, some with two."""
    k, lit = F.col("c_custkey"), F.lit
    said = lambda name, value: F.concat(lit(f'"{name}":'), value)
    word = lambda c: F.concat(lit('"'), c, lit('"'))
    fields = [
        said("idx", F.when(k % 8 == 1, "0").when(k % 8 == 2, F.concat(k.cast("string"), lit(".5"))).otherwise((k + 1).cast("string"))),
        said("name", F.when(k % 8 == 3, '""').otherwise(word("c_name"))),
        said("tier", F.when(k % 24 == 1, '"URGENT"').otherwise('"HIGH"')),
        F.when(k % 8 != 4, said("volume", lit('"NORMAL"'))),
        said("reason", F.when(k % 8 == 5, "null").otherwise('""')),
        said("query", word("c_name")), said("neg", lit('"—"')), said("sector", word("c_mktsegment")),
    ]
    line = F.concat(lit("{"), F.concat_ws(",", *fields), F.when(k % 8 == 6, "").otherwise("}"))
    line = F.when(k % 8 == 7, F.concat(lit("["), line, lit(","), k.cast("string"), lit("]"))).otherwise(line)
    return records.parse_records(table(spark, sf, "customer").select("c_custkey", line.alias("value")))


@query("""SELECT c_custkey, 0 AS at, 'idx' AS field, 'too small' AS problem, '0' AS found FROM customer WHERE c_custkey % 8 = 1
    UNION ALL SELECT c_custkey, 0, 'idx', 'type', c_custkey || '.5' FROM customer WHERE c_custkey % 8 = 2
    UNION ALL SELECT c_custkey, 0, 'name', 'too small', '""' FROM customer WHERE c_custkey % 8 = 3
    UNION ALL SELECT c_custkey, 0, 'tier', 'choice', '"URGENT"' FROM customer WHERE c_custkey % 24 = 1
    UNION ALL SELECT c_custkey, 0, 'volume', 'missing', NULL FROM customer WHERE c_custkey % 8 = 4
    UNION ALL SELECT c_custkey, 0, 'reason', 'null', 'null' FROM customer WHERE c_custkey % 8 = 5
    UNION ALL SELECT c_custkey, 0, NULL, 'json', NULL FROM customer WHERE c_custkey % 8 = 6
    UNION ALL SELECT c_custkey, 1, NULL, 'object', c_custkey::VARCHAR FROM customer WHERE c_custkey % 8 = 7""")
def record_faults(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = records.split_records(_triage_lines(spark, sf), records.TRIAGE_RECORD)
    return bad.select("c_custkey", "at", F.explode("faults").alias("f")).select("c_custkey", "at", "f.*")


@query("SELECT c_custkey + 1 AS idx, c_name AS name, 'HIGH' AS tier, 'NORMAL' AS volume, c_mktsegment AS sector FROM customer WHERE c_custkey % 8 IN (0, 7)")
def accepted_records(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = records.split_records(_triage_lines(spark, sf), records.TRIAGE_RECORD)
    return good.select("idx", "name", "tier", "volume", "sector")


@query(r"""WITH p AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS nation FROM supplier)
    SELECT k, 'Company: ' || n || CASE WHEN k % 3 = 0 THEN '' ELSE chr(10) || 'Sector: S' || nation END
      || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Also written as: a' || k ELSE chr(10) || 'Also written as: a, b, c' END
      || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN chr(10) || chr(10) || 'EXCLUDE — if the headline is about any of these, answer relevant: false:' || chr(10) || '  - x' || nation
        ELSE chr(10) || chr(10) || 'EXCLUDE — if the headline is about any of these, answer relevant: false:' || chr(10) || '  - 1' || chr(10) || '  - 2' || chr(10) || '  - 3' || chr(10) || '  - 4' || chr(10) || '  - 5' END
      || chr(10) || chr(10) || 'Headline: News of ' || n AS prompt FROM p""")
def classify_prompts(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("s_suppkey"), F.array().cast("array<string>")
    of = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    sector = F.when(k % 3 == 1, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).when(k % 3 == 2, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).otherwise("")
    aliases = F.when(k % 4 == 1, of("", F.concat(F.lit("a"), k.cast("string")))).when(k % 4 != 0, of("a", "", "b", "c", "d"))
    left_out = F.when(k % 5 == 1, of(" ", "")).when(k % 5 == 2, of(" ", F.concat(F.lit(" x"), F.col("s_nationkey").cast("string"))))
    left_out = left_out.when(k % 5 == 0, none).otherwise(of("1", " 2 ", "3", "4", " ", "5", "6"))
    prompt = text.classify_prompt(F.col("s_name"), sector, aliases, left_out, F.concat(F.lit("  News of "), "s_name", F.lit(" ")))
    return table(spark, sf, "supplier").select(k.alias("k"), prompt.alias("prompt"))


@query("""SELECT o_orderkey AS item, c_mktsegment AS sector, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0""")
def gold_context(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as gold items; one customer in four is not in the registry."""
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("company"))
    known = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("sector"), F.lit(True).alias("known"))
    return evaluate.with_context(items, known).select("item", "sector", F.coalesce("known", F.lit(False)).alias("known"))


def _every_kind(prompts: list[str]) -> list[str | None]:
    """A stand-in model: an answer of each kind by the number in the headline, some calls failed."""
    numbers = [int(re.search(r"(\d+)\D*$", p)[1]) for p in prompts]
    return [_ANSWERS[n % 11][0] if n % 11 < 10 else None for n in numbers]


_by_number = lambda at, kind: _said(at, kind).replace("(conv_id * 7 + turn) % 10", "m.id % 11")


@query(f"""WITH {SQL_MENTIONS} SELECT m.id, {_by_number(0, "BOOLEAN")} AS relevant, {_by_number(1, "VARCHAR")} AS sentiment, {_by_number(2, "DOUBLE")} AS confidence
    FROM mentions m WHERE classified_at IS NULL AND m.id % 11 IN (0, 1, 2, 3, 5)""")
def classify_pending(spark: SparkSession, sf: str) -> DataFrame:
    waiting = mentions(spark, sf).where("classified_at IS NULL").drop("published_at", "sentiment", "relevant")
    named = waiting.join(companies(spark, sf), "company_id").join(articles(spark, sf), "article_id")
    none = F.array().cast("array<string>")
    named = named.select("id", "company_id", "article_id", F.col("name").alias("company"), "sector", none.alias("aliases"), none.alias("negative_keywords"), "title")
    cache = spark.createDataFrame([], "key string, raw string")
    done, _ = classify.classify(named, cache, _every_kind, "offline", "v1@0")
    return classify.results(done, "offline", "v1@0", now()).select("id", "relevant", "sentiment", "confidence")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = daily.windowed_counts(table(spark, sf, "events"), "ts", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT CASE WHEN days IS NULL THEN 'NO_COVERAGE' WHEN days <= 7 THEN 'FRESH' WHEN days <= 30 THEN 'RECENT' WHEN days <= 90 THEN 'STALE' ELSE 'DORMANT' END AS bucket,
      count(*) AS n FROM (SELECT greatest(0, datediff('second', o_orderdate, TIMESTAMP '2001-08-01') // 86400) AS days FROM orders) GROUP BY 1""")
def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    days = dates.days_since("o_orderdate", now())
    return table(spark, sf, "orders").groupBy(dates.bucket(days).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS seen FROM events GROUP BY ALL)
    SELECT 0 AS batch, 'file' AS channel, count(*) AS new_mentions, 'sent' AS outcome,
      count(*) FILTER (WHERE event_type = 'purchase' AND seen >= TIMESTAMP '2024-01-31' - INTERVAL 40 DAY AND user_id IN (SELECT c_custkey FROM customer)) AS delivered FROM f
    UNION ALL SELECT 1, 'file', 0, 'nothing-new', 0""")
def daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The daily check over the events, landed twice: the second time it finds nothing new."""
    root = daily.work_folder(spark, "daily-stream")
    said = []
    for _ in range(2):
        table(spark, sf, "events").write.mode("append").parquet(f"{root}/landed")
        said += daily.run_daily(
            spark, f"{root}/landed", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
            _event_mentions, companies(spark, sf), root, {"file": alerts.json_sink(f"{root}/alerts")}, F.lit("2024-01-31").cast("timestamp"),
            "id string, company_id bigint, article_id string, relevant boolean, sentiment string",
            "article_id string, published_at timestamp, title string, url string", lookback_hours=24 * 40,
        )
    rows = [(i, r["channel"], r["new_mentions"], r["delivered"], r["outcome"]) for i, r in enumerate(said)]
    return spark.createDataFrame(rows, "batch int, channel string, new_mentions long, delivered long, outcome string")


@query("""WITH e AS (SELECT user_id || ':' || event_type AS key, event_id % 2 AS b, ts FROM events),
    f AS (SELECT key, min(ts) FILTER (WHERE b = 0) AS even, min(ts) FILTER (WHERE b = 1) AS odd FROM e GROUP BY key)
    SELECT key, strftime(coalesce(even, odd), '%Y-%m-%d %H:%M:%S.%f') AS first_at,
      (SELECT count(*) FROM e WHERE e.key = f.key AND e.b = 1 AND e.ts < f.even) AS late FROM f""")
def first_seen_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events of even number land first, then the others: when each key was first seen, and how many rows came late."""
    root = daily.work_folder(spark, "first-seen")
    first_seen.use_state_store(spark)
    e = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select("key", "at").write.mode("append").parquet(f"{root}/landed")
        rows = spark.readStream.schema("key string, at timestamp").parquet(f"{root}/landed")
        made = first_seen.first_seen(rows, "key", "at").writeStream.option("checkpointLocation", f"{root}/checkpoint").format("parquet")
        made.trigger(availableNow=True).start(f"{root}/seen").awaitTermination()
    seen = spark.read.schema("key string, at timestamp, kind string").parquet(f"{root}/seen")
    at = F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    first = seen.where("kind = 'first'").groupBy("key").agg(at.alias("first_at"))
    late = seen.where("kind = 'late'").groupBy("key").agg(F.count("*").alias("late"))
    return first.join(late, "key", "left").fillna(0, ["late"])


@query(f"""SELECT (page_id % 5)::VARCHAR AS company_id, 'p' || page_id % 3 AS provider, url,
      strftime(TIMESTAMP '{NOW_TEXT}' - INTERVAL (page_id % 40) DAY, '%Y-%m-%d') AS day
    FROM pages WHERE page_id % 17 <> 0 AND page_id % 5 IN (1, 3) AND page_id % 40 BETWEEN 1 AND 9""")
def landed_window(spark: SparkSession, sf: str) -> DataFrame:
    """Pages landed as payloads by company and provider, read through the source with companies and window pushed into it."""
    n = F.col("page_id")
    at = F.when(n % 17 != 0, F.date_format(now() - F.make_dt_interval((n % 40).cast("int")), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    given = table(spark, sf, "pages").select((n % 5).alias("company"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("provider"), "url", at.alias("published_at"))
    path = f"{daily.work_folder(spark, 'landed')}/in"
    given.write.partitionBy("company", "provider").json(path)
    landed.register(spark)
    rows = spark.read.format("landed").load(path).where(F.col("company_id").isin("1", "3"))
    rows = rows.where((F.col("published_at") >= now() - F.expr("interval 9 days")) & (F.col("published_at") < now()))
    return rows.select("company_id", "provider", "url", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("""WITH d AS (SELECT unnest(generate_series(DATE '2001-05-01', DATE '2001-07-31', INTERVAL 1 DAY))::DATE AS day)
    SELECT c_custkey AS company_id, strftime(day, '%Y-%m-%d') AS day,
      (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate::DATE <= day AND o_orderdate::DATE > day - INTERVAL 90 DAY) AS mentions
    FROM customer CROSS JOIN d""")
def coverage_series(spark: SparkSession, sf: str) -> DataFrame:
    published = mentions(spark, sf).where("relevant")
    made = status.coverage_series(companies(spark, sf), published, "2001-05-01", "2001-07-31")
    return made.select("company_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "mentions")


@query("""WITH c AS (SELECT event_type AS provider, ts, event_id, event_id % 50 = 0 AS stop, event_id % 50 = 0 OR user_id % 3 <> 0 AS bad FROM events),
    r AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY provider ORDER BY ts, event_id) AS run FROM c),
    n AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY provider, run ORDER BY ts, event_id) AS failures FROM r),
    o AS (SELECT *, max(CASE WHEN bad AND (stop OR failures >= 3) THEN ts END) OVER (PARTITION BY provider, run ORDER BY ts, event_id) AS opened FROM n),
    m AS (SELECT *, lag(opened) OVER (PARTITION BY provider ORDER BY ts, event_id) AS before FROM o)
    SELECT event_id, CASE WHEN before IS NULL THEN 'closed' WHEN epoch_us(ts) - epoch_us(before) >= 3600000000 THEN 'half-open' ELSE 'open' END AS met,
      failures, strftime(opened, '%Y-%m-%d %H:%M:%S.%f') AS opened_at FROM m""")
def breaker_history(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of five providers: most fail, every fiftieth is a rate limit."""
    said = F.when(F.col("event_id") % 50 == 0, "rate-limited").when(F.col("user_id") % 3 != 0, "failure").otherwise("success")
    calls = table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), said.alias("outcome"))
    made = breaker.history(calls, cool_down=3600)
    return made.select(F.col("seq").alias("event_id"), "met", "failures", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened_at"))


SQL_LEDGER = """
    l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS label,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'first' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS seen
      FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"""


@query(f"WITH {SQL_LEDGER} SELECT label, seen, count(*) AS n, sum(id)::BIGINT AS ids FROM l GROUP BY label, seen")
def ledger_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written to a table by key in three batches: half inserted, a third upserted, the half offered again."""
    books = Ledger(spark, daily.work_folder(spark, "ledger"), {"orders": Keyed("id bigint, label string, seen string", ("id",), 16)})
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = lambda x, label: o.where(x).select("id", F.lit(label).alias("label"), F.lit(label).alias("seen"))
    orders = books.table("orders")
    orders.insert(rows("id % 2 = 0", "first"))
    orders.upsert(rows("id % 3 = 0", "second"), keep=("seen",))
    orders.insert(rows("id % 2 = 0", "third"))
    return orders.read().groupBy("label", "seen").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _event_mentions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    first = rows.groupBy("user_id", "event_type").agg(F.min("ts").cast("timestamp").alias("published_at"))
    first = first.select(key.alias("id"), F.col("user_id").alias("company_id"), key.alias("article_id"), "published_at", "event_type")
    found = first.select("id", "company_id", "article_id", (F.col("event_type") == "purchase").alias("relevant"), F.lit("neutral").alias("sentiment"))
    return found, first.select("article_id", "published_at", F.col("event_type").alias("title"), F.concat(F.lit("https://example.com/"), "article_id").alias("url"))


# --- whole runs, exports, scores --------------------------------------------------------------


def _order_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw items of five companies; titles repeat, and every eleventh is blank."""
    n, title = F.col("o_orderkey"), F.concat_ws(" ", F.lit("Order"), "o_orderpriority", (F.col("o_custkey") % 101).cast("string"))
    return table(spark, sf, "orders").select(
        n.alias("position"), (F.col("o_custkey") % 5).alias("company_id"),
        F.concat(F.lit("https://example.com/"), n.cast("string")).alias("url"), F.when(n % 11 == 0, " ").otherwise(title).alias("title"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("source_name"), now().alias("published_at"),
    )


def _order_companies(spark: SparkSession) -> DataFrame:
    """Six companies: the third is named in no title, the last has no item."""
    none = F.array().cast("array<string>")
    named = F.when(F.col("id") == 2, "Parcel").otherwise("Order")
    return spark.range(6).select(
        F.col("id").alias("company_id"), named.alias("name"), F.lit(None).cast("string").alias("sector"), none.alias("aliases"),
        F.array(F.lit("urgent")).alias("negative_keywords"), F.lit('"Order"').alias("query"), F.lit("human-approved").alias("query_source"),
        F.when(F.col("id") < 2, "high").alias("ambiguity"),
    )


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(s) for s in collect.CALL_STATES]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf, "supplier").select((F.col("s_suppkey") % 5).alias("company_id"), F.col("s_name").alias("provider"), said.alias("status"))


SQL_RUN = """
    i AS (SELECT o_custkey % 5 AS company_id, o_orderkey AS pos, o_orderpriority AS p, o_custkey % 101 AS k, o_orderkey % 11 <> 0 AS good FROM orders),
    unique_ AS (SELECT company_id, p, k, min(pos) AS pos, CASE WHEN company_id = 2 THEN 'no-name-match' WHEN p = '1-URGENT' THEN 'negative-keyword' END AS reason
      FROM i WHERE good GROUP BY company_id, p, k)"""


@query(f"""WITH {SQL_RUN}, a AS (SELECT company_id, count(*) AS fetched, count(*) FILTER (WHERE good) AS normalized FROM i GROUP BY 1),
    b AS (SELECT company_id, count(*) AS deduped, count(*) FILTER (WHERE reason IS NULL) AS kept FROM unique_ GROUP BY 1),
    c AS (SELECT s_suppkey % 5 AS company_id, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS ok, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS failed,
      count(*) FILTER (WHERE s_suppkey % 3 = 2) AS skipped FROM supplier GROUP BY 1)
    SELECT x.company_id, coalesce(fetched, 0) AS fetched, coalesce(normalized, 0) AS normalized, coalesce(deduped, 0) AS deduped, coalesce(kept, 0) AS kept,
      greatest(coalesce(kept, 0) - 25, 0) AS capped, coalesce(ok, 0) AS providers_ok, coalesce(failed, 0) AS providers_failed, coalesce(skipped, 0) AS providers_skipped
    FROM (SELECT unnest(range(6)) AS company_id) x LEFT JOIN a USING (company_id) LEFT JOIN b USING (company_id) LEFT JOIN c USING (company_id)""")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return collect.collect(_order_items(spark, sf), _order_companies(spark), _calls(spark, sf))[2]


SQL_OUTCOMES = """
    calls AS (SELECT o_custkey AS company_id, 'p' || o_orderkey % 3 AS provider, o_orderkey % 8 = 0 AS ok,
      CASE WHEN o_orderkey % 8 = 1 THEN 'error ' || o_orderstatus WHEN o_orderkey % 8 <> 0 THEN 'skipped' END AS said FROM orders),
    each AS (SELECT company_id, provider, count(*) FILTER (WHERE ok) AS ok, min(said) AS said FROM calls GROUP BY ALL),
    asked AS (SELECT company_id, sum(ok)::BIGINT AS providers_ok, string_agg(provider || ': ' || said, '; ' ORDER BY provider) AS warnings FROM each GROUP BY 1),
    k AS (SELECT o_custkey AS company_id, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS kept FROM orders GROUP BY 1),
    outcomes AS (SELECT c_custkey AS company_id, coalesce(kept, 0) AS kept, coalesce(providers_ok, 0) AS providers_ok, warnings,
      CASE WHEN coalesce(providers_ok, 0) = 0 THEN warnings END AS error
      FROM customer LEFT JOIN k ON k.company_id = c_custkey LEFT JOIN asked ON asked.company_id = c_custkey)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls to three sources: one in eight answered, one failed, the others skipped."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    calls = o.select(
        F.col("o_custkey").alias("company_id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"),
        F.when(k % 8 == 0, "ok").when(k % 8 == 1, "failed").otherwise("skipped").alias("status"),
        F.when(k % 8 == 1, F.concat(F.lit("error "), "o_orderstatus")).alias("detail"),
    )
    kept = o.groupBy(F.col("o_custkey").alias("company_id")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("kept"))
    return collect.company_outcomes(companies(spark, sf), calls, kept)


@query(f"WITH {SQL_OUTCOMES} SELECT * FROM outcomes")
def company_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf)


@query(f"""WITH {SQL_OUTCOMES} SELECT count(*) AS companies, count(error) AS failures, count(*) FILTER (WHERE error IS NULL AND kept = 0) AS no_coverage,
    CASE WHEN count(*) = count(error) THEN 'failed' ELSE 'completed' END AS status FROM outcomes""")
def run_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return classify.run_status(_outcomes(spark, sf))


@query(f"WITH {SQL_MENTIONS} SELECT id FROM mentions WHERE classified_at IS NULL ORDER BY id LIMIT 500")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    return status.pending(mentions(spark, sf)).select("id")


@query("SELECT o_orderkey AS mention_id, channel FROM orders, (VALUES ('console'), ('file')) AS c(channel) ORDER BY o_orderdate DESC NULLS LAST, 1, 2 LIMIT 50")
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(F.lit("console"), F.lit("file"))).alias("channel")
    sent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderdate").alias("sent_at"), both)
    return status.recent_alerts(sent).select("mention_id", "channel")


@query(f"""WITH {SQL_RUN}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS rn FROM unique_ WHERE reason IS NULL)
    SELECT company_id, 'https://example.com/' || pos AS url, true AS relevant, NULL AS rejection_reason, 'neutral' AS sentiment, 0.6::DOUBLE AS confidence FROM r WHERE rn <= 25
    UNION ALL SELECT company_id, 'https://example.com/' || pos, false, reason, NULL, NULL FROM unique_ WHERE reason IS NOT NULL""")
def run_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The mentions after a whole run and after it was run again, which changes nothing."""
    store, args = run.Store(spark, daily.work_folder(spark, "run")), (_order_companies(spark), _calls(spark, sf))
    for again in ("first", "second"):
        run.run_pipeline(_order_items(spark, sf), *args, store, classify.keyword_model, "offline", "v1@0", again, now())
    found = store.mentions.read().join(store.articles.read(), "article_id")
    return found.select("company_id", "url", "relevant", "rejection_reason", "sentiment", "confidence")


@query(f"""WITH {SQL_COMPANIES},{SQL_MENTIONS} SELECT company_id, c.name AS company, article_id, 'Order ' || article_id AS title,
      'https://example.com/' || article_id AS url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, sentiment
    FROM mentions m JOIN companies c USING (company_id) WHERE relevant AND classified_at IS NOT NULL""")
def export_mentions(spark: SparkSession, sf: str) -> DataFrame:
    out = exports.mention_export(mentions(spark, sf), articles(spark, sf), companies(spark, sf))
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {SQL_ROLLUP}, e AS (SELECT m.* FROM mentions m JOIN companies USING (company_id) WHERE relevant AND classified_at IS NOT NULL),
    top AS (SELECT name, mentions_in_window, status FROM rollup_ ORDER BY mentions_in_window DESC, name LIMIT 20)
    SELECT 'companies' AS part, NULL AS name, count(*) AS n FROM rollup_ UNION ALL SELECT 'mentions', NULL, count(*) FROM e
    UNION ALL SELECT 'status', status, count(*) FROM rollup_ GROUP BY status UNION ALL SELECT 'month', strftime(published_at, '%Y-%m'), count(*) FROM e GROUP BY 2
    UNION ALL SELECT 'top', name, mentions_in_window FROM top""")
def export_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary as it reads back from the written JSON."""
    made = exports.export_all(_rollup(spark, sf), mentions(spark, sf), articles(spark, sf), companies(spark, sf), daily.work_folder(spark, "exports"), now())
    schema = "totals struct<companies: long, mentions: long>, companies_by_status map<string, long>, mentions_by_month map<string, long>, top_companies array<struct<name: string, mentions: long>>"
    one = spark.read.schema(schema).json(made["quarterly_summary"])
    parts = [one.select(F.lit(p).alias("part"), F.lit(None).cast("string").alias("name"), F.col(f"totals.{p}").alias("n")) for p in ("companies", "mentions")]
    parts += [one.select(F.lit(p).alias("part"), F.explode(c).alias("name", "n")) for p, c in (("status", "companies_by_status"), ("month", "mentions_by_month"))]
    parts.append(one.select(F.inline("top_companies")).select(F.lit("top").alias("part"), "name", F.col("mentions").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"WITH {SQL_COMPANIES},{SQL_MENTIONS} SELECT id, coalesce(ambiguity, 'low') AS tier FROM mentions LEFT JOIN companies USING (company_id)")
def mention_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.with_tier(mentions(spark, sf), companies(spark, sf)).select("id", "tier")


def _f1(pairs: str, labels: str) -> str:
    """SQL of the macro F1 of a table of pairs over a list of labels."""
    return f"""(SELECT round(avg(coalesce(2.0 * tp / nullif(a + p, 0), 0)), 9) FROM (SELECT l, count(*) FILTER (WHERE actual = l) AS a,
      count(*) FILTER (WHERE predicted = l) AS p, count(*) FILTER (WHERE actual = l AND predicted = l) AS tp
      FROM (SELECT unnest([{labels}]) AS l) LEFT JOIN {pairs} ON true GROUP BY l))"""


@query(f"""WITH g AS MATERIALIZED (SELECT quality = 1 AS gold, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS mood,
      CASE WHEN doc_id % 10 <> 0 THEN length(text) > 1000 END AS said, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END AS heard,
      length(text) AS ms FROM labels JOIN documents USING (doc_id)),
    rel AS (SELECT CASE WHEN gold THEN 'relevant' ELSE 'irrelevant' END AS actual, CASE WHEN said THEN 'relevant' ELSE 'irrelevant' END AS predicted FROM g WHERE said IS NOT NULL),
    sen AS (SELECT mood AS actual, coalesce(heard, 'not_applicable') AS predicted FROM g WHERE said IS NOT NULL AND gold),
    o AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS rn, count(*) OVER () AS n FROM g WHERE ms IS NOT NULL)
    SELECT count(*) AS items, count(*) FILTER (WHERE said IS NULL) AS failures, round(count(said) / count(*), 9) AS json_validity_rate,
      floor(count(*) / 10.0::DOUBLE * 10 + 0.5) / 10 AS items_per_minute, floor(2500 / (count(*) / 10.0::DOUBLE) * 10 + 0.5) / 10 AS projected_minutes,
      (SELECT max(ms) FROM o WHERE rn = least(n - 1, floor(n * 0.5))) AS p50_latency_ms, (SELECT max(ms) FROM o WHERE rn = least(n - 1, floor(n * 0.95))) AS p95_latency_ms,
      (SELECT count(*) FROM rel) AS relevance_n, (SELECT round(avg((actual = predicted)::INT), 9) FROM rel) AS relevance_accuracy,
      {_f1("rel", "'relevant', 'irrelevant'")} AS relevance_macro_f1,
      (SELECT count(*) FROM sen) AS sentiment_n, (SELECT round(avg((actual = predicted)::INT), 9) FROM sen) AS sentiment_accuracy,
      {_f1("sen", "'positive', 'negative', 'neutral', 'not_applicable'")} AS sentiment_macro_f1 FROM g""")
def run_score(spark: SparkSession, sf: str) -> DataFrame:
    n, pick = F.col("doc_id"), lambda k, words: F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % k).cast("int"))
    answers = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        (F.col("quality") == 1).alias("gold_relevant"), pick(3, ("positive", "negative", "neutral")).alias("gold_sentiment"),
        F.when(n % 10 != 0, F.length("text") > 1000).alias("relevant"), pick(4, ("positive", "negative", "neutral", None)).alias("sentiment"),
        F.length("text").alias("latency_ms"),
    )
    out = evaluate.run_score(answers, 600000.0)
    return out.select(*[F.round(c, 9).alias(c) if c.endswith(("_f1", "accuracy", "validity_rate")) else c for c in out.columns])

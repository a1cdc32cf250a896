import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsgauge.sources import feeds

def now():
    return F.lit("2026-08-01 12:00:00").cast("timestamp")


def test_corpus(spark, tmp_path):
    items = [
        {"url": "https://a.example/1", "title": "Kando grows", "snippet": "water", "sourceName": "A", "publishedAt": "-4d", "language": "en"},
        {"url": "https://a.example/2", "title": "Kando yacht", "publishedAt": "2026-07-31T00:00:00Z"},
        {"url": "https://a.example/3", "title": "Kando undated", "publishedAt": None},
        {"url": "https://a.example/4", "title": "Skando", "publishedAt": "-1d"},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"items": items}))
    found = feeds.corpus(spark, str(tmp_path / "c.json"), now())
    assert found.columns == list(feeds.RAW) and found.count() == 4
    since, until = F.lit("2026-07-01").cast("timestamp"), now()
    got = feeds.search_corpus(found, "Kando", since, until, 5)
    assert [r["url"][-1] for r in got.collect()] == ["2", "1"]
    assert feeds.search_corpus(found, "Kando", since, until, -1).count() == 0
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        feeds.corpus(spark, str(tmp_path / "bad.json"), now()).collect()


def test_article_list(spark):
    body = {
        "articles": [
            {"url": "https://a.example", "title": " T ", "seendate": "20260731T101500Z", "domain": "a.example", "language": "Hebrew"},
            {"url": "https://b.example", "title": "U", "seendate": "nonsense", "domain": "b.example", "language": "English"},
            {"url": "https://c.example", "title": "V", "seendate": "20260730T000000Z", "domain": "c.example", "language": "Klingon"},
        ]
    }
    df = spark.createDataFrame([(json.dumps(body),), ("{}",), ("not json",)], "value string")
    rows = feeds.article_list(df).orderBy("url").collect()
    assert [(r["title"], r["language"], r["published_at"]) for r in rows] == [
        ("T", "he", dt.datetime(2026, 7, 31, 10, 15)), ("V", "Klingon", dt.datetime(2026, 7, 30)),
    ]
    sent = spark.range(1).select(feeds.article_list_request(F.lit('"a b"'), F.lit("2026-07-01").cast("timestamp"), now(), 999)).first()[0]
    assert "maxrecords=250" in sent and "startdatetime=20260701000000" in sent and "%22a+b%22" in sent


RSS = """<rss><channel><title>feed</title>{}</channel></rss>"""
ITEM = (
    "<item><title>{}</title><link>https://news.example/{}</link><pubDate>{}</pubDate>"
    '<source url="https://www.paper.example">The Paper</source></item>'
)


def test_rss(spark, tmp_path):
    good, bad = "Mon, 03 Feb 2025 10:00:00 GMT", "someday"
    items = ITEM.format("Tom &amp; Co - The Paper", 1, good) + ITEM.format("Plain - Other", 2, good) + ITEM.format("X", 3, bad)
    (tmp_path / "many.xml").write_text(RSS.format(items))
    (tmp_path / "one.xml").write_text(RSS.format(ITEM.format("One", 4, good)))
    (tmp_path / "none.xml").write_text(RSS.format(""))
    rows = feeds.rss(spark, str(tmp_path / "many.xml")).orderBy("url").collect()
    assert [(r["title"], r["source_name"]) for r in rows] == [("Tom & Co", "paper.example"), ("Plain - Other", "paper.example")]
    assert feeds.rss(spark, str(tmp_path / "one.xml")).count() == 1 and feeds.rss(spark, str(tmp_path / "none.xml")).count() == 0
    assert feeds.rss_query('"A"', 6.2) == '"A" when:7d' and feeds.rss_query("A", 0.1) == "A when:1d"
    with pytest.raises(ValueError):
        feeds.rss_query("A", 0)


def test_combine_and_select(spark):
    row = lambda url, d: (url, "t", None, None, dt.datetime(2026, 7, d), None, "p", "c")
    schema = "url string, title string, snippet string, source_name string, published_at timestamp, language string, provider string, company_id string"
    a, b = spark.createDataFrame([row("u1", 1), row("u2", 5)], schema), spark.createDataFrame([row("u3", 9)], schema)
    picked = feeds.select_sources({"a": a, "b": b}, "b, nope, a, b")
    rows = feeds.combine(picked).orderBy("position").collect()
    assert [(r["url"], r["provider_rank"]) for r in rows] == [("u3", 0), ("u2", 1), ("u1", 1)]


def test_seed_file(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("1. A\r\n# c\nB\n")
    assert [r["value"] for r in feeds.seed_lines(spark, str(tmp_path / "seed.txt")).orderBy("position").collect()][:3] == ["1. A", "# c", "B"]
    assert [(r["position"], r["value"]) for r in feeds.seed_lines(spark, str(tmp_path / "seed.txt")).collect()][:3] == [(0, "1. A"), (1, "# c"), (2, "B")]

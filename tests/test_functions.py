import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from newsgauge.functions import dates, query_language, repair, text, urls
from newsgauge.functions.phrases import Matcher, found_phrases, send_phrases
from newsgauge.functions.text import contains_phrase


def values(spark, cases, make):
    """make(col) for each case, in order."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select("i", make(F.col("x")).alias("y")).select("y").collect()]


PHRASES = [
    ("Peak raises money", "Peak", True), ("Peakhurst council", "Peak", False), ("they speak", "peak", False), ("a_Peak_b", "Peak", True),
    ("the launch pad", "Launchpad", False), ("PEAK.", "peak", True), ("ÉPeak", "Peak", False), ("über uns", "ÜBER", True),
    ("a\\Eb (c++)", "c++", True), ("x", " ", False), (None, "x", False), ("cost $5 (net)", "$5 (net)", True),
]


def test_contains_phrase(spark):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(PHRASES)], "i int, t string, p string")
    got = rows.orderBy("i").select(text.contains_phrase("t", F.col("p"))).collect()
    assert [r[0] for r in got] == [x for *_, x in PHRASES]
    for t, p, want in PHRASES:
        assert rows.where(F.col("t").eqNullSafe(F.lit(t))).select(text.contains_phrase("t", p)).first()[0] is want


def test_slug_and_title(spark):
    assert values(spark, ["Café Déjà-Vu!", "  A  B ", "ﬁne", "x" * 80, "¡!", None], text.slugify) == ["cafe-deja-vu", "a-b", "fine", "x" * 60, "", None]
    assert values(spark, ["Café: the  END.", ""], text.normalize_title) == ["cafe the end", ""]


def test_words_and_lines(spark):
    assert values(spark, ["a  b c", "one", "", None], lambda c: text.cap_words(c, 2)) == ["a b…", "one", "", ""]
    assert values(spark, ['"a", b ,, —, "c"'], text.split_negatives) == [["a", "b", "c"]]
    line = values(spark, ["Acme"], lambda c: text.alert_line(F.lit("2024-02-03 10:00:00"), F.lit(None).cast("string"), c, F.lit("T")))
    assert line == ["2024-02-03  UNCLASSIFIED  Acme                    T"]


URLS = {
    "http://www.Example.com/a/?utm_source=x&b=2&a=1#frag": "https://example.com/a?a=1&b=2",
    "https://example.com": "https://example.com/",
    "https://example.com/": "https://example.com/",
    "https://example.com/x///": "https://example.com/x",
    "https://example.com/x?REF=1&q=": "https://example.com/x?q=",
    "https://example.com:443/p?b=2&a=9&b=1": "https://example.com/p?a=9&b=2&b=1",
    "not a url": None,
    None: None,
}


def test_canonical_url(spark):
    assert values(spark, list(URLS), urls.canonical_url) == list(URLS.values())


def test_domains(spark):
    both = lambda s: lambda c: F.struct(urls.publisher_domain(c, F.lit(s)), urls.article_domain(c, F.lit(s)))
    assert [tuple(x) for x in values(spark, ["https://www.a.example/x", "bad"], both("www.B.example"))] == [
        ("b.example", "a.example"), ("b.example", "b.example"),
    ]
    assert tuple(values(spark, ["https://a.example/x"], both("The Paper"))[0]) == ("a.example", "a.example")
    assert values(spark, ["finance.biggo.com", "xbiggo.com", None], urls.blocking_entry) == ["biggo.com", None, None]
    assert values(spark, ["https://news.google.com/rss/x", "https://x.example", "?"], urls.is_opaque) == [True, False, False]


def test_buckets_and_phrases(spark):
    days = [None, 0, 7, 8, 30, 31, 90, 91, 3650, 1]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d long").orderBy("i")
    assert [r[0] for r in rows.select(dates.bucket(F.col("d"))).collect()] == [
        "NO_COVERAGE", "FRESH", "FRESH", "RECENT", "RECENT", "STALE", "STALE", "DORMANT", "DORMANT", "FRESH",
    ]
    said = [r[0] for r in rows.select(dates.describe(F.col("d"))).collect()]
    assert said[0] == "no coverage found" and said[1] == "mentioned today" and said[-1] == "last mentioned yesterday" and said[2] == "last mentioned 7 days ago"


def test_days_since_counts_elapsed_days(spark):
    now = F.lit("2026-08-01 12:00:00").cast("timestamp")
    got = values(spark, ["2026-07-25 13:00:00", "2026-07-25 12:00:00", "2027-01-01 00:00:00", None], lambda c: dates.days_since(c.cast("timestamp"), now))
    assert got == [6, 7, 0, None]


def test_dates_of_sources(spark):
    now = F.lit("2026-08-01 12:00:00").cast("timestamp")
    day = lambda *a: dt.datetime(*a)
    assert values(spark, ["-3d", "2026-01-02T03:04:05Z", "soon"], lambda c: dates.relative_or_iso(c, now)) == [day(2026, 7, 29, 12), day(2026, 1, 2, 3, 4, 5), None]
    assert values(spark, ["20260102T030405Z", "20260102030405", "x"], dates.compact_stamp) == [day(2026, 1, 2, 3, 4, 5)] * 2 + [None]
    assert values(spark, ["Mon, 03 Feb 2025 10:00:00 GMT", "3 Feb 2025 10:00:00 +0100", "no"], dates.mail_date) == [day(2025, 2, 3, 10), day(2025, 2, 3, 9), None]


def test_repair(spark):
    assert values(spark, ["95%", "0.4", "140", "-2", "high", None, "1e-1x"], repair.to_confidence) == [0.95, 0.4, 1.0, 0.0, 0.5, 0.5, 0.1]
    assert values(spark, ["true", " YES ", "0", "2", "no", None], repair.to_boolean) == [True, True, False, True, False, False]
    moods = [tuple(x) for x in values(spark, ["Good", "n/a", "great", None, " "], repair.to_sentiment)]
    assert moods == [("positive", True), (None, True), (None, False), (None, True), (None, True)]
    fix = lambda s: lambda c: repair.repair(c, F.lit(s), F.lit("0.5"), F.lit("a b"), F.lit(None).cast("string"))
    got = values(spark, ["yes", "no"], fix("positive"))
    assert got[0]["sentiment"] == "positive" and got[0]["repair_error"] is None and got[1]["sentiment"] is None
    assert values(spark, ["yes"], fix("none"))[0]["repair_error"] and "unrecognised" in values(spark, ["no"], fix("odd"))[0]["repair_error"]


def test_json(spark):
    cases = ['{"a": 1}', 'Sure: {"a": {"b": "}"}, "c": "\\"{"} done }', "none", "{open", None]
    assert values(spark, cases, repair.extract_json_object) == ['{"a": 1}', '{"a": {"b": "}"}, "c": "\\"{"}', None, None, None]
    parse = lambda c: repair.parse_json(c, "relevant string, sentiment string", "relevant")
    got = values(spark, ['x {"relevant": true} y', '{"other": 1}', "-"], parse)
    assert got[0]["relevant"] == "true" and got[1] is None and got[2] is None


def test_numbers(spark):
    got = values(spark, ["-2.5", "2.5", "2.4"], lambda c: repair.round_half_up(c.cast("double")))
    assert got == [-2, 3, 2] and values(spark, ["0"], lambda c: repair.safe_div(F.lit(1.0), c.cast("double"))) == [0.0]


QUERIES = [
    ('"a" OR "b" AND "c"', "a", True), ('"a" OR "b" AND "c"', "b", False), ('("a" OR "b") AND "c"', "b c", True), ('"a" "b"', "a", False),
    ('"a" "b"', "b a", True), ("a and (b or (c and d))", "a c d", True), ("a and (b or (c and d))", "a c", False), ('"a" AND ("b" OR "c', "a c", True),
    ("", "x", True), ("()", "x", True), ('"a") OR "b"', "b", False), ("a OR OR b", "a", True), ('"x y"', "x  y", False), (None, "x", True),
]


def test_query_language(spark):
    one = spark.range(1)
    for q, t, want in QUERIES:
        assert one.select(query_language.compile_query(q, F.lit(t))).first()[0] is want, (q, t)
    programs = [([{"op": op, "phrase": p} for op, p in query_language.postfix(q)], t) for q, t, _ in QUERIES]
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(programs)], f"n int, program {query_language.PROGRAM}, text string")
    said = query_language.run_program(F.col("program"), lambda p: contains_phrase("text", p))
    assert [r[0] for r in rows.orderBy("n").select(said).collect()] == [want for _, _, want in QUERIES]


def test_long_queries_stay_short_programs(spark):
    """Sixty pairs of alternatives, all of them required: as many steps as phrases and operators."""
    q = " AND ".join(f'("a{i}" OR "b{i}")' for i in range(60))
    steps = query_language.postfix(q)
    assert len(steps) == 239
    rows = spark.createDataFrame([([{"op": op, "phrase": p} for op, p in steps],)], f"program {query_language.PROGRAM}")
    for have, want in ([f"b{i}" for i in range(60)], True), ([f"b{i}" for i in range(59)], False):
        found = F.array(*map(F.lit, have))
        assert rows.select(query_language.run_program(F.col("program"), lambda p: F.array_contains(found, p))).first()[0] is want  # noqa: B023


LINKS = [
    ("http://www.Example.com:80/a/../b/./c/?utm_source=x&b=2&a=1#f", "https://example.com/b/c?a=1&b=2"),
    ("https://e.com/a%20b/é ü?q=x+y&p=%7E&empty", "https://e.com/a%20b/%C3%A9%20%C3%BC?empty=&p=%7E&q=x+y"),
    ("HTTPS://MÜNCHEN.de/x", "https://xn--mnchen-3ya.de/x"), ("http://ex%41mple.com", "https://example.com/"), ("http://a.com:443/", "https://a.com/"),
    ("https://a.com:80/", "https://a.com:80/"), ("https://a.com:0443/x/", "https://a.com/x"), ("https:\\\\a.com\\b\\c", "https://a.com/b/c"),
    ("https:a.com", "https://a.com/"), ("https://a b.com/", None), ("https://a.com:99999/", None), ("http://", None), ("bad url", None),
    ("https://u:p@www.a.com/", "https://u:p@a.com/"), ("https://a.com/%2e%2E/b/%2e", "https://a.com/b"), ("https://a.com/..", "https://a.com/"),
    ("https://a.com?z=1&UTM_Source=2&y=%zz", "https://a.com/?y=%25zz&z=1"), ("https://a.com/?b=1&a=2&b=0", "https://a.com/?a=2&b=1&b=0"),
    ("https://a.com//", "https://a.com/"), ("https://a.com/x?", "https://a.com/x"), (" https://a.com/\tx\n", "https://a.com/x"),
    ("https://a.com/?q=a%2Bb&r=*-._~", "https://a.com/?q=a%2Bb&r=*-._%7E"), ("https://[::1]:8080/x", "https://[::1]:8080/x"),
    ("ftp://www.a.com/x/", "ftp://a.com/x"), ("https://www./", "https://www./"), (None, None), ("", None),
]


def test_urls_as_browsers_read_them(spark):
    got = values(spark, [u for u, _ in LINKS], urls.canonical_url)
    assert dict(zip([u for u, _ in LINKS], got, strict=True)) == dict(LINKS)


def test_parse_query_in_sql(spark):
    query_language.register(spark)
    rows = spark.sql("""SELECT * FROM parse_query('"a" AND ("b c" OR d)') ORDER BY step""").collect()
    assert [tuple(r) for r in rows] == [(0, "phrase", "a"), (1, "phrase", "b c"), (2, "phrase", "d"), (3, "any", None), (4, "all", None)]


def test_matcher_equals_the_pattern(spark):
    """Random words of awkward letters and marks: the automaton finds what contains_phrase finds."""
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "ß", "ſ", "s", "K", "k", "İ", "i", "ı", "Σ", "ς", "σ", "-", "'", " ", ".", "漢", "١", "½", "_", "\\E", "ab", "a b"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    phrases = sorted({p for _ in range(80) if (p := make(rng.randrange(1, 4)).strip())})
    texts = [make(rng.randrange(12)) for _ in range(300)] + [None, ""]
    t, p = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "t int, x string"), spark.createDataFrame([(x,) for x in phrases], "p string")
    want = {(r["t"], r["p"]) for r in t.join(p, contains_phrase("x", F.col("p"))).select("t", "p").collect()}
    match = Matcher(phrases)
    assert {(i, x) for i, text in enumerate(texts) for x in match(text)} == want and len(want) > 100
    sent = send_phrases(p, "p")
    assert {(r["t"], r["f"]) for r in t.select("t", F.explode(found_phrases(F.col("x"), sent)).alias("f")).collect()} == want
    assert send_phrases(p, "p", most_chars=10) is None
    assert Matcher(["a"])("𝒜a") == [] and Matcher(["a"])("😀a") == ["a"] and Matcher([])("a") == []


@pytest.mark.parametrize(
    ("q", "more", "both"),
    [('"a"', False, False), ('"a" OR "b"', True, False), ('"a" OR ("b" AND "c")', True, True), ("", False, False), ("a b", True, True)],
)
def test_query_shape(q, more, both):
    assert query_language.shape(q) == {"disambiguates": more, "conjunctive": both}
    tree = query_language.parse('"Harvey AI" OR ("Harvey" AND "law firm")')
    assert tree.phrases == ["Harvey AI", "Harvey", "law firm"]


def test_no_part_of_a_link_is_made_again_at_every_place(spark):
    """Each use of a Column writes it out anew: thousands of patterns a row, unless variables hold the parts."""
    plan = spark.createDataFrame([], "x string").select(urls.canonical_url("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") < 40


def test_links_in_their_form_already_are_left_alone(spark):
    paths = ["", "/", "/a", "/a/", "//a", "/a//b", "/a/../b", "/a/.", "/..a", "/a.b/c", "/%41", "/a?x=1", "/a#f", "/a b", "/ä", "/a\\b", "/a@b:c", "/a\n", "/A|~", "/a{"]
    hosts = ["a.example", "A.example", "www.a.example", "www.", "a..example", "a_b.example", "1.2.3.4", "u@a.example", "a.example:443", "ä.example"]
    links = [f"{s}://{h}{p}" for s in ("https", "http", "HTTPS") for h in hosts for p in paths]
    assert values(spark, links, urls.canonical_url) == values(spark, links, urls._made_canonical)
    assert "https://a.example/a" in values(spark, ["https://a.example/a"], urls.canonical_url)

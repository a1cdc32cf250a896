import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import alerts, classify, collect, control, evaluate, linking, normalize, persist, planner, prefilter, registry_build, status

def now():
    return F.lit("2026-08-01 12:00:00").cast("timestamp")
ITEM = "position int, company_id string, url string, title string, snippet string, source_name string, published_at timestamp"


def item(i, url, title, day, source=None, company="c"):
    at = None if day is None else dt.datetime(2026, 7, 1) + dt.timedelta(days=day)
    return (i, company, url, title, None, source, at)


def outcomes(spark, rows):
    made = normalize.normalize_items(spark.createDataFrame(rows, ITEM))
    kept = normalize.dedupe_items(made.where("skip_reason IS NULL"), "company_id")
    skipped = {r["position"]: r["skip_reason"] for r in made.where("skip_reason IS NOT NULL").collect()}
    return skipped | {r["position"]: r["duplicate_reason"] for r in kept.collect()}


def test_skip_reasons(spark):
    rows = [item(1, "https://a.example/1", " ", 1), item(2, "https://a.example/2", "t", None), item(3, "bad url", "t", 1), item(4, "https://a.example/4", "t", 1)]
    assert outcomes(spark, rows) == {1: "no-title", 2: "no-date", 3: "invalid-url", 4: None}


def test_same_url_keeps_the_earlier(spark):
    rows = [item(1, "http://www.a.example/x?utm_source=q", "One", 5), item(2, "https://a.example/x/", "Two", 3)]
    assert outcomes(spark, rows) == {1: "same-url", 2: None}


def test_readable_link_beats_redirect(spark):
    rows = [item(1, "https://news.google.com/r/1", "Big Story", 1, "p.example"), item(2, "https://p.example/s", "big story!", 4, "p.example")]
    assert outcomes(spark, rows) == {1: "same-content", 2: None}


def test_months_apart_and_other_publishers_stay(spark):
    rows = [item(1, "https://a.example/1", "S", 0), item(2, "https://a.example/2", "S", 60), item(3, "https://b.example/3", "S", 0)]
    assert set(outcomes(spark, rows).values()) == {None}


def test_order_of_arrival_matters(spark):
    days = [0, 5, 10]
    forward = [item(i, f"https://a.example/{i}", "S", d) for i, d in enumerate(days)]
    backward = [item(i, f"https://a.example/{i}", "S", d) for i, d in enumerate(reversed(days))]
    assert list(outcomes(spark, forward).values()).count(None) == 2
    assert list(outcomes(spark, backward).values()).count(None) == 1


def plain_dedupe(rows):
    """The same by one loop over everything: (position, id, key, opaque, date) in order of arrival."""
    held, by_id, by_key, out = [], {}, {}, {}
    for pos, ident, key, opaque, date in rows:
        at, why = by_id.get(ident), "same-url"
        if at is None:
            why = "same-content"
            near = lambda s: held[s][4] is None or date is None or abs(held[s][4] - date) <= dt.timedelta(days=7)  # noqa: B023, E731
            at = next((s for s in by_key.get(key, []) if near(s)), None)
        new = (pos, ident, key, opaque, date)
        if at is None:
            held.append(new)
            at = len(held) - 1
        else:
            old = held[at]
            stays = (not old[3]) if old[3] != opaque else old[4] is None or date is None or old[4] <= date
            out[(new if stays else old)[0]] = why
            held[at] = old if stays else new
        by_id[held[at][1]] = at
        slots = by_key.setdefault(held[at][2], [])
        if at not in slots:
            slots.append(at)
    return out | {h[0]: None for h in held}


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        date = dt.datetime(2026, 7, 1) + dt.timedelta(days=rng.randrange(30), hours=rng.randrange(24))
        rows.append((i, f"u{rng.randrange(25)}", f"k{rng.randrange(8)}", rng.random() < 0.3, date))
    df = spark.createDataFrame([(*r, "c") for r in rows], "position int, id string, content_key string, opaque boolean, published_at timestamp, company_id string")
    got = {r["position"]: r["duplicate_reason"] for r in normalize.dedupe_items(df, "company_id").collect()}
    assert got == plain_dedupe(rows)


def test_recency_cap(spark):
    rows = [item(i, f"https://a.example/{i}", "t", d) for i, d in enumerate([1, 9, 9, 3])]
    kept = normalize.recency_cap(spark.createDataFrame(rows, ITEM), "company_id", "published_at", "position", 2)
    assert sorted(r["position"] for r in kept.collect()) == [1, 2]


COMPANY = "company_id string, name string, aliases array<string>, negative_keywords array<string>, query string, query_source string"


def verdicts(spark, titles, company, url="https://a.example/x"):
    c = spark.createDataFrame([("c", *company)], COMPANY)
    items = spark.createDataFrame([item(i, url, t, 1) for i, t in enumerate(titles)], ITEM)
    rows = prefilter.prefilter(items, c).orderBy("position").collect()
    return [(r["verdict"]["keep"], r["verdict"]["reason"], r["verdict"]["evidence"], r["verdict"]["soft_pass"]) for r in rows]


def test_prefilter_layers(spark):
    company = ("Peak", ["Peak.ai"], ["Peak District"], '"Peak" AND ("decision" OR "AI")', "human-approved")
    titles = ["Peakhurst news", "Peak District walk", "Peak raises", "Peak decision tools", "Peak.ai"]
    assert verdicts(spark, titles, company) == [
        (False, "no-name-match", None, False), (False, "negative-keyword", "Peak District", False),
        (True, "missing-qualifier", company[3], True), (True, None, "Peak", False), (True, None, "Peak", False),
    ]
    assert verdicts(spark, ["Peak raises"], (*company[:4], "llm-enriched")) == [(True, None, "Peak", False)]
    assert verdicts(spark, ["Peak raises"], company, "https://finance.biggo.com/x")[0][1:3] == ("blocked-domain", "biggo.com")
    assert verdicts(spark, ["x"], ("X", None, None, None, None)) == [(True, None, "X", False)]


def test_stats_never_count_missing_qualifiers_as_rejections(spark):
    c = spark.createDataFrame([("c", "A", [], [], '"A" AND "B"', None)], COMPANY)
    judged = prefilter.prefilter(spark.createDataFrame([item(i, "https://a.example", t, 1) for i, t in enumerate(["A", "A B", "z"])], ITEM), c)
    row = prefilter.prefilter_stats(judged).first().asDict()
    assert (row["received"], row["kept"], row["soft_pass"], row["no_name_match"], row["missing_qualifier"]) == (3, 2, 1, 1, 0)


def test_plan_asks_for_what_the_filter_enforces(spark):
    rows = [
        ("a", "A", [], [], '"A" AND "B"', "human-approved"), ("b", "B", [], [], '"B" AND "C"', "llm-enriched"), ("c", "C", [], [], '"C" OR "D"', None),
        ("d", "D", [], [], " ", "fallback"), ("e", "E", [], [], '"E"', "human-approved"),
    ]
    plans = {r["company_id"]: r for r in planner.plan_queries(spark.createDataFrame(rows, COMPANY)).collect()}
    assert {k: (r["strategy"], r["qualified"], r["query"]) for k, r in plans.items()} == {
        "a": ("override", True, '"A" AND "B"'), "b": ("exact-phrase", False, '"B"'), "c": ("qualified", True, '"C" OR "D"'),
        "d": ("exact-phrase", False, '"D"'), "e": ("exact-phrase", False, '"E"'),
    }


def test_phrase_join_equals_the_pattern_join(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "über", "x-ray", "don't", "Kappa"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(80)] + [(99, None), (98, "")]
    phrases = [(0, "alpha beta"), (1, "Über"), (2, "x-ray don't"), (3, "kappa"), (4, "zeta"), (5, "--")]
    t, p = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(phrases, "p int, phrase string")
    got = {tuple(r) for r in prefilter.phrase_join(t, p, "t", "text", "p", "phrase").collect()}
    joined = {tuple(r) for r in prefilter.phrase_join(t, p, "t", "text", "p", "phrase", most_chars=5).collect()}
    from newsgauge.functions.text import contains_phrase

    want = {(r["t"], r["p"]) for r in t.join(p, contains_phrase("text", F.col("phrase"))).select("t", "p").collect()}
    assert got == want and joined == {x for x in want if x[1] != 5}


MENTION = "id string, label string, first_seen_at string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1")], MENTION)
    new = spark.createDataFrame([("b", None, "2"), ("c", "z", "2")], MENTION)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(persist.upsert(old, new, ["id"], keep=("first_seen_at",))) == [("a", "x", "1"), ("b", None, "1"), ("c", "z", "2")]
    assert rows(persist.upsert(old, new, ["id"], keep=("first_seen_at",), parity=("label",))) == [("a", "x", "1"), ("b", "y", "1"), ("c", "z", "2")]
    table, fresh = persist.insert_if_absent(old, new, ["id"], "label")
    assert rows(table) == [("a", "x", "1"), ("b", "y", "1"), ("c", "z", "2")] and rows(fresh) == [("c", "z", "2")]
    again, none = persist.insert_if_absent(table, new, ["id"], "label")
    assert rows(again) == rows(table) and none.count() == 0


def test_table_versions(spark, tmp_path):
    t = persist.Table(spark, str(tmp_path / "t"), "id long")
    assert t.read().count() == 0
    t.replace(spark.range(3))
    t.replace(t.read().where("id > 0"))
    assert sorted(r[0] for r in t.read().collect()) == [1, 2]


def alert_rows(spark):
    return spark.createDataFrame([("m1", "A", "t1", "u1", "neutral"), ("m2", "B", "t2", "u2", None)], "mention_id string, company string, title string, url string, sentiment string")


def test_dispatch_records_only_what_was_sent(spark):
    sent = spark.createDataFrame([("m1", "ok")], "mention_id string, channel string")

    def broken(_):
        raise OSError("down")

    record, summary = alerts.dispatch(alert_rows(spark), sent, {"ok": lambda df: df.count(), "bad": broken}, "r", now())
    assert [(r["mention_id"], r["channel"]) for r in record.collect()] == [("m2", "ok")]
    by = {r["channel"]: r for r in summary.collect()}
    assert by["ok"]["delivered"] == 1 and by["ok"]["skipped"] == 1 and by["bad"]["failed"] == 2 and "down" in by["bad"]["outcome"]
    again, _ = alerts.dispatch(alert_rows(spark), record.select("mention_id", "channel").unionByName(sent), {"ok": lambda df: df.count()}, "r", now())
    assert again.count() == 0
    dry, summary = alerts.dispatch(alert_rows(spark), sent, {"ok": broken}, "r", now(), dry_run=True)
    assert dry.count() == 0 and summary.first()["outcome"] == "dry-run"


def test_classify_asks_once_and_keeps_failures_pending(spark):
    rows = [(str(i), "c", f"a{i}", "Acme", None, [], [], t) for i, t in enumerate(["Acme wins", "Acme wins", "Acme lawsuit", "odd"])]
    pending = spark.createDataFrame(rows, "id string, company_id string, article_id string, company string, sector string, aliases array<string>, negative_keywords array<string>, title string")

    def model(prompts):
        return [None if "odd" in p else a for p, a in zip(prompts, classify.keyword_model(prompts), strict=True)]

    done, fresh = classify.classify(pending, spark.createDataFrame([], "key string, raw string"), model, "m", "v")
    assert fresh.count() == 2
    got = {r["id"]: r["sentiment"] for r in classify.results(done, "m", "v", now()).collect()}
    assert got == {"0": "positive", "1": "positive", "2": "negative"}

    def never(prompts):
        assert all("odd" in p for p in prompts)
        return [None] * len(prompts)

    done, _ = classify.classify(pending, spark.createDataFrame(fresh.collect(), "key string, raw string"), never, "m", "v")
    assert classify.results(done, "m", "v", now()).count() == 3


def test_run_status(spark):
    make = lambda rows: classify.run_status(spark.createDataFrame(rows, "error string, kept int")).first()["status"]
    assert make([(None, 1), ("x", 0)]) == "completed" and make([("x", 0)]) == "failed" and make([]) == "failed"


def test_rollup_keeps_companies_without_coverage(spark):
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "company_id string, name string")
    m = spark.createDataFrame(
        [("a", True, "positive", dt.datetime(2026, 7, 31)), ("a", True, "negative", dt.datetime(2025, 1, 1)), ("b", False, None, dt.datetime(2026, 7, 31))],
        "company_id string, relevant boolean, sentiment string, published_at timestamp",
    )
    rows = {r["company_id"]: r for r in status.status_rollup(c, m, status.window_start(now(), 90), now()).collect()}
    assert (rows["a"]["status"], rows["a"]["mentions_in_window"], rows["a"]["positive"], rows["a"]["negative"]) == ("FRESH", 1, 1, 0)
    assert (rows["b"]["status"], rows["b"]["mentions_in_window"], rows["b"]["last_mentioned_at"]) == ("NO_COVERAGE", 0, None)


def test_macro_f1_counts_unsupported_labels(spark):
    pairs = spark.createDataFrame([("positive", "positive"), ("negative", "positive"), ("odd", "neutral")], "actual string, predicted string")
    s = evaluate.scores(pairs, evaluate.SENTIMENT_LABELS).first()
    assert s["n"] == 3 and abs(s["accuracy"] - 1 / 3) < 1e-9 and abs(s["macro_f1"] - (2 / 3) / 4) < 1e-9
    m = {r["label"]: r for r in evaluate.class_metrics(pairs, evaluate.SENTIMENT_LABELS).collect()}
    assert m["positive"]["precision"] == 0.5 and m["neutral"]["predicted_as"] == 1 and m["not_applicable"]["f1"] == 0
    cells = {(r[0], r[1]): r[2] for r in evaluate.confusion_matrix(pairs, ["positive", "negative"]).collect()}
    assert cells == {("positive", "positive"): 1, ("positive", "negative"): 0, ("negative", "positive"): 1, ("negative", "negative"): 0}
    assert evaluate.render_confusion([("a", "a", 3)], ["a"]).splitlines()[1].split() == ["a", "3"]


def test_run_pairs_do_not_count_a_miss_twice(spark):
    rows = [(True, "positive", True, "positive"), (True, "negative", False, None), (False, None, True, "neutral"), (True, "neutral", None, None)]
    relevance, mood = evaluate.run_pairs(spark.createDataFrame(rows, "gold_relevant boolean, gold_sentiment string, relevant boolean, sentiment string"))
    assert relevance.count() == 3
    assert sorted(tuple(r) for r in mood.collect()) == [("negative", "not_applicable"), ("positive", "positive")]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (4, 1, 3, 2)], "g string, x double")
    assert tuple(evaluate.nearest_rank("x", ["g"], df, {"p50": 0.5, "p95": 0.95}).first())[1:] == (3.0, 4.0)


def test_ship_choice(spark):
    rows = [("small", 1, 0.50, 0.50), ("mid", 2, 0.51, 0.52), ("big", 3, 0.52, 0.52)]
    r = evaluate.ship_choice(spark.createDataFrame(rows, "model string, ladder int, relevance_f1 double, sentiment_f1 double")).first()
    assert (r["best"], r["ship"]) == ("big", "small") or (r["best"], r["ship"]) == ("big", "mid")


def test_seed_and_registry_summary(spark):
    lines = spark.createDataFrame(list(enumerate(["1. A", "#x", "a", "", "2) B"])), "position int, value string")
    assert [tuple(r) for r in registry_build.parse_seed(lines).orderBy("index").collect()] == [(1, "A"), (2, "B")]


def test_control():
    waits = []
    calls = iter([control.Unavailable("x"), control.Unavailable("x"), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert control.retry(call, sleep=waits.append, rng=lambda: 1.0) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(control.BadPayload):
        control.retry(lambda: (_ for _ in ()).throw(control.BadPayload("x")), sleep=waits.append)
    clock = [0.0]
    b = control.Breaker(clock=lambda: clock[0])
    b.failure(), b.failure()
    assert b.allows()
    b.failure()
    assert not b.allows()
    clock[0] = 301
    assert b.state == "half-open" and b.allows()
    b.failure()
    assert not b.allows()
    clock[0] = 700
    b.success()
    assert b.state == "closed"
    b.failure(at_once=True)
    assert b.state == "open"
    assert control.Config.read({"WINDOW_DAYS": "30", "SOURCES": "rss, corpus"}).sources == ("rss", "corpus")
    with pytest.raises(control.BadConfig, match="WINDOW_DAYS.*LOOKBACK_HOURS"):
        control.Config.read({"WINDOW_DAYS": "x", "LOOKBACK_HOURS": "-1"})


def test_a_long_chain_of_reports_is_one_story(spark):
    """Neighbours share a URL or a title in turn; no number of links is too many."""
    rows = [(i, "c", f"u{i // 2}", f"t{(i + 1) // 2}", False, None) for i in range(80)]
    items = spark.createDataFrame(rows, "position int, scope string, id string, content_key string, opaque boolean, published_at timestamp")
    names = {c: F.xxhash64(c) for c in ("id", "content_key")}
    rows = items.select("position", names["id"].alias("url"), names["content_key"].alias("content"), F.lit(None).cast("bigint").alias("date"), F.lit(None).cast("bigint").alias("week"))
    assert normalize._stories(rows, 7).select("story").distinct().count() == 1
    found = normalize.dedupe_items(items.drop("scope").withColumn("company_id", F.lit(1)), "company_id")
    assert found.count() == 80 and found.where("duplicate_reason IS NULL").count() == 40  # what is dropped leads nobody on


@pytest.mark.parametrize("seed", range(4))
def test_split_stories_equal_a_plain_loop(spark, seed):
    """Titles over two years, URLs that cross titles and years, missing dates: many stories, the same rows as one loop."""
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        date = None if seed == 3 and rng.random() < 0.02 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 700))
        url = f"u{rng.randrange(40)}" if rng.random() < (0.05, 0.2, 0.5, 0.1)[seed] else f"own{i}"
        rows.append((i, url, f"t{rng.randrange(5)}", rng.random() < 0.2, date))
    df = spark.createDataFrame([(*r, "c") for r in rows], "position int, id string, content_key string, opaque boolean, published_at timestamp, company_id string")
    got = {r["position"]: r["duplicate_reason"] for r in normalize.dedupe_items(df, "company_id").collect()}
    assert got == plain_dedupe(rows)


def test_a_hot_title_is_many_stories(spark):
    """Half of all items have one title: gaps cut it, a URL reported again after a year joins two pieces and no more."""
    day, at = 86_400_000_000, F.col("id")
    date = at % 50 * 20 * day
    rows = spark.range(2_000).select(
        at.alias("position"), F.when(at < 1_000, 1).otherwise(at).cast("bigint").alias("content"), date.alias("date"), F.floor(date / (7 * day)).alias("week"),
        F.when(at.isin(3, 24), -1).otherwise(at).alias("url"),
    )
    found = normalize._stories(rows, 7 * day).where("position < 1000").groupBy("story").count().collect()
    assert len(found) == 49 and sorted(r["count"] for r in found)[-2:] == [20, 40]


@pytest.mark.parametrize("seed", range(2))
def test_stories_whose_first_report_stays_are_not_folded(spark, seed):
    """Reports of a title in order of date need no fold; with a better one later, or a week between, they do."""
    rng, day = random.Random(seed), dt.datetime(2026, 7, 1)
    rows = [(i, f"u{i % 70 if i % 3 else 0}-{i % 7}", f"k{i % 7}", i % 7 == 6, day + dt.timedelta(minutes=i)) for i in range(210)]
    rows += [(210 + i, f"v{rng.randrange(9)}", "late", rng.random() < 0.5, day + dt.timedelta(hours=rng.randrange(90))) for i in range(40)]
    rows += [(250 + i, f"w{i}", "long", False, day + dt.timedelta(days=5 * i)) for i in range(5)] + [(255 + i, f"x{i}", "no date", False, None) for i in range(5)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "position int, id string, content_key string, opaque boolean, published_at timestamp, company_id string")
    got = {r["position"]: r["duplicate_reason"] for r in normalize.dedupe_items(df, "company_id").collect()}
    assert got == plain_dedupe(rows) and {"same-url", "same-content"} < set(got.values())
    placed = df.select(
        F.hash("content_key").alias("story"), F.col("company_id").alias("scope"), "position", "id", "content_key", "opaque", F.unix_micros("published_at").alias("date")
    )
    heads = {r["first"]: r["plain"] for r in normalize._heads(placed, 7 * 86_400_000_000).collect()}
    assert heads == {**{i: True for i in range(7)}, 210: False, 250: False, 255: False}


@pytest.mark.parametrize("seed", range(4))
def test_remaining_items_are_those_of_a_plain_loop(spark, seed):
    """Single items, stories settled by numbers and folded ones, of two companies whose positions are the same numbers."""
    rng, rows = random.Random(seed), []
    for i in range(200):
        date = None if seed == 3 and rng.random() < 0.02 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 300))
        url = f"u{rng.randrange(30)}" if rng.random() < (0, 0.1, 0.4, 0.1)[seed] else f"own{i}"
        rows.append((i, url, f"t{rng.randrange(40)}", rng.random() < 0.2, date))
    rows += [(200 + i, f"p{i % 9}", "plain", False, dt.datetime(2025, 5, 1, i)) for i in range(20)]
    of = "position int, id string, content_key string, opaque boolean, published_at timestamp, company_id string"
    df = spark.createDataFrame([(*r, c) for r in rows for c in "cd"], of).withColumn("more", F.col("position") * 2)
    got = normalize.remaining_items(df.withColumnRenamed("id", "link"), "company_id", "link").collect()
    left = {at for at, why in plain_dedupe(rows).items() if why is None}
    assert sorted((r["company_id"], r["position"], r["more"]) for r in got) == sorted((c, at, at * 2) for c in "cd" for at in left)
    empty = normalize.remaining_items(df.limit(0), "company_id")
    assert empty.columns == df.columns and empty.count() == 0


def test_collection_writes_its_items_once(spark, monkeypatch):
    """Of 2000 reports of four titles no step but the first writes more than a few rows."""
    written = []

    def counted(df, tag):
        made = linking.stored(df, tag)
        written.append(made.count())
        return made

    for module in (normalize, collect):
        monkeypatch.setattr(module, "stored", counted)
    raw = spark.range(2_000).select(
        F.col("id").alias("position"), F.lit("c").alias("company_id"), F.concat(F.lit("https://a.example/"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("Acme "), (F.col("id") % 4).cast("string")).alias("title"), F.lit(None).cast("string").alias("snippet"),
        F.lit(None).cast("string").alias("source_name"), F.lit("2026-07-01").cast("timestamp").alias("published_at"),
    )
    who = spark.createDataFrame(
        [("c", "Acme", [], [], '"Acme"', None)], "company_id string, name string, aliases array<string>, negative_keywords array<string>, query string, query_source string"
    )
    calls = spark.createDataFrame([], "company_id string, provider string, status string")
    kept, rejected, stats = collect.collect(raw, who, calls)
    assert sorted(r["id"] for r in kept.collect()) == sorted(hashlib.sha256(f"https://a.example/{i}".encode()).hexdigest() for i in range(4))
    row = stats.first()
    assert (row["fetched"], row["normalized"], row["deduped"], row["kept"], rejected.count()) == (2_000, 2_000, 4, 4, 0)
    assert sorted(written)[-1] == 2_000 and sum(written) < 2_100


def test_many_slots_of_one_title_are_found_by_week():
    fold = normalize._Fold(7)
    for i in range(20_000):
        fold.add((("c", i), ("c", "t"), False, i * 10, i))
    assert len(fold.holders) == 20_000
    assert fold.add((("c", -1), ("c", "t"), False, 150_003, "x")) == ("x", "same-content")
    assert fold.add((("c", -2), ("c", "t"), False, None, "y")) == ("y", "same-content")


def test_a_lost_pointer_is_an_error(spark, tmp_path):
    t = persist.Table(spark, str(tmp_path / "t"), "id long")
    t.replace(spark.range(3))
    t.replace(spark.range(5))
    assert t.read().count() == 5
    (tmp_path / "t" / "CURRENT").unlink()
    with pytest.raises(RuntimeError):
        t.read()


def test_loss_words_and_assent(spark):
    from newsgauge.functions import repair

    text = spark.createDataFrame([("Acme lays off", "2"), ("a down round", "Yes"), ("Acme sues", "-3"), ("gains", "1")], "t string, a string")
    got = text.select(evaluate.stratum(F.col("t"), F.lit(False), F.lit("low")).alias("s"), repair.to_boolean_text("a").alias("b")).collect()
    assert [(r["s"], r["b"]) for r in got] == [("kept-distinctive", False), ("negative-signal", True), ("negative-signal", False), ("kept-distinctive", True)]


def test_nearest_rank_narrows_to_one_value(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([rng.gauss(0, 1), 10.0 ** rng.randrange(-8, 9), 3.0])) for _ in range(700)] + [("b", 5.0)] * 9 + [("c", -1.0), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["p0"], r["p50"], r["p95"], r["p100"]) for r in evaluate.nearest_rank("x", ["g"], df, {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, cells=7).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = tuple(own[min(len(own) - 1, int(len(own) * q))] for q in (0.0, 0.5, 0.95, 1.0))
    assert got == want


def test_first_of_each_takes_a_hot_group_in_parts(spark):
    df = spark.range(5_000).select((F.col("id") % 100 < 95).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    got = evaluate.first_of_each(df, ["g"], ["o"], 20, "place").collect()
    for g in (True, False):
        own = sorted(i * 7919 % 5003 for i in range(5_000) if (i % 100 < 95) is g)[:20]
        assert sorted((r["place"], r["o"]) for r in got if r["g"] is g) == list(enumerate(own, 1))


def test_breaker_history_equals_a_replay(spark):
    from newsgauge.operators import breaker

    rng = random.Random(2)
    start = dt.datetime(2026, 7, 1)
    calls = []
    for p in "ab":
        at = start
        for n in range(200):
            at += dt.timedelta(seconds=rng.choice([0, 60, 400, 40_000, 90_000]))
            calls.append((p, at, n, rng.choices(["success", "failure", "rate-limited"], [2, 6, 1])[0]))
    got = breaker.history(spark.createDataFrame(calls, "provider string, at timestamp, seq int, outcome string")).collect()
    got = {(r["provider"], r["seq"]): (r["met"], r["failures"], r["opened_at"]) for r in got}
    state, want = {}, {}
    for p, at, n, outcome in calls:
        failures, opened = state.get(p, (0, None))
        met = "closed" if opened is None else "half-open" if (at - opened).total_seconds() >= 300 else "open"
        if outcome == "success":
            failures, opened = 0, None
        else:
            failures += 1
            opened = at if outcome == "rate-limited" or failures >= 3 else opened
        state[p] = failures, opened
        want[p, n] = met, failures, opened
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_of_chains_stars_and_random_edges(spark, parts):
    from newsgauge.operators.linking import groups

    rng = random.Random(parts)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(x, 100) for x in range(120, 150)] + [(200, 200)]
    edges += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(500):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    found = groups(spark.createDataFrame(edges, "u long, v long").repartition(parts))
    assert {r["node"]: r["root"] for r in found.collect()} == root and found.count() == len(root)


def test_coverage_series_orders_no_days(spark):
    """Days of a company are made where its steps are: no window over them, so none is shuffled."""
    from newsgauge.operators import status

    companies = spark.createDataFrame([(1,), (2,)], "company_id long")
    said = spark.createDataFrame([(1, "2024-01-02"), (1, "2024-01-02"), (1, "2023-12-30")], "company_id long, at string")
    made = status.coverage_series(companies, said.selectExpr("company_id", "cast(at AS timestamp) AS published_at"), "2024-01-01", "2024-01-04", days=2)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    got = [r["mentions"] for r in made.orderBy("company_id", "day").collect()]
    assert got == [0, 2, 2, 0, 0, 0, 0, 0]


def test_prefilter_deals_no_items_by_company(spark):
    """Companies of few phrases go to the items, whatever Spark knows of their size."""
    from newsgauge.operators import prefilter

    items = spark.createDataFrame([(1, "u", "A name", None, None)] * 3, "company_id long, url string, title string, snippet string, source_name string")
    known = spark.createDataFrame([(1, "name", [], [], None, None)], "company_id long, name string, aliases array<string>, negative_keywords array<string>, query string, query_source string")
    plan = prefilter.prefilter(items, known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

"""Whole runs: what is stored, what a second run changes, what is lost and what is kept for audit."""

import hashlib

import pytest
from pyspark.sql import functions as F

from newsgauge.functions.text import prompt_version_tag
from newsgauge.operators import alerts, classify, collect, evaluate, persist, run

def now():
    return F.lit("2001-08-01 00:00:00").cast("timestamp")



@pytest.fixture
def parts(spark):
    raw = spark.createDataFrame(
        [(1, 7, "https://a.example/1", "Acme opens", None, None), (2, 7, "https://a.example/1?utm_source=x", "Acme opens", None, None),
         (3, 7, "https://a.example/3", "Nothing here", None, None), (4, 8, "https://a.example/4", None, None, None)],
        "position long, company_id long, url string, title string, snippet string, source_name string",
    ).withColumn("published_at", now())
    companies = spark.createDataFrame(
        [(7, "Acme", None, [], [], '"Acme"', None, "high"), (8, "Beta", None, [], [], '"Beta"', None, None)],
        "company_id long, name string, sector string, aliases array<string>, negative_keywords array<string>, query string, query_source string, ambiguity string",
    )
    calls = spark.createDataFrame([(7, "x", "ok"), (8, "x", "failed")], "company_id long, provider string, status string")
    return raw, companies, calls


def test_run_is_recorded_and_a_second_one_keeps_labels(spark, parts, tmp_path):
    store = run.Store(spark, str(tmp_path))
    for name in ("r1", "r2"):
        run.run_pipeline(*parts, store, classify.keyword_model, "offline", "v1@0", name, now())
    rows = {r["rejection_reason"]: r for r in store.mentions.read().collect()}
    assert set(rows) == {None, "no-name-match"}
    assert rows[None]["sentiment"] == "neutral" and rows[None]["classified_at"] is not None
    assert store.articles.read().count() == 2 and store.cache.read().count() == 1
    runs = {r["id"]: r for r in store.runs.read().collect()}
    assert runs["r1"]["status"] == "completed" and runs["r1"]["started_at"] is not None
    assert (runs["r2"]["companies"], runs["r2"]["articles"], runs["r2"]["with_no_coverage"], runs["r2"]["failed"]) == (2, 1, 1, 1)
    assert {r["key"] for r in store.state.read().collect()} == {"watermark"}


def test_failed_calls_stay_pending_and_are_taken_up_again(spark, parts, tmp_path):
    store = run.Store(spark, str(tmp_path))
    run.run_pipeline(*parts, store, lambda prompts: [None] * len(prompts), "offline", "v1@0", "r", now())
    assert store.mentions.read().where("classified_at IS NULL").count() == 1
    lost = run.classify_waiting(store, parts[1].where("company_id = 8"), classify.keyword_model, "offline", "v1@0", now()).first()
    assert tuple(lost) == (1, 1, 0)
    done = run.classify_waiting(store, parts[1], classify.keyword_model, "offline", "v1@0", now()).first()
    assert tuple(done) == (1, 0, 1)


def test_empty_collection_has_a_row_for_each_company(spark, parts):
    raw, companies, calls = parts
    kept, rejected, stats = collect.collect(raw.limit(0), companies, calls.limit(0))
    assert kept.count() == rejected.count() == 0
    assert {r["company_id"]: (r["fetched"], r["kept"], r["providers_ok"]) for r in stats.collect()} == {7: (0, 0, 0), 8: (0, 0, 0)}


def test_audit_rows_mark_failures(spark, parts):
    raw, companies, calls = parts
    _, rejected, _ = collect.collect(raw, companies, calls)
    rows = {r["name"]: r for r in collect.audit_rows(companies, rejected, calls.where("status = 'failed'")).collect()}
    assert rows["Acme"]["fetched"] == 1 and rows["Acme"]["reasons"]["no_name_match"] == 1
    assert rows["Beta"]["fetched"] == rows["Beta"]["kept"] == -1 and rows["Beta"]["reasons"] == {}


def test_state_console_context_and_tag(spark, tmp_path):
    state = persist.Table(spark, str(tmp_path / "state"), "key string, value string")
    persist.set_state(state, {"a": "1", "b": "2"})
    persist.set_state(state, {"a": "3", "b": None})
    assert [tuple(r) for r in state.read().collect()] == [("a", "3")]
    lines = []
    rows = spark.createDataFrame([("old", "2001-01-01"), ("new", "2001-02-01"), ("none", None)], "line string, published_at string")
    assert alerts.console_sink(lines.append)(rows) == 3 and lines == ["new", "old", "none"]
    gold = spark.createDataFrame([("Acme", True), ("Unknown", False)], "company string, gold_relevant boolean")
    known = spark.createDataFrame([("Acme", "Tools")], "name string, sector string")
    assert {r["company"]: r["sector"] for r in evaluate.with_context(gold, known).collect()} == {"Acme": "Tools", "Unknown": None}
    tag = spark.range(1).select(prompt_version_tag(F.lit("v2"), F.lit("text"))).first()[0]
    assert tag == "v2@" + hashlib.sha256(b"text").hexdigest()[:12]


def test_score_of_no_answers(spark):
    rows = spark.createDataFrame([], "gold_relevant boolean, gold_sentiment string, relevant boolean, sentiment string, latency_ms long")
    out = evaluate.run_score(rows, 0).first()
    assert (out["items"], out["failures"], out["p50_latency_ms"], out["relevance_n"], out["items_per_minute"]) == (0, 0, 0, 0, 0.0)


def test_failures_stay_with_their_company(spark):
    who = spark.createDataFrame([(i,) for i in range(5)], "company_id long")
    said = [(0, "a", "ok", None), (0, "b", "failed", "boom"), (1, "a", "failed", "late"), (1, "a", "failed", "broken"), (1, "b", "skipped", None), (2, None, "failed", None), (9, "a", "ok", None)]
    calls = spark.createDataFrame(said, "company_id long, provider string, status string, detail string")
    kept = spark.createDataFrame([(0, 3), (9, 4)], "company_id long, kept long")
    out = collect.company_outcomes(who, calls, kept)
    assert sorted(tuple(r) for r in out.collect() if r["company_id"] < 3) == [
        (0, 3, 1, "b: boom", None), (1, 0, 0, "a: broken; b: skipped", "a: broken; b: skipped"), (2, 0, 0, ": failed", ": failed"),
    ]
    assert tuple(classify.run_status(out).first()) == (5, 2, 2, "completed")
    assert classify.run_status(out.where("error IS NOT NULL")).first()["status"] == "failed"
    assert classify.run_status(out.where("false")).first()["status"] == "failed"

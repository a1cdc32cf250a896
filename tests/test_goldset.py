"""Gold sets: strata, rounds over companies, labels, files; coverage audits as files."""

import datetime

from pyspark.sql import functions as F

from newsgauge.operators import collect, evaluate, goldset

JUDGED = (
    "company_id string, title string, url string, source_name string, published_at timestamp, verdict struct<keep: boolean, reason: string, evidence: string, soft_pass: boolean>"
)


def judged(spark, rows):
    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(c, t, u, None, at, (keep, None, None, soft)) for c, t, u, keep, soft in rows], JUDGED)


def companies(spark):
    rows = [("a", "Alpha", "critical", "human-approved"), ("b", "Beta", None, "fallback"), ("c", "Clash", "low", None)]
    return spark.createDataFrame(rows, "company_id string, name string, ambiguity string, query_source string")


def test_strata_do_not_depend_on_the_answer(spark):
    rows = [
        ("a", "Alpha wins", "u1", True, False), ("a", "Alpha soft", "u2", True, True), ("a", "Alpha SUED by all", "u3", True, True),
        ("b", "Beta wins", "u1", True, False), ("b", "Beta losses mount", "u2", True, False), ("b", "Betas glossy", "u4", True, False),
        ("b", "dropped", "u5", False, False), ("zz", "no company", "u6", True, False), (None, "null company", "u7", True, False),
        ("c", None, None, True, False), ("c", "", "", True, False), ("a", "Alpha wins", "u1", True, False), ("a", "Alpha again", "u1", True, False),
    ]
    pool = goldset.candidates(judged(spark, rows), companies(spark))
    got = sorted((r["company"], r["title"], r["stratum"], r["verdict"]) for r in pool.collect())
    assert got == [
        ("Alpha", "Alpha SUED by all", "negative-signal", "soft-pass"), ("Alpha", "Alpha again", "kept-ambiguous", "kept"),
        ("Alpha", "Alpha soft", "softpass", "soft-pass"), ("Beta", "Beta losses mount", "negative-signal", "kept"),
        ("Beta", "Beta wins", "kept-distinctive", "kept"), ("Beta", "Betas glossy", "kept-distinctive", "kept"), ("Clash", "", "kept-distinctive", "kept"),
    ]
    assert all(len(r["id"]) == 16 for r in pool.collect())


def by_hand(pool, targets):
    """The choice by plain loops: a round takes one of each company in order of name."""
    out = []
    for stratum, want in targets.items():
        of = {}
        for r in sorted((r for r in pool if r["stratum"] == stratum), key=lambda r: r["id"]):
            of.setdefault(r["company"], []).append(r["id"])
        rounds = [of[c][i] for i in range(max(map(len, of.values()), default=0)) for c in sorted(of) if i < len(of[c])]
        out += [(stratum, place + 1, one) for place, one in enumerate(rounds[:want])]
    return sorted(out)


def test_choice_equals_loops_and_one_loud_company_does_not_fill_it(spark):
    rows = [("a" if i % 10 else "b", f"title {i}", f"u{i}", True, i % 3 == 0) for i in range(400)]
    pool = goldset.candidates(judged(spark, rows), companies(spark)).persist()
    for targets in (goldset.TARGETS, {"softpass": 3, "kept-ambiguous": 1000}):
        got = goldset.choose(pool.repartition(5), targets).collect()
        assert sorted((r["stratum"], r["place"], r["id"]) for r in got) == by_hand(pool.collect(), targets)
        assert all(r["label"].relevant is None and r["label"].sentiment is None and r["label"].note == "" for r in got)
    soft = [r["company"] for r in goldset.choose(pool).where("stratum = 'softpass'").collect()]
    assert len(soft) == 20 and soft.count("Beta") == 10
    assert goldset.choose(pool.where("false")).count() == 0


def test_gold_set_files_and_labels(spark, tmp_path):
    rows = [("a", f"title {i}", f"u{i}", True, False) for i in range(30)] + [("b", "Beta fraud", "x", True, False)]
    folder = str(tmp_path / "gold")
    head = goldset.write_gold_set(goldset.candidates(judged(spark, rows), companies(spark)), folder, F.lit("2026-01-01")).first()
    assert head["items"] == 15 and head["companies"] == 2 and head["labelling"] == "unlabelled"
    assert head["strata"].asDict() == {"kept-distinctive": 0, "kept-ambiguous": 14, "softpass": 0, "negative-signal": 1}
    assert spark.read.json(f"{folder}/pool").count() == 31
    items = spark.read.json(f"{folder}/items")
    assert "relevant" in items.schema["label"].dataType.names

    labels = [("1", (None, None, "")), ("2", (False, None, "")), ("3", (False, "neutral", "")), ("4", (True, None, "")), ("5", (True, "glad", "")), ("6", (True, "negative", ""))]
    marked = spark.createDataFrame(labels, f"id string, label {goldset.LABEL}")
    assert {r["id"]: r["fault"] for r in goldset.label_faults(marked).collect()} == {
        "1": "unlabelled", "3": "sentiment of an irrelevant item", "4": "no sentiment", "5": "unknown sentiment",
    }
    good = sorted(map(tuple, goldset.labelled(marked).collect()))
    assert good == [("2", False, None), ("6", True, "negative")]


def test_coverage_audit_as_files(spark, tmp_path):
    who = spark.createDataFrame([("a", "Alpha", "critical"), ("b", "Beta", "high"), ("c", "Gamma", "high"), ("d", "Delta", "high")], "company_id string, name string, ambiguity string")
    seen = judged(spark, [("a", "x", "u", True, False), ("a", "y", "v", False, False), ("b", "z", "w", False, False)])
    failed = spark.createDataFrame([("d",), ("d",)], "company_id string")
    rows = collect.audit_rows(who, seen, failed)
    totals = evaluate.write_coverage(rows, str(tmp_path / "audit")).first()
    assert (totals["companies"], totals["fetched"], totals["kept"], totals["zero_fetched"], totals["zero_kept"], totals["failed"]) == (4, 3, 1, 1, 2, 1)
    assert totals["generated_for"] == "human-approved" and totals["window_days"] == 90
    zero = spark.read.json(str(tmp_path / "audit" / "zero")).collect()
    assert sorted((r["name"], r["fetched"]) for r in zero) == [("Beta", 1), ("Gamma", 0)]
    assert {r["name"]: r["kept"] for r in spark.read.json(str(tmp_path / "audit" / "rows")).collect()}["Delta"] == -1

"""Records held to a schema: every sort of fault, files that are no JSON, nothing lost."""

import json

import pytest

from newsgauge.sources import records

COMPANY = {
    "id": "1", "name": "A", "slug": "a", "aliases": [], "domain": None, "sector": None, "ambiguity": "low", "volume": "normal", "query": '"A"',
    "negativeKeywords": ["x"], "querySource": "fallback", "enrichedBy": None, "enrichedAt": None,
}


def faults_of(spark, values, fields):
    rows = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "n int, value string")
    good, bad = records.split_records(records.parse_records(rows), fields)
    found = {(r["n"], r["at"]): [(f["field"], f["problem"]) for f in r["faults"]] for r in bad.collect()}
    kept = {(r["n"], r["at"]) for r in good.collect()}
    assert not kept & found.keys()
    return kept, found


def test_company_records(spark):
    wrong = [
        COMPANY | {"ambiguity": "Low"}, COMPANY | {"aliases": ["a", 1]}, COMPANY | {"aliases": None}, COMPANY | {"aliases": [None]}, COMPANY | {"name": 5},
        {k: v for k, v in COMPANY.items() if k not in ("domain", "volume")}, COMPANY | {"domain": False, "querySource": "guess"}, COMPANY | {"aliases": "a"},
    ]
    kept, found = faults_of(spark, [COMPANY, COMPANY | {"extra": 1, "aliases": ["a", "é"]}, *wrong], records.COMPANY_RECORD)
    assert kept == {(0, 0), (1, 0)}
    assert found == {
        (2, 0): [("ambiguity", "choice")], (3, 0): [("aliases", "type")], (4, 0): [("aliases", "null")], (5, 0): [("aliases", "type")], (6, 0): [("name", "type")],
        (7, 0): [("domain", "missing"), ("volume", "missing")], (8, 0): [("domain", "type"), ("querySource", "choice")], (9, 0): [("aliases", "type")],
    }


def test_enrichment_bounds(spark):
    fine = {"known": True, "sector": "s" * 80, "aliases": ["a"] * 5, "domain": None, "ambiguity": "high", "contextTerms": [], "negativeKeywords": []}
    wrong = [fine | {"sector": "s" * 81}, fine | {"aliases": ["a"] * 6}, fine | {"contextTerms": ["x", "y" * 61]}, fine | {"known": "true"}, fine | {"known": 1}]
    kept, found = faults_of(spark, [fine, *wrong], records.ENRICHMENT_RECORD)
    assert kept == {(0, 0)}
    assert [found[(i, 0)] for i in range(1, 6)] == [
        [("sector", "too big")], [("aliases", "too many")], [("contextTerms", "too big")], [("known", "type")], [("known", "type")],
    ]


def test_numbers_keep_their_type(spark):
    fields = (records.Field("n", "integer", least=1, most=9),)
    values = ['{"n": 1}', '{"n": 1.0}', '{"n": 9e0}', '{"n": 1.5}', '{"n": "1"}', '{"n": 0}', '{"n": 10}', '{"n": true}', '{"n": [1]}', '{"n": 1e300}']
    kept, found = faults_of(spark, values, fields)
    assert kept == {(0, 0), (1, 0), (2, 0)}
    assert [found[(i, 0)][0][1] for i in range(3, 9)] == ["type", "type", "too small", "too big", "type", "type"] and found[(9, 0)]


def test_what_is_no_record(spark):
    kept, found = faults_of(spark, ["{", "", '[1, {"n": 2}, null]', "[]", "null", '"x"'], (records.Field("n", "integer"),))
    assert kept == {(2, 1)}
    assert found == {(0, 0): [(None, "json")], (1, 0): [(None, "json")], (2, 0): [(None, "object")], (2, 2): [(None, "object")], (4, 0): [(None, "object")], (5, 0): [(None, "object")]}


def test_files(spark, tmp_path):
    items = [{"url": "https://a.example/1", "title": "T"}, {"url": "no url", "title": ""}, {"url": "https://a.example/2", "title": "U", "snippet": None, "note": "x"}]
    (tmp_path / "a.json").write_text(json.dumps({"items": items}, indent=1))
    (tmp_path / "b.json").write_text('{"items": [')
    rows = records.read_records(spark, str(tmp_path), "$.items")
    good, bad = records.split_records(rows, records.CORPUS_ITEM)
    assert [r["title"] for r in good.orderBy("at").collect()] == ["T", "U"]
    got = sorted((r["file"][-6:], r["at"], [(f["field"], f["problem"]) for f in r["faults"]]) for r in bad.collect())
    assert got == [("a.json", 1, [("url", "type"), ("title", "too small")]), ("b.json", 0, [(None, "json")])]
    with pytest.raises(ValueError, match="too small"):
        records.require_records(rows, records.CORPUS_ITEM)

    (tmp_path / "lines").write_text("\n".join(json.dumps(i) for i in items) + "\nbroken")
    good, bad = records.split_records(records.read_records(spark, str(tmp_path / "lines"), lines=True), records.CORPUS_ITEM)
    assert good.count() == 2 and bad.count() == 2
    assert records.require_records(good.selectExpr("to_variant_object(struct(url, title)) AS record"), records.CORPUS_ITEM[:2]).count() == 2

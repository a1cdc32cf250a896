import re
from collections import defaultdict

import pytest

from newsgauge.llm import mixing, registry
from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, k string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share out the budget by weight, cap, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap, open_, target = {s: 2 * sizes[s] for s in names}, set(names), {s: 0.0 for s in names}
    left = 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= weight[s] * level}
        for s in full or open_:
            target[s] = float(cap[s]) if full else weight[s] * level
            left -= target[s]
        if not full:
            break
        open_ -= full
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, out):
    sizes = defaultdict(int)
    largest = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    most = max(largest.values(), default=0)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 * most + 1, (s, taken[s], target)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


ROWS = [(i, "w " * (1 + i * 7 % 23), f"s{i % 5}" if i % 6 else None) for i in range(300)] + [(900, None, "s1"), (901, "", "empty"), (1, "w " * 8, "s1"), (1, "w " * 8, "s1"), (None, "a b", "s2"), (902, "w " * 3000, "hot")]


def test_mix(spark):
    out = mixing.mix_sources(docs(spark, ROWS)).collect()
    check(ROWS, out)
    again = mixing.mix_sources(docs(spark, ROWS[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


@pytest.mark.parametrize("rows", [[], [(1, "a b c", "x")], [(1, None, None)], [(1, "a", "x"), (2, "b", None)]])
def test_small_tables(spark, rows):
    check(rows, mixing.mix_sources(docs(spark, rows)).collect())


def test_narrow_ranges_give_the_same_mix(spark, monkeypatch):
    """The range at the budget is cut again and again; ties of finish time end it."""
    rows = ROWS + [(2000 + i, "w " * 4, f"s{i % 5}") for i in range(40)] + [(3000 + i, "", "s1") for i in range(30)]
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"], r["copies"])
    once = sorted(map(key, mixing.mix_sources(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "TIME_BINS", 3)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    out = mixing.mix_sources(docs(spark, rows)).collect()
    check(rows, out)
    assert sorted(map(key, out)) == once


def test_apply_repeats_rows(spark):
    df = docs(spark, ROWS[:200])
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    counted = defaultdict(int)
    held = mixing.apply_mix(df)
    assert held.columns == df.columns
    for r in held.collect():
        counted[r["doc_id"]] += 1
    assert dict(counted) == {k: n for k, n in mixed.items() if n}


def test_query_matches_sql(spark):
    assert_same(registry.QUERIES["op2_mix_sources"](spark, SF), registry.ORACLES["op2_mix_sources"], connect(SF))

"""Source divergence against SQL over whole tables and plain Python over edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.llm import divergence, registry

from oracle import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert_same(registry.QUERIES["op13_source_divergence"](spark, sf), registry.ORACLES["op13_source_divergence"], connect(sf))


def brute(rows, least=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        count.update((lang, source, w) for w in found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted((w for (la, w), n in docs.items() if la == lang and n >= least), key=str.encode)
        own = sorted((s for la, s in groups if la == lang), key=str.encode)
        total = {s: sum(count[lang, s, w] for w in kept) for s in own}
        share = lambda n, all_of: 1 + 1_000_000_000 * (n + 2) // (all_of + 2 * len(kept))
        p = {s: [share(count[lang, s, w], total[s]) for w in kept] for s in own}
        q = [share(sum(count[lang, s, w] for s in own), sum(total.values())) for w in kept]
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own:
            parts = {
                "pair": [(sum(map(f, p[s], p[o])), o) for o in own if o != s],
                "term": [(f(a, b), w) for a, b, w in zip(p[s], q, kept, strict=True) if count[lang, s, w] and a > b],
            }
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < 10]
    return sorted(out)


def same(df, rows):
    got = df.select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute(rows)


EDGES = (
    [(k, "Alpha beta GAMMA_delta élan Élan 漢字", "en", "a") for k in range(12)]
    + [(k, "alpha zeta\x00zeta \x7f delta9delta", "en", "b") for k in range(11)]
    + [(50, None, "en", "nothing"), (51, "", "en", None), (52, "9 -- \n", None, None), (None, "rare", "xx", "p"), (53, "rare", "xx", "q")]
    + [(60, "beta " * 60_000 + "w" * 5_000, "en", "long")]
    + [(70, "same words here", "hot", f"s{k % 3}") for k in range(90)]
    + [(80 + k, " ".join(f"t{chr(97 + i)}" for i in range(26)), "tie", f"s{k % 2}") for k in range(20)]
)


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_edges(spark, cells):
    df = spark.createDataFrame(EDGES, DOCS).select("*", *[F.lit("own").alias(c) for c in ("term", "n", "docs", "part", "item", "rank", "chunk")])
    same(divergence.audit(df, cells=cells), EDGES)
    assert divergence.audit(df.limit(0)).count() == 0


def test_small_tallies_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence._Tally, "LIMIT", 2)
    got = Counter()
    for r in divergence.counts(spark.createDataFrame(EDGES[:30], DOCS).selectExpr("lang", "coalesce(source, '') source", "coalesce(text, '') text").na.fill("")).collect():
        got[r["term"]] += r["n"]
    assert got["alpha"] == 23 and got["zeta"] == 22 and got["élan"] == 12 and got["Élan"] == 12 and got["delta"] == 34 and "" not in got


def test_long_division_is_exact():
    counts = np.array([0, 1, 7, 10**9, 8 * 10**14], np.int64)
    for total, kept in ((8 * 10**14 + 3, 5), (10**9 + 10, 10**6), (8 * 10**14, 10**9)):
        want = [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in counts]
        assert divergence.share(counts, total, kept).tolist() == want

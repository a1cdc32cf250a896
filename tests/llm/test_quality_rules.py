import math
import random
import re
from collections import Counter

import pytest
import xxhash

from newsgauge.llm import quality_rules, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered, seen, dup = Counter(runs), set(), set(), 0
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 20 or 100 * rep > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(rows, out):
    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out), key=repr)
    assert got == want


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_words int, _ratios int")


def rows():
    rng = random.Random(7)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "x " * 30), (6, "é b  c\n\né b"), (7, "w " * 20_000), (8, "same\nsame\n same\n\n\nsame"), (8, "same\nsame"), (None, "n " * 9)]
    block = " ".join(f"p{i}" for i in range(12))
    out += [(20, f"{block} mid {block} end {block}"), (21, f"{block} {block}"), (22, "#*$%&|<> a#b")]
    for i in range(60):
        vocabulary = [f"v{j}" for j in range(rng.choice([2, 5, 400]))]
        out.append((100 + i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(60)))))
    return out


def test_base_columns(spark):
    none = spark.createDataFrame([], "doc_id long")
    found = quality_rules.quality_rules(docs(spark, rows()), none).collect()
    check(rows(), found)
    assert all(r["kept"] == (not r["base_failed"]) and r["llr"] == 0.0 for r in found)
    assert quality_rules.quality_rules(docs(spark, []), none).count() == 0


def test_unlike_texts_are_dropped(spark):
    rng = random.Random(1)
    some = lambda stem: " ".join(f"{stem}{rng.randrange(12)}" for _ in range(60))
    good, bad = [(i, some("good")) for i in range(60)], [(100 + i, some("junk")) for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(0,), (None,)], "doc_id long")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, good + bad), trusted).collect()}
    assert all(out[i]["kept"] for i, _ in good if not out[i]["base_failed"])
    assert not any(out[i]["kept"] for i, _ in bad)


def test_query_equals_brute_force(spark):
    every = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = registry.QUERIES["op6_quality_rules"](spark, SF).collect()
    check(every, found)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["kept"] for r in found if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) / len(good) > 0.98


@pytest.mark.parametrize("buckets", [64])
def test_ratio_is_a_mean_over_the_grams(spark, buckets):
    """The score against sums over an exploded table of the same grams."""
    from pyspark.sql import functions as F

    from newsgauge.llm.common import words

    some = [(i, " ".join(f"t{(i + j * j) % 9}" for j in range(25))) for i in range(8)]
    df, trusted = docs(spark, some), spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = quality_rules.quality_rules(df, trusted, buckets=buckets, mix=0.1)
    grams = df.select("doc_id", F.explode(quality_rules._grams(quality_rules._codes(words(F.col("text"))), buckets)).alias("g")).collect()
    raw, target, own = Counter(), Counter(), {}
    for r in grams:
        raw[r["g"]] += 1
        target[r["g"]] += r["doc_id"] in (1, 2)
        own.setdefault(r["doc_id"], []).append(r["g"])
    def share(c, g):
        return c[g] / sum(n for k, n in c.items() if (k >= buckets) == (g >= buckets))

    for r in out.collect():
        want = sum(math.log(0.9 * share(target, g) / share(raw, g) + 0.1) for g in own[r["doc_id"]]) / len(own[r["doc_id"]])
        assert abs(r["llr"] - want) < 1e-9


def brute_ratios(rows, trusted, buckets=8192, mix=0.05):
    """doc_id -> mean log ratio, from plain counts of XXH64 places of words and adjacent pairs."""
    places, raw, target = [], Counter(), Counter()
    for i, text in rows:
        codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
        codes = [c - (1 << 64) if c >> 63 else c for c in codes]
        own = [c % buckets for c in codes] + [buckets + ((a >> 1) ^ b) % buckets for a, b in zip(codes, codes[1:])]
        places.append((i, own))
        raw.update(own)
        if i in trusted:
            target.update(own)
    totals = {k: [sum(n for g, n in c.items() if (g >= buckets) == k) for c in (raw, target)] for k in (False, True)}

    def ratio(g):
        raw_n, target_n = totals[g >= buckets]
        return math.log((1 - mix) * (target[g] / target_n) / (raw[g] / raw_n) + mix) if target_n else 0.0

    return {i: sum(map(ratio, own)) / len(own) if own else 0.0 for i, own in places}


def test_query_verdicts_equal_brute_force(spark):
    every = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    want, failed = brute_ratios(every, trusted), {i: brute(t)[-1] for i, t in every}
    for r in registry.QUERIES["op6_quality_rules"](spark, SF).collect():
        assert abs(r["llr"] - want[r["doc_id"]]) < 1e-9
        assert r["kept"] == (not failed[r["doc_id"]] and want[r["doc_id"]] >= 0.02 * math.log(0.05))


def test_verdicts_do_not_depend_on_size(spark):
    """A corpus and its trusted documents many times over: every verdict and score as before."""
    from pyspark.sql import functions as F

    every, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1").select("doc_id")
    more = lambda df: df.withColumn("n", F.explode(F.array(*map(F.lit, range(7))))).withColumn("doc_id", F.col("doc_id") * 100 + F.col("n"))
    once = {r["doc_id"]: (r["kept"], r["llr"]) for r in quality_rules.quality_rules(every, trusted).collect()}
    many = quality_rules.quality_rules(more(every), more(trusted).select("doc_id")).collect()
    assert len(many) == 7 * len(once)
    assert all((r["kept"], r["llr"]) == once[r["doc_id"] // 100] for r in many)


def test_every_trusted_document_is_counted(spark):
    """All documents are trusted, beyond any number that a bound would keep: target and raw are one distribution."""
    some = [(i, " ".join(f"w{i}x{j}" for j in range(25))) for i in range(300)]
    out = quality_rules.quality_rules(docs(spark, some), spark.range(60_000)).collect()
    assert len(out) == 300 and all(abs(r["llr"]) < 1e-12 for r in out)

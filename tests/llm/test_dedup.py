"""Exact and near duplicates, and components, against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from newsgauge.llm import exact_dedup, registry, simhash
from newsgauge.llm.components import components
from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, bucket string, name string"


def docs(spark, rows):
    """rows of (doc_id, text); with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "clash", "clash") for i, t in rows], DOCS)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""])) for i, t in rows), key=repr)


CASES = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "ab" * 40), (6, "ab" * 40), (7, "ab" * 40 + "c"), (8, "ab" * 39 + "ac"), (4, "a"), (9, "ü" * 33), (10, "ü" * 33), (None, "a"), (11, "abab" * 16)]


@pytest.mark.parametrize("block", [3, 16, 32_768])
def test_exact_groups(spark, block):
    out = exact_dedup.exact_dedup(docs(spark, CASES), block_chars=block, buckets=7)
    rows = out.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=repr) == brute_exact(CASES)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({t or "" for _, t in CASES}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_rows_keep_their_columns(spark):
    held = exact_dedup.drop_exact_duplicates(docs(spark, CASES), block_chars=16)
    assert held.columns == docs(spark, CASES).columns
    assert sorted(r["doc_id"] for r in held.collect()) == [3, 4, 6, 7, 8, 10, 11]


NAMES = ["_row_key", "_nth", "_copies", "_repeat", "key", "row", "copies", "rid", "fp", "root", "rank"]


def test_stages_keep_columns_with_clashing_names(spark):
    from newsgauge.llm import mixing

    rows = [(i, f"words of text {i // 2} " * 20, "s") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(n).alias(n) for n in NAMES])
    for stage in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.apply_mix):
        held = stage(df)
        assert held.columns == df.columns
        found = held.collect()
        assert found and all(r[n] == n for r in found for n in NAMES)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_query_matches_sql(spark):
    assert_same(registry.QUERIES["op5_exact_dedup"](spark, SF), registry.ORACLES["op5_exact_dedup"], connect(SF))


def brute_fingerprint(text, k=4):
    words = [w for w in _lower(text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_components(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return sorted((d, f"{fps[i]:016x}", min(ids[root(i)])) for i, (d, _) in enumerate(rows))


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÉTÉ", "Ünder", "ABC"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A B\tC")]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 200, 400]))] for _ in range(12)]
    for n in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + n, " ".join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"blocks": 6}, {"blocks": 8, "hot": 3}])
def test_near_components(spark, options):
    rows = near_rows(3)
    out = simhash.simhash_components(docs(spark, rows), **options)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out.collect())
    assert got == brute_components(rows)


def test_near_edges(spark):
    same = [(1, "x y z"), (1, "x y z"), (7, "x y z")]
    out = simhash.simhash_components(docs(spark, same)).collect()
    assert [r["component_id"] for r in out] == [1, 1, 1]
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    held = simhash.drop_near_duplicates(docs(spark, same))
    assert held.columns == docs(spark, same).columns and held.count() == 1


def test_near_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.QUERIES["op9_simhash"](spark, SF).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute_components(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 130)}, 300: 300, 301: 300}
    assert components(df.where("u < 0")).count() == 0


def test_warm_links_find_the_same_pairs(spark):
    """Values around hot fingerprints connect exactly those within 4 bits."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 40:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    def parts(hot):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, hot=hot)).collect()}
        return sorted((x, found.get(x, x)) for x in signed)
    assert parts(1) == parts(10_000)

"""The pipeline's stages, each held against brute force on its own input."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken

import corpus_pipeline
from newsgauge.llm import mixing, quality_classifier, simhash
from newsgauge.llm.common import materialize
from test_dedup import brute_exact
from test_mixing import brute_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, made))
        docs = made
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    for given, made in stages[:-1]:
        assert made.schema.names == given.schema.names


def test_quality_keeps_what_scores_enough(spark, stages):
    given, made = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"] for r in quality_classifier.classify(given, labels).where("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(want)


def test_exact_stage(stages):
    rows = pairs(stages[1][0])
    assert sorted(i for i, _ in pairs(stages[1][1])) == sorted(i for i, keep, _ in brute_exact(rows) if i == keep)


def brute_near(rows, shingle=5, similarity=0.8):
    """id -> smallest id of its component, over all pairs of texts."""
    def grams(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    every = [(i, grams(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in every}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(every):
        for j, b in every[:k]:
            if len(a & b) >= similarity * len(a | b):
                x, y = sorted((of(i), of(j)))
                root[y] = x
    return {i: of(i) for i in root}


def test_near_stage(stages):
    rows = pairs(stages[2][0])
    root = brute_near(rows)
    assert sorted(i for i, _ in pairs(stages[2][1])) == sorted(i for i in root if root[i] == i)


@pytest.mark.parametrize("hot", [4096, 4])
def test_near_copies_of_many_grades(spark, hot):
    """Copies with 0 to 12 of 200 words changed: what is under the threshold stays, what is over it is found."""
    rng = random.Random(3)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((base * 100, " ".join(words)))
        for k in range(1, 13):
            changed = words[:]
            for at in rng.sample(range(200), k):
                changed[at] = f"x{rng.randrange(10**6)}"
            rows.append((base * 100 + k, " ".join(changed)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.near_components(df, hot=hot).collect()}
    root = brute_near(rows)
    assert all(root[i] == root[j] for i in root for j in root if got[i] == got[j])
    pairs_ = [(i, j) for i in root for j in root if i < j and root[i] == root[j]]
    assert sum(got[i] == got[j] for i, j in pairs_) / len(pairs_) >= 0.97


def test_no_pair_right_at_the_threshold_is_left_out(spark):
    """400 pairs that share 160 of 200 shingles, and 100 that share 159 of 201: keys by chance miss one in fifty."""
    rng = random.Random(8)
    rows, want = [], set()
    for base in range(500):
        words = [f"w{rng.randrange(10**7)}" for _ in range(184)]
        other = words[:]
        for at in (20, 60, 100, 140):
            other[at] = f"x{rng.randrange(10**7)}"
        if base >= 400:
            words, other = words[:183] + ["a"], other[:183] + ["b"]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
        want |= {2 * base} if base < 400 else {2 * base, 2 * base + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == want


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"y{rng.randrange(10**6)}" if k == i % 120 else w for k, w in enumerate(words))) for i in range(600)]
    rows += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())
    assert held == [0, *range(1000, 1050)]


def test_a_passage_that_unlike_texts_share(spark):
    """Most least shingles lie in the passage; the keys are cut by the fingerprint until few texts share one."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, f"{passage} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(90))) for i in range(1_500)]
    rows += [(9_000 + i, rows[i][1] + " again") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = simhash.drawn_blocks(simhash.KEY_BITS, 0.22, 0.98, 0)
    sketched = simhash.sketches(df, "doc_id", "text", 5, blocks).select("doc_id", "fp", F.explode("keys").alias("key"))
    largest = lambda keyed: keyed.groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest(simhash.cut_keys(sketched, 8, 0.8, 0.98)) < largest(sketched) / 2.5
    held = [r["doc_id"] for r in simhash.drop_near_duplicates(df, hot=8).collect()]
    assert sorted(held) == list(range(1_500))


def test_near_stage_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (5, "A"), (None, "a b"), (None, "a b"), (6, "A B"), (7, "c " * 50_000), (8, "d e f g h")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string")
    held = simhash.drop_near_duplicates(df)
    assert held.columns == df.columns
    assert sorted((r["doc_id"] for r in held.collect())) == [1, 4, 6, 7, 8]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_mix_stage(stages):
    given, made = stages[3]
    sizes, taken = {}, {}
    for r in given.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    for r in made.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    largest = max(words(t) for _, t in pairs(given))
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 2 * largest
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(given).collect() if r["copies"]}
    got = {}
    for i, _ in pairs(made):
        got[i] = got.get(i, 0) + 1
    assert got == want


def test_bpe_stage(stages):
    given, made = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(pairs(given))
    rows = made.collect()
    assert len(rows) == given.count()
    for r in rows:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_applies_all_stages(spark, stages):
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[-1][1].collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0

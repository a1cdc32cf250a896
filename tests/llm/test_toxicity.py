"""Toxicity: held-out accuracy, subword sharing, scores recomputed in plain Python, edge cases."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from newsgauge.llm import registry, toxicity

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
#: A few texts of each kind; the bad ones share a stem.
PLAIN = ["the road leads to town", "water runs down hill", "we read books at night", "green trees stand there"]
BAD = ["you grumblers lie", "what a grumbler today", "grumbling people again", "old grumbled words here"]


def corpus(spark, extra=()):
    rows = [(i, f"{(BAD if i % 3 == 0 else PLAIN)[i % 4]} {'abcdefgh'[i % 8] * 3}") for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in [*rows, *extra]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], LABELS)
    return docs, labels


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.QUERIES["op11_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    clean = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    # 3,155 training texts: clean ones are left alone, toxic ones rank first (16,000 find 97 %)
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.01 and sum(s >= 0.5 for s in toxic) / len(toxic) > 0.5
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9


def test_unseen_spellings_share_vectors(spark):
    odd = [(1000, "a grumb1er xx"), (1001, "hill people read"), (1002, "grumblerrr"), (1003, "GRUMBLER!")]
    docs, labels = corpus(spark, odd)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert min(got[1000], got[1002], got[1003]) > 0.5 > got[1001]


def test_edges(spark):
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "grumbler"), (1003, "grumbler"), (1003, "grumbler"), (1004, "漢" * 60_000), (1005, "quiet words " * 60_000)]
    docs, labels = corpus(spark, odd)
    more = spark.createDataFrame([(None, 1, 1), (3, 1, None), (6, 1, 0)], LABELS)
    names = ["rank", "label", "at", "weight", "name", "shard", "id", "score", "held_out"]
    rows = toxicity.classify(docs.select("*", *[F.lit(1).alias(c) for c in names]), labels.unionByName(more)).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 240 + len(odd) and got[1000] == got[1001] == got[1002] and got[None] == got[1003] > 0.5
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_rows_of_one_id_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k % 50} of one id", "en", "s") for k in range(500)], DOCS)
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert zlib.crc32(b"1") % 5
    assert toxicity.train(docs, labels, max_rows=20).margins()[1] > 0
    assert (toxicity.train(docs, labels, max_bytes=10).margins()[0] == toxicity.Model.fresh().margins()[0]).all()


def plain_grams(word):
    word = f"<{word}>"
    mask, out = (1 << 64) - 1, []
    for n in toxicity.GRAMS:
        for i in range(len(word) - n + 1):
            code = 0
            for c in word[i : i + n]:
                code = ((code * 0x100000001B3 & mask) ^ (ord(c) + 1)) * 0x9E3779B97F4A7C15 & mask
            out.append((((code ^ code >> 29) * 0x9E3779B97F4A7C15 + n) & mask) >> 64 - toxicity.BITS)
    return out


def test_scores_equal_brute_force(spark):
    docs, labels = corpus(spark, [(900, "Grumbler élan 漢字 a"), (901, "no no no yes")])
    held = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    margins, bias = toxicity.train(docs, held).margins()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.classify(docs, labels).collect():
        bag = [g for w in set(texts[r["doc_id"]].lower().split()) for g in plain_grams(w)]
        mean = sum(margins[g] for g in bag) / len(bag)
        assert abs(r["score"] - 1 / (1 + math.exp(-(bias + mean * math.sqrt(len(bag)))))) < 1e-6


def test_bag_in_parts_equals_bag_at_once():
    text = " ".join(f"word{i} x{i * 7}y" for i in range(3_000))
    (a, x), (b, y) = toxicity.bag(text), toxicity.bag(text, words_at_once=100)
    assert (a == b).all() and (x == y).all() and x.sum() == len(plain_grams("word0")) + sum(len(plain_grams(w)) for w in text.split()[1:])
    for rows, times in ((a, x), toxicity.bag(None), toxicity.bag("a")):
        again = toxicity.unpacked(toxicity.packed(rows, times))
        assert (again[0] == rows).all() and (again[1] == times).all()


def test_learning_moves_both_layers_down_the_loss():
    model, bags = toxicity.Model.fresh(), [toxicity.bag(t) for t in ("good day", "grumbler")]
    loss = lambda: sum(np.log1p(np.exp(-(1 if y else -1) * (toxicity.weights(n) @ model.margins()[0][a] + model.margins()[1]))) for (a, n), y in zip(bags, (0, 1), strict=True))
    before, embeddings, softmax = loss(), model.embeddings.copy(), model.softmax.copy()
    for _ in range(20):
        model.learn(bags, [0, 1], 0.1)
    assert loss() < before / 2 and (model.embeddings != embeddings).any() and (model.softmax != softmax).all()

"""Merkle manifest against trees built in plain Python, over whole tables and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from newsgauge.llm import merkle, registry

from oracle import assert_same, connect

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def path(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        run = nodes[first : first + 3]
        yield run[: at - first], run[at - first + 1 :]
        at //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {g: sorted(((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in groups[g]) if len(groups[g]) == 1 else sorted((((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in groups[g]), key=lambda x: x[0]) for g in names}
    trees = {g: tree([key[2] for key, _ in leaves[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (key, r) in enumerate(leaves[g]):
            steps = [*path(trees[g], i), *path(top, k)]
            text = r[4]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            again = leaf(*r[:4], text)
            for left, right in steps:
                again = h(*left, again, *right)
            root = top[-1][0]
            out.append((r[0], key[2], trees[g][-1][0], root, h(*[x for a, b in steps for x in a + b]), again, again == root))
    return sorted(out, key=repr)


def same(df, rows):
    got = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_query_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "FRAGMENT_BITS", bits)
    monkeypatch.setattr(merkle, "FAN", 3)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    same(registry.QUERIES["op12_merkle_manifest"](spark, sf), [tuple(r) for r in docs.collect()])


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(registry.QUERIES["op12_merkle_manifest"](spark, sf), registry.ORACLES["op12_merkle_manifest"], connect(sf))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FRAGMENT_BITS", 3)
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (1, None, "en", 1, "a\nb"), (1, None, "en", 1, "a\nb"), (2, "", "x", None, ""), (3, "é", "x", 3, "漢\n"), (4, "z", "x", 3, "q\n"), (5, "long", "x", 9, "line\n" * 200_000)]
    rows += [(k, "hot", "en", k, f"t{k}\n") for k in range(400)] + [(7, "copies", "en", 1, "same\n")] * 300
    df = spark.createDataFrame(rows, DOCS)
    named = df.select("*", *[F.lit(1).alias(c) for c in ("grp", "digest", "alt", "at", "tree", "frag", "leaf", "kind", "pos")])
    same(merkle.document_manifest(named), rows)
    assert merkle.document_manifest(df.limit(0)).count() == 0
    one = merkle.document_manifest(df.where("doc_id = 4 AND source = 'z'")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h()


def test_any_grouping_of_fragments_gives_the_same_nodes():
    leaves = {i: h(str(i)) for i in range(100)}
    whole = merkle.Forest(100)
    for i, d in leaves.items():
        whole.add(0, i, d)
    whole.fold()
    for cuts in ([7, 50, 51, 99], [1, 2, 3], [33, 66]):
        parts, total = [], merkle.Forest(100)
        for a, b in zip([0, *cuts], [*cuts, 100], strict=True):
            part = merkle.Forest(100)
            for i in range(a, b):
                part.add(0, i, leaves[i])
            part.fold()
            parts.append(part)
        for part in reversed(parts):
            for level, left in enumerate(part.open):
                for i in left:
                    total.add(level, i, part.levels[level][i])
            total.fold()
        assert total.levels[-1] == whole.levels[-1] and sum(map(len, total.open)) == 1

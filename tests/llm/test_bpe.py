import base64
import hashlib
import random
import time

import numpy as np
import pytest
import tiktoken
import public_tokenizers as P

from newsgauge.llm import bpe, registry

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Tables(bpe.read_ranks(PATH)), P.PATTERN)


def texts():
    rng = random.Random(2)
    hard = [
        "", " ", "  ", "   x", "a  b", "a   b ", "a \tb", "a  \tb", "x\n y\n\n z", "\n\n", "it's they'll I'D we've", "don 't", "été über 漢字 かな",
        "12 345,678", "a  b  c", "  x", "emoji 🙂🙂 🙂", "<|endoftext|>", "tail ", "$$$$ ### !!", "aaaa" * 80, "x" * 3000, "ab" * 700,
        "thequickbrownfox" * 30, "=" * 2000 + "-", "0" * 999, "ä" * 400, "The " * 2000,
    ]
    alphabet = "abc  \n\t'.é漢1 $"
    return hard + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]


def test_encode_as_the_library(codec, encoding):
    cases = texts()
    for text, (ids, back) in zip(cases, codec.texts([t.encode() for t in cases]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text), text[:40]
        assert back.decode() == text


def test_long_words_contract_round_by_round(codec, encoding):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdet") for _ in range(n)) for n in (199, 200, 450)] + ["aab" * 200]
    got = codec.encode_pieces([p.encode() for p in pieces])
    assert got == [encoding._core_bpe.encode_single_piece(p.encode()) for p in pieces]


def test_long_pieces_contract_in_many_places(codec, encoding):
    """Runs, few letters (many overlapping pairs), merges of lower rank than their parts."""
    rng = random.Random(5)
    alphabets = ["abc", "aab", "=- ", "etaoin", "abcdefghijklmnopqrstuvwxyz", "01", "\u00e9\u00e9a"]
    pieces = ["".join(rng.choice(a) for _ in range(rng.randrange(90, 500))).encode() for a in alphabets for _ in range(12)]
    assert codec.encode_pieces(pieces) == [encoding._core_bpe.encode_single_piece(p) for p in pieces]


def test_very_long_pieces_in_seconds(codec, encoding):
    rng = random.Random(6)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.monotonic()
    for text in (letters, "a" * 200_000):
        ids, back = next(codec.texts([text.encode()]))
        assert back.decode() == text
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
    assert time.monotonic() - began < 120


def test_cache_starts_afresh(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3 * bpe.ENTRY_BYTES)
    small = bpe.Codec(bpe.Tables(bpe.read_ranks(PATH)), P.PATTERN)
    for text in ["alpha beta gammaz deltaz", "epsz alpha", "betaz etaz thetaz"]:
        assert np.frombuffer(next(small.texts([text.encode()]))[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_dataframe_round_trip(spark, encoding):
    rows = [(i, t, "n", "i") for i, t in enumerate(texts()[:60])] + [(None, "null id", "n", "i"), (900, None, "n", "i"), (1, " ", "n", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")
    out = bpe.encode(df, PATH, P.PATTERN)
    found = out.collect()
    assert len(found) == len(rows)
    want = {i: t or "" for i, t, *_ in rows}
    for r in found:
        ids = encoding.encode_ordinary(want[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(out, PATH, P.PATTERN).collect()}
    assert back == want
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, encoding):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_decoded_column_comes_from_the_ids():
    """A codec whose encoding of a word is wrong cannot give that word's digest."""
    codec = bpe.Codec(bpe.Tables(bpe.read_ranks(PATH)), P.PATTERN)
    assert [back for _, back in codec.texts([b"the house and"])] == [b"the house and"]
    codec.spaced[b"house"] = codec.spaced[b"and"]
    assert [back for _, back in codec.texts([b"the house and"])] == [b"the and and"]

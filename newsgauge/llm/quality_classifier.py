"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

Features of a text are its words, adjacent word pairs, and pairs of word shapes
(``the&&&`` has the shape ``a&``), hashed into 2**bits places; an immediate repeat of a
word is a feature of its own. A feature's value is its share of the text's features,
times a constant. Scoring is a sparse dot product of the whole text.

Training takes at most ``max_rows`` labelled documents (smallest hashes of their ids, one
text an id), deals them by hash to a fixed number of shards, runs
follow-the-regularised-leader on every shard in its own task and averages the weights,
so neither the tasks nor what comes to the driver grow with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .langid import held_out

BITS = 18
SCALE = 20.0
SHARDS = 6


class _Hashes(dict):
    """word -> (word hash, shape hash) packed in one integer; emptied when full."""

    LIMIT, CHARS = 120_000, 4_000_000

    def __init__(self):
        self.held = 0

    def __missing__(self, word: str) -> int:
        shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", shape))
        code = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode("utf-8", "surrogatepass"), 7)
        self[word] = code
        self.held += len(word)
        return code

    def make_room(self) -> None:
        if len(self) > self.LIMIT or self.held > self.CHARS:
            self.clear()
            self.held = 0


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts, one text after the other, and each text's number of them."""
    hashes.make_room()
    found, sizes = [], []
    for text in texts:
        own = text.split() if text else []
        found += own
        sizes.append(len(own))
    code = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    sizes = np.array(sizes, np.int64)
    first = np.zeros(len(found), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before, shape_before = np.roll(word, 1), np.roll(shape, 1)
    before[first], shape_before[first] = 0, 0
    pair = _mixed(before * np.uint64(0x100000001B3) ^ word, 2)
    pair[(before == word) & ~first] = 1
    places = np.stack([_mixed(word, 1), pair, _mixed(shape_before * np.uint64(0x100000001B3) ^ shape, 3)], axis=1)
    return places.reshape(-1), 3 * sizes


def packed(text: str | None, hashes: _Hashes) -> tuple[bytes, bytes, float]:
    """A text's distinct feature places, how often each occurs, and the value of one occurrence."""
    places, count = features([text], hashes)
    at, times = np.unique(places, return_counts=True)
    return at.astype("<i4").tobytes(), times.astype("<i4").tobytes(), SCALE / max(1, int(count[0]))


def ftrl(
    texts: list[tuple[bytes, bytes, float]], labels: list[int], alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> np.ndarray:
    """Weights of one shard, the bias last: FTRL-proximal, one packed text at a time in the given order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for (at, times, value), label in zip(texts, labels, strict=True):
            at = np.append(np.frombuffer(at, "<i4"), size - 1)
            x, w = np.append(np.frombuffer(times, "<i4") * value, 1.0), weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(size))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    alpha: float = 0.3,
    beta: float = 0.1,
    l1: float = 0.01,
    l2: float = 0.1,
    epochs: int = 3,
) -> np.ndarray:
    """Averaged FTRL weights from the labelled rows; zeros if there is none.

    An id's labels tie to the largest, and of its rows the text with the least hash is
    learnt, so an id that many rows share is one document of the ``max_rows``.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    ids = known.groupBy("id").agg(F.max("label").alias("label"))
    rank = F.xxhash64(F.col("id").cast("string"))
    ids = ids.orderBy(rank, "id").limit(max_rows)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = thin.join(F.broadcast(ids), "id")  # at most max_rows ids
    rows = rows.select(F.pmod(F.hash("id"), F.lit(SHARDS)).alias("shard"), rank.alias("rank"), "label", "text", "id", F.xxhash64("text").alias("one"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for batch in slices(whole, 3):
                at, times, value = zip(*[packed(t, hashes) for t in batch.column(3).to_pylist()], strict=True)
                bags = [pa.array(at, pa.binary()), pa.array(times, pa.binary()), pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[4:], *batch.columns[:3], *bags], ["id", "one", *bag])

    # a text's features are at most 2**BITS numbers, however long it is
    bag = ("shard", "rank", "label", "at", "times", "value")
    id_type = ids.schema["id"].dataType.simpleString()
    cuts = rows.mapInArrow(cut, f"id {id_type}, one bigint, shard int, rank bigint, label int, at binary, times binary, value double")
    # repeats of an id meet in part where they lie, so none of them fills a task
    cuts = cuts.groupBy("id").agg(F.min(F.struct("one", *bag)).alias("r")).select(*[f"r.{c}" for c in bag])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "value", "at"])
        w = ftrl(list(zip(pdf["at"], pdf["times"], pdf["value"], strict=True)), pdf["label"].tolist(), alpha, beta, l1, l2, epochs)
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "n": [len(pdf)]})

    shards = cuts.groupBy("shard").applyInPandas(fit, "w binary, n bigint").collect()  # SHARDS rows
    total = np.zeros((1 << BITS) + 1)
    for s in shards:
        total += np.frombuffer(s["w"], "<f4") * s["n"]
    return (total / max(1, sum(s["n"] for s in shards))).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """doc_id, score and the columns in keep, one row per input row, no shuffle."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = sent.value, _Hashes()
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores(batch.column(1).to_pylist(), w, hashes))], ["doc_id", "score"]
                )

    return thin.mapInArrow(run, f"doc_id {id_type}, score double")


def scores(texts: list[str | None], weights: np.ndarray, hashes: _Hashes) -> np.ndarray:
    places, counts = features(texts, hashes)
    total, full = np.zeros(len(texts)), np.flatnonzero(counts)
    if len(full):
        total[full] = np.add.reduceat(weights[places].astype(np.float64), (np.cumsum(counts) - counts)[full])
    margin = weights[-1] + total * SCALE / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options
) -> DataFrame:
    """doc_id, held_out, score, predicted; trained on labelled rows that are not held out.

    Null, empty and word-less texts get the score of the bias alone. Repeated rows score
    alike; labels of one id tie to the largest. Without labels every score is 0.5. An
    empty input gives no rows; only the id and the text of docs are read.
    """
    weights = train(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, **options)
    return score(docs, weights, id_col, text_col).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs whose whole text scores at least threshold, all columns kept, no shuffle."""
    weights = train(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = sent.value, _Hashes()
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), w, hashes) >= threshold))

    return docs.mapInArrow(run, docs.schema)

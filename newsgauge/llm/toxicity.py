"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly.

A text is the bag of the character n-grams (3 to 5 letters, word ends marked) of its distinct
words in lower case, so that a spelling never seen shares most of its vectors with the one
that was. The embeddings of the bag are averaged; the average is taken in units of its spread,
that is times the root of the bag's size, so that a few words count in a long text as well. A
linear softmax over two classes reads it. Embeddings and softmax are trained together by
Adagrad.

Distinct words, since copies of one word say no more than the word does. Once trained, a text's
margin is a sum over its words, so scoring looks up one number a word and reads whole texts.

Training takes at most ``max_rows`` labelled texts (smallest hashes of their ids) and ``max_bytes``
of packed bags. They are one task: shards that learn apart and are averaged miss more of the
toxic texts. Neither that task nor the model that comes back grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .langid import held_out

BITS = 17
DIM = 16
GRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the n-grams of all words, one word after the other, and each word's number of them."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))
    rows, owners, code = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        ahead = np.zeros(len(chars), np.uint64)
        ahead[: max(0, len(chars) - n + 1)] = chars[n - 1 :]
        code = (code * _PRIME ^ ahead + np.uint64(1)) * _MIX
        if n in GRAMS:
            whole = left >= n
            rows.append((((code ^ code >> np.uint64(29)) * _MIX + np.uint64(n))[whole] >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[whole])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return np.concatenate(rows)[order], np.bincount(at, minlength=len(marked))


def distinct_words(text: str | None) -> list[str]:
    return sorted(set(text.lower().split())) if text else []


def bag(text: str | None, words_at_once: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct embedding rows, ascending, and how often each occurs."""
    times = np.zeros(1 << BITS, np.int64)
    for part in _parts(distinct_words(text), words_at_once):
        times += np.bincount(subwords(part)[0], minlength=1 << BITS)
    rows = np.flatnonzero(times)
    return rows, times[rows]


def weights(times: np.ndarray) -> np.ndarray:
    """What each row of a bag weighs: its times over the root of the bag's size."""
    return (times / np.sqrt(max(1, times.sum()))).astype(np.float32)


def packed(rows: np.ndarray, times: np.ndarray) -> bytes:
    """A bag in one to two bytes a row: steps between rows and times, byte by byte of significance, compressed."""
    both = np.stack([np.diff(rows, prepend=0), times], axis=1).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(len(rows), 8).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<u4")
    return np.cumsum(both[:, 0], dtype=np.int64), both[:, 1].astype(np.int64)


def _parts(words: list[str], most: int, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The words in runs of at most so many, and some so many characters; one word at least."""
    part, held = [], 0
    for word in words:
        if part and (len(part) == most or held + len(word) > chars):
            yield part
            part, held = [], 0
        part.append(word)
        held += len(word)
    if part:
        yield part


@dataclass
class Model:
    """Embeddings and their Adagrad sums, softmax weights and bias with theirs."""

    embeddings: np.ndarray
    embeddings_seen: np.ndarray
    softmax: np.ndarray
    softmax_seen: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 0) -> Model:
        start = (np.random.default_rng(seed).random((1 << BITS, DIM), np.float32) - 0.5) / DIM
        return cls(start, np.full(1 << BITS, 1e-8, np.float32), np.zeros((2, DIM + 1)), np.full((2, DIM + 1), 1e-8))

    def learn(self, bags: Iterable[tuple[np.ndarray, np.ndarray]], labels: list[int], rate: float) -> None:
        """One pass over the texts in the given order; embeddings and softmax move together."""
        for (at, times), label in zip(bags, labels, strict=True):
            weight = weights(times)
            own = self.embeddings[at]
            x = np.append(weight @ own, 1.0)
            z = self.softmax @ x
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            inner = (p @ self.softmax[:, :DIM]).astype(np.float32)
            step = np.outer(p, x)
            self.softmax_seen += step * step
            self.softmax -= rate * step / np.sqrt(self.softmax_seen)
            self.embeddings_seen[at] += weight * weight * float(inner @ inner) / DIM
            self.embeddings[at] = own - (rate * weight / np.sqrt(self.embeddings_seen[at]))[:, None] * inner

    def margins(self) -> tuple[np.ndarray, float]:
        """What an embedding row adds to the log odds of label 1, and the bias."""
        across = self.softmax[1] - self.softmax[0]
        return self.embeddings.astype(np.float64) @ across[:DIM], float(across[DIM])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 16_000,
    max_bytes: int = 200_000_000,
    rate: float = 0.3,
    passes: int = 3,
) -> Model:
    """The model after ``passes`` passes over the labelled texts; a fresh one if there is none.

    A text that rows of one id repeat is learned once, labels of one id tie to the largest.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    ids = known.groupBy("id").agg(F.max("label").alias("label"))
    rank = F.xxhash64(F.col("id").cast("string"))
    ids = materialize(ids.orderBy(rank, "id").limit(max_rows), "labelled")
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = thin.join(F.broadcast(ids), "id")  # at most max_rows ids
    rows = rows.select(rank.alias("rank"), F.xxhash64("text").alias("name"), (F.col("label") > 0).cast("int").alias("label"), "text")
    # rows of one id may be any number: distinct texts are chosen by name before one is cut
    chosen = materialize(rows.select("rank", "name").distinct().orderBy("rank", "name").limit(max_rows), "chosen")
    rows = rows.join(F.broadcast(chosen), ["rank", "name"]).dropDuplicates(["rank", "name"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, rows=50, size=500_000):
                bags = pa.array([packed(*bag(t)) for t in batch.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], bags], ["rank", "name", "label", "bag"])

    # a text's bag is at most 2**BITS rows, however long it is
    bags = materialize(rows.mapInArrow(cut, "rank bigint, name bigint, label int, bag binary"), "bags")
    order = Window.orderBy("rank", "name").rowsBetween(Window.unboundedPreceding, 0)
    sizes = bags.select("rank", "name", F.sum(F.length("bag")).over(order).alias("bytes"))  # a few numbers for each of max_rows rows
    fit = bags.join(F.broadcast(sizes.where(F.col("bytes") <= max_bytes).select("rank", "name")), ["rank", "name"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("rank", "name", "label", "bag")], strict=True)]
        found.sort(key=lambda row: row[:2])
        model = Model.fresh()
        for k in range(passes if found else 0):
            order = np.random.default_rng(k).permutation(len(found))
            model.learn((unpacked(found[i][3]) for i in order), [found[i][2] for i in order], rate * (1 - k / passes))
        parts = [pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes()], pa.binary()) for x in vars(model).values()]
        yield pa.RecordBatch.from_arrays(parts, [f"p{i}" for i in range(len(parts))])

    learned = fit.repartition(1).mapInArrow(learn, "p0 binary, p1 binary, p2 binary, p3 binary").first()
    start = Model.fresh()
    if learned is None:
        return start
    return Model(*[np.frombuffer(x, y.dtype).reshape(y.shape).copy() for x, y in zip(learned, vars(start).values(), strict=True)])


class _Margins(dict):
    """word -> (sum of its rows' margins, number of rows); emptied when full."""

    LIMIT, CHARS = 200_000, 8_000_000

    def __init__(self, margins: np.ndarray):
        self.margins, self.held = margins, 0

    def learn(self, words: set[str]) -> None:
        if len(self) > self.LIMIT or self.held > self.CHARS:
            self.clear()
            self.held = 0
        for part in _parts([w for w in words if w not in self], 50_000):
            rows, sizes = subwords(part)
            at = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0.0], np.cumsum(self.margins[rows])])
            total = (sums[at[1:]] - sums[at[:-1]]).tolist()
            for word, t, n in zip(part, total, sizes.tolist(), strict=True):
                self[word] = (t, n)
                self.held += len(word)


def scores(texts: list[str | None], bias: float, known: _Margins) -> list[float]:
    own = [set(t.lower().split()) if t else set() for t in texts]
    known.learn(set().union(*own))
    out = []
    for words in own:
        total, size = 0.0, 0
        for word in words:
            t, n = known[word]
            total, size = total + t, size + n
        out.append(bias + total / np.sqrt(max(1, size)))
    return (1 / (1 + np.exp(-np.clip(out, -35, 35)))).tolist()


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options
) -> DataFrame:
    """doc_id, held_out, score, predicted; trained on labelled rows that are not held out; no shuffle of texts.

    Null, empty and word-less texts get the score of the bias alone. Repeated rows score alike.
    Without labels every score is 0.5. An empty input gives no rows; only the id and the text
    of docs are read.
    """
    model = train(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, **options)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.margins())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = sent.value
        known = _Margins(margins)
        for whole in batches:
            for batch in slices(whole, 1):
                found = pa.array(scores(batch.column(1).to_pylist(), bias, known), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    scored = thin.mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

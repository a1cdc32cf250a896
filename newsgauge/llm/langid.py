"""Language identification by word-first backoff.

A word seen in training scores its per-language log frequency. An unseen word is read
through its character n-grams: at each place the longest known n-gram scores, from
``max_gram`` characters down to one. Scores of all words of the whole text are added
to the log prior of the language; the softmax of the sums is the score.

The model is fitted on at most ``max_docs`` training rows (those of the smallest
hashes of their ids) and holds the ``max_words`` most frequent words and ``max_grams``
n-grams of each language, so what is sent to the executors does not grow with the
corpus and a language with little text keeps its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import let

#: Letters; digits and underscores end a word. No-letter numerals are dropped below.
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    floor: np.ndarray
    max_gram: int

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the places of a word of the score of the longest known n-gram there."""
        padded, total, places = f"^{word}$", np.zeros(len(self.langs)), 0
        at, last = 0, len(padded)
        while at < last:
            for n in range(min(self.max_gram, last - at), 0, -1):
                found = self.grams.get(padded[at : at + n])
                if found is not None:
                    total, places = total + found, places + 1
                    break
            at += 1
        return total / places if places else self.floor


class _Rows(dict):
    """word -> row of a growing score matrix; one per Python worker, emptied when full."""

    LIMIT, CHARS = 300_000, 16_000_000

    def __init__(self, model: Model):
        self.held, self.model, self.matrix = 0, model, np.empty((4096, len(model.langs)))

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        known = self.model.words.get(word)
        if known is None:
            known = self.model.unseen(word) if word.isalpha() else np.zeros(len(self.model.langs))
        self.matrix[row] = known
        self[word] = row
        self.held += len(word)
        return row


def train(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    max_docs: int = 20_000,
    max_words: int = 50_000,
    max_grams: int = 50_000,
    max_gram: int = 4,
    smooth: float = 0.5,
) -> Model:
    """Fit on rows of df with a language; counts are Spark aggregations."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.xxhash64(F.col(id_col).cast("string"))
    cut = rows.select(rank.alias("r")).orderBy("r").limit(max_docs).agg(F.max("r")).first()[0]
    rows = rows.where(rank <= F.lit(cut)) if cut is not None else rows
    held = rows.select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text"))
    words = held.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    langs = sorted(r[0] for r in held.select("lang").distinct().collect())
    by = lambda frame, key, most: [  # noqa: E731  at most `most` rows of a language reach the driver
        (r[0], r[1])
        for r in frame.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key)))
        .groupBy(key)
        .agg(F.min("rank").alias("rank"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
        .where(F.col("rank") <= most)
        .select(key, "m")
        .collect()
    ]
    padded = F.concat(F.lit("^"), "w", F.lit("$"))
    size = F.length("w") + 2

    def cut(letters: Column) -> Column:
        """All n-grams of a word from its letters, each from its own place: linear in the word."""

        def of(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""))
            return F.when(size >= n, every).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[of(n) for n in range(1, max_gram + 1)]))

    cuts = let(F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0)), cut)
    grams = counts.select("lang", "n", F.explode(cuts).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))

    def logs(found: list[tuple[str, dict]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        table = np.array([[m.get(x, 0) for x in langs] for _, m in found], float).reshape(len(found), len(langs))
        total = table.sum(axis=0) + smooth * (len(found) + 1)
        return dict(zip((w for w, _ in found), np.log((table + smooth) / total), strict=True)), np.log(smooth / total)

    known, _ = logs(by(counts, "w", max_words))
    pieces, floor = logs(by(grams, "g", max_grams))
    docs = dict(held.groupBy("lang").count().collect())
    prior = np.log(np.array([docs[x] for x in langs], float) / sum(docs.values())) if langs else np.zeros(0)
    return Model(langs, prior, known, pieces, floor, max_gram)


def score_texts(texts: list[str | None], model: Model, rows: _Rows) -> tuple[list[str], list[float]]:
    found, sizes, lettered = [], [], []
    for text in texts:
        own = LETTERS.findall(text.lower()) if text else []
        found += own
        sizes.append(len(own))
        lettered.append(any(map(str.isalpha, own)) or any(c.isalpha() for w in own for c in w))
    if len(rows) > _Rows.LIMIT or rows.held > _Rows.CHARS:
        rows.clear()
        rows.held = 0
    at = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
    sums = np.zeros((len(texts), len(model.langs)))
    sizes = np.array(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        sums[full] = np.add.reduceat(rows.matrix[at], starts, axis=0)
    if not model.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    sums += model.prior
    best = sums.argmax(axis=1)
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    score = 1 / odds.sum(axis=1)
    langs = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
    return langs, [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]


_WORKER: dict[str, _Rows] = {}


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row per input row, no shuffle."""
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    sent, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _WORKER:
            _WORKER.clear()
            _WORKER[token] = _Rows(sent.value)
        rows = _WORKER[token]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                langs, scores = score_texts(batch.column(1).to_pylist(), rows.model, rows)
                out = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score"])

    return thin.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; trained on the rows that are not held out.

    A null text or one without a letter is ``und`` with score 0, and so is every row
    if no training row has a language. Ties go to the language first by name; repeated
    rows are predicted alike. An empty input gives no rows; other columns are not read.
    """
    out = held_out(id_col, 4, 2)
    model = train(df.where(~out), id_col, text_col, lang_col, **options)
    return predict(df, model, id_col, text_col).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score"
    )

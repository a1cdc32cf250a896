"""Source divergence audit: how far each source's terms lie from the other sources of its language.

Terms get integer ids: kept terms are sorted by range into chunks of neighbouring terms, a
chunk's sorted array is searched for the id of each count, and counts fall into one dense
vector a source by bincount. Ids keep the UTF-8 order of the terms, so the first of equal
values is the least term.

One pass over the texts counts occurrences and documents of each (language, source, term),
combined inside each task before the first exchange; all that follows works on counts. A
chunk holds all sources of its language as dense vectors of ``chunk`` terms, whose sums over chunks give
the pairs; of each source's terms only the ten best of a chunk go on to the ranking.

All arithmetic is on integers: shares are long divisions in steps of a thousand, exact while
a language's terms occur fewer than 9 * 10^15 times.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Bytes that end a term become spaces, A-Z become a-z; bytes of other letters stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
SCALE_STEPS = 3  # thousand to the third: shares of 10^9
TOP = 10


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def share(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)) for each count."""
    whole = np.int64(total + 2 * kept)
    out, rest = np.divmod(counts.astype(np.int64) + 2, whole)
    for _ in range(SCALE_STEPS):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Tally:
    """Counts by (language, source) of one task, given up in sorted order when they hold too much."""

    LIMIT, CHARS = 400_000, 16_000_000

    def __init__(self):
        self.of: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, found: list[bytes]) -> None:
        times, docs = self.of.setdefault((lang, source), (Counter(), Counter()))
        times.update(found)
        docs.update(set(found))

    def full(self) -> bool:
        held = sum(len(t) for t, _ in self.of.values())
        return held > self.LIMIT or held > self.LIMIT // 8 and sum(sum(map(len, t)) for t, _ in self.of.values()) > self.CHARS

    def given(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in self.of.items():
            times.pop(b"", None)
            keys = list(times)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([times[k] for k in part], pa.int64()), pa.array([docs[k] for k in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        self.of.clear()


def counts(df: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts, to be added up. df: lang, source, text, none null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for whole in batches:
            for batch in slices(whole, 2):
                for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    tally.add(lang, source, terms(text))
                if tally.full():
                    yield from tally.given()
        yield from tally.given()

    return df.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


CELL = "lang string, source string, part string, item string, value bigint"


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial results of one chunk of a language: all pairs of its sources, and each source's best terms.

    Rows without a term name the language's sources with their totals, the others are counts.
    """
    lang, about = pdf["lang"].iloc[0], pdf["term"].isna()
    groups = pdf[about].sort_values("source")
    sources, totals, kept = groups["source"].to_numpy(object), groups["total"].tolist(), int(groups["kept"].iloc[0])
    own = pdf[~about]
    coded = own["term"].str.encode("utf-8").to_numpy(object)
    words = np.array(sorted(set(coded)), object)  # bytes, in UTF-8 order
    place = {s: i for i, s in enumerate(sources)}
    ids = np.searchsorted(words, coded)
    row = own["source"].map(place).to_numpy(np.int64)
    size = len(words)
    dense = np.bincount(row * size + ids, weights=own["n"].to_numpy(np.float64), minlength=len(sources) * size)
    dense = dense.astype(np.int64).reshape(len(sources), size)  # sums below 2^53 are exact
    p = np.stack([share(dense[g], totals[g], kept) for g in range(len(sources))])
    q = share(dense.sum(axis=0), sum(totals), kept)

    out: list[tuple] = []
    for g, source in enumerate(sources):
        over = np.flatnonzero((dense[g] > 0) & (p[g] > q))
        value = divergence(p[g][over], q[over])
        best = np.lexsort((over, -value))[:TOP]
        out += [(lang, source, "term", words[over[k]].decode("utf-8"), int(value[k])) for k in best]
        for h in range(g + 1, len(sources)):
            both = int(divergence(p[g], p[h]).sum())
            out += [(lang, source, "pair", sources[h], both), (lang, sources[h], "pair", source, both)]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, cells: int = 4_000_000
) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Part ``pair``: every other source of the language and how far its term shares lie from this
    one's, over all terms that at least ``least_docs`` documents of the language have. Part
    ``term``: the ten terms by which the source exceeds its language most. A language without such terms has
    pairs of value 0 and no terms. Null text, language and source are empty text; repeated rows count each; ties go to
    the item first in UTF-8. An empty input gives no rows; other columns are not read.

    ``cells`` bounds the dense vectors of one task: sources of the language times terms of a chunk.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    thin = df.select(of(lang_col).alias("lang"), of(source_col).alias("source"), of(text_col).alias("text"))
    groups = materialize(thin.select("lang", "source").distinct(), "groups")
    # one exchange by term serves both sums: what a task sends for a term are its sources, combined
    partial = counts(thin).repartition("lang", "term")
    by_source = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    kept = materialize(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "of"), "kept-terms")

    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = max(16, min(65_536, cells // most))
    chunked = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunked = chunked.withColumn("at", F.monotonically_increasing_id())
    # neighbouring terms of one partition; the lowest 33 bits of the number are the place in it
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.shiftright("at", 33) * F.lit(1 << 33) + F.floor(place / size)
    coded = materialize(chunked.select("lang", "term", chunk.alias("chunk"), "of"), "coded")

    held = coded.select("lang", "chunk", "term", F.explode("of").alias("c")).select("lang", "chunk", "term", "c.source", "c.n")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = coded.groupBy("lang").agg(F.count("*").alias("kept"))
    about = groups.join(totals, ["lang", "source"], "left").join(number, "lang")
    about = materialize(about.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept"), "totals")
    chunks = coded.select("lang", "chunk").distinct()
    named = chunks.join(about, "lang").select("lang", "chunk", F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("bigint").alias("n"), "total", "kept")
    none = F.lit(None).cast("bigint")
    rows = held.select("*", none.alias("total"), none.alias("kept")).unionByName(named)
    partials = materialize(rows.groupBy("lang", "chunk").applyInPandas(_cell, CELL), "partials")

    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").where("source <> item")  # the rows asked for: every other source of the language
    summed = partials.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    found = pairs.unionByName(partials.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.select("*", rank.alias("rank")).where((F.col("part") == "pair") | (F.col("rank") <= TOP))

"""Quality rules on word statistics, and a hashed n-gram likelihood ratio. SQL functions only.

The rule part measures each whole text: words, symbols, repeated lines, words inside
repeated 8-word windows. The verdict of texts that pass the rules is a likelihood
ratio: word and word-pair hashes fall into ``buckets`` places each; a multinomial over
them is counted on all documents (raw) and on trusted ones (target), which is mixed with a
share ``mix`` of raw, so that nothing depends on the size of the corpus. A text's score is the mean over its n-grams of
log(target / raw). An n-gram that the target never has scores log(mix); a text is kept if
its score is at least ``strange`` * log(mix), that of a text which is as likely in the
target as in the corpus but for a share ``strange`` of n-grams that the target never has.

Scale: two narrow passes over the texts and one aggregation to 2 * buckets rows, with
map-side combine; the table of log ratios is a bounded array that a scalar subquery
hands to each row. Every trusted document is counted: texts meet the trusted ids in one
equi-join on the id, a sort-merge join at every size, which AQE splits. No n-gram leaves its task uncounted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(codes: Column, size: int) -> Column:
    """Hash of every run of ``size`` word codes."""
    last = F.size(codes) - size
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(codes, i + 1, F.lit(size))))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column, size: int) -> Column:
    """Words inside windows that occur twice or more: sort, mark equal neighbours, add up the gaps."""

    def by_place(sorted_: Column) -> Column:
        here = lambda j: F.get(sorted_, j)["h"]
        again = F.filter(
            sorted_,
            lambda e, j: F.coalesce(e["h"] == here(j - 1), F.lit(False)) | F.coalesce(e["h"] == here(j + 1), F.lit(False)),
        )
        return let(F.array_sort(F.transform(again, lambda e: e["i"])), gaps)

    def gaps(at: Column) -> Column:
        step = F.transform(at, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - x, F.lit(size))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(F.array_sort(keyed), by_place)
    )


def _grams(codes: Column, buckets: int) -> Column:
    """Places of a text's words (0 to buckets - 1) and adjacent pairs (buckets to 2 * buckets - 1)."""
    single = F.transform(codes, lambda c: F.pmod(c, F.lit(buckets)).cast("int"))
    pair = F.transform(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda c, i: (F.pmod(F.shiftright(c, 1).bitwiseXOR(F.get(codes, i + 1)), F.lit(buckets)) + buckets).cast("int"),
    )
    return F.concat(single, pair)


def _codes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def log_ratios(texts: DataFrame, trusted: Column, buckets: int, mix: float) -> DataFrame:
    """One row: the array of 2 * buckets log ratios. texts has the column text and what trusted reads."""
    grams = texts.select(
        trusted.alias("t"), F.explode(let(_codes(words(F.coalesce("text", F.lit("")))), lambda c: _grams(c, buckets))).alias("g")
    )
    counts = grams.groupBy("g").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))
    every = texts.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("g"))
    counts = every.join(counts, "g", "left").fillna(0)
    kind = F.col("g") >= buckets
    sums = counts.groupBy(kind.alias("kind")).agg(F.sum("raw").alias("raw_n"), F.sum("target").alias("target_n"))
    times = (F.col("target") / F.col("target_n")) / (F.col("raw") / F.col("raw_n"))
    none = (F.col("target_n") == 0) | (F.col("raw") == 0)
    ratio = F.when(none, 0.0).otherwise(F.log((1 - mix) * times + mix))
    scored = counts.join(sums, kind == F.col("kind")).select("g", ratio.alias("r"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"])  # 2 * buckets numbers
    return materialize(scored.agg(table.alias("ratios")), "log-ratios")


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 8192,
    mix: float = 0.05,
    strange: float = 0.02,
) -> DataFrame:
    """Rule columns and the verdict, one row per input row.

    trusted_ids has one column of ids; all documents that they name make the target, the
    raw counts cover all documents. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. A null or empty text
    has no word and fails the rules; without trusted ids every ratio is 0. Repeated rows
    are judged alike and counted each. An empty input gives no rows; other columns are
    not read.
    """
    name = trusted_ids.columns[0]
    trusted = trusted_ids.select(F.col(name).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    flagged = thin.join(trusted.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    ratios = log_ratios(flagged, F.col("_trusted").isNotNull(), buckets, mix)

    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = thin.withColumn("_ratios", ratios.scalar())

    def measured(w: Column) -> Column:
        def coded(codes: Column) -> Column:
            grams = _grams(codes, buckets)
            return F.struct(
                let(_windows(codes, WINDOW), lambda h: _covered(h, WINDOW)).alias("n_repeat_words"),
                F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(F.col("_ratios"), g)).alias("sum"),
            )

        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            let(_codes(w), coded).alias("m"),
        )

    rows = rows.select(
        "doc_id",
        let(words(text), measured).alias("s"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    n = F.col("s.n_words")
    repeat = F.col("s.m.n_repeat_words").cast("bigint")
    llr = F.coalesce(F.col("s.m.sum") / F.nullif(F.greatest(2 * n - 1, F.lit(0)), F.lit(0)), F.lit(0.0))
    failed = (n < 20) | (100 * repeat > 30 * n)
    return rows.select(
        "doc_id", n.alias("n_words"), F.col("s.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeat.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (llr >= F.lit(strange * math.log(mix)))).alias("kept"),
        llr.alias("llr"),
    )

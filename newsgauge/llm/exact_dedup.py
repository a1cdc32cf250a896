"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Equal blocks get one
integer name, different blocks different ones: the distinct blocks are dealt into
name buckets, sorted inside each bucket, and named by bucket and rank. Names of
adjacent blocks are then paired and the distinct pairs named in the same way, level
by level, until one name is left for each document. Names come from comparing
contents, never from a digest, so two documents share a name only if their texts
are equal.

Scale: copies are first collapsed inside each input task, so a text that makes up a
third of the corpus reaches the sort as one row per task. Text is shuffled twice (once
to collapse, once to sort); everything after that is a few integers per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of_each, materialize, row_key

#: Name buckets: each is sorted on its own, many to a task.
NAME_BUCKETS = 65_536
#: Ranks inside a bucket stay below this.
BUCKET_SPAN = 1 << 40


def _name(key: list[str], buckets: int) -> Column:
    """Integer name of the row's key: its bucket and its rank among the bucket's sorted keys.

    The bucket only decides where keys are compared; equal names need equal keys.
    """
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*key))
    return F.col("bucket") * F.lit(BUCKET_SPAN) + rank


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))


def block_names(df: DataFrame, id_col: str, text_col: str, block_chars: int, buckets: int) -> DataFrame:
    """One row per block: rid, doc_id, sha, n_blocks, pos, name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(block_chars))).cast("int")
    rows = rows.select("rid", "doc_id", F.sha2("text", 256).alias("sha"), n_blocks.alias("n_blocks"), "text")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring(F.col("text"), i * F.lit(block_chars) + 1, F.lit(block_chars)),
    )
    blocks = rows.select("rid", "doc_id", "sha", "n_blocks", F.posexplode(cut).alias("pos", "block"))
    # copies inside one input task become one row; its first occurrence stands for them
    local = blocks.groupBy("block", F.spark_partition_id().alias("task")).agg(
        F.collect_list(F.struct("rid", "pos", "doc_id", "sha", "n_blocks")).alias("occ"),
        F.min(F.struct("rid", "pos")).alias("lid"),
    )
    rows = local.select("block", F.col("lid.rid").alias("lid"), F.col("lid.pos").alias("lpos"), F.inline("occ"))
    stands = (F.col("rid") == F.col("lid")) & (F.col("pos") == F.col("lpos"))
    rows = rows.withColumn("block", F.when(stands, F.col("block")))
    # the other occurrences go on without text, spread over buckets of their own, and take the name afterwards
    apart = -1 - F.pmod(F.col("rid"), F.lit(buckets))
    rows = _bucketed(rows, ["block"], buckets).withColumn("bucket", F.when(stands, F.col("bucket")).otherwise(apart))
    name = F.when(stands, _name(["block"], buckets))
    named = materialize(rows.withColumn("name", name).drop("block", "bucket"), "block-names")
    first = named.where(stands)
    others = named.where(~stands).drop("name").join(first.select("lid", "lpos", "name"), ["lid", "lpos"])
    return first.unionByName(others).drop("lid", "lpos")


def document_names(blocks: DataFrame, buckets: int) -> DataFrame:
    """Pair names level by level: rid, doc_id, sha, n_blocks, name, one row per document."""
    ident = ["rid", "doc_id", "sha", "n_blocks"]
    single = blocks.where("n_blocks = 1").select(*ident, "name")
    left = blocks.where("n_blocks > 1")
    width = blocks.agg(F.max("n_blocks")).first()[0] or 1
    while width > 1:
        pairs = left.groupBy(*ident, F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = pairs.withColumnRenamed("half", "pos")
        distinct = _bucketed(pairs.select("a", "b").distinct(), ["a", "b"], buckets)
        distinct = distinct.select("a", "b", _name(["a", "b"], buckets).alias("name"))
        left = materialize(pairs.join(distinct, ["a", "b"]).drop("a", "b"), "pair-names")
        width = (width + 1) // 2
    return single.unionByName(left.select(*ident, "name"))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 32_768, buckets: int = NAME_BUCKETS
) -> DataFrame:
    """Duplicate groups of equal texts, one row per input row.

    Returns doc_id, keep_id (largest id of the group), group_size, kept, text_sha256.
    A null text is the empty text. Of rows that tie on the id as well, one is kept; a
    null id is below every other. An empty input gives no rows; other columns of df
    are not read. block_chars sets the unit that is sorted: documents of up to that
    many characters are named in one step, longer ones in log2(blocks) more.
    df should be a scan or a written table: row numbers are taken from it.
    """
    blocks = block_names(df, id_col, text_col, block_chars, buckets)
    names = document_names(blocks, buckets)
    groups = names.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
    )
    # written first: a join right on an aggregation could not split a group that holds a third of the rows
    out = names.join(materialize(groups, "groups"), ["n_blocks", "name"])
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns; the texts are shuffled once more.

    Of rows equal in id and text one is kept, whatever their other columns hold.
    """
    kept = exact_dedup(df, id_col, text_col, **options).where("kept")
    kept = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    sha = F.sha2(F.coalesce(df[text_col], F.lit("")), 256)
    return first_of_each(df, row_key(df[id_col], sha), kept)

"""What the operators share: tables written to the cluster's shared folder, and table reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' word: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="newsgauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, and fixes the rows: whatever was evaluated to make them
    (partition numbers, generated ids) is not evaluated again. The files live as
    long as the cluster keeps its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsgauge-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: Column) -> Column:
    """One non-null string for the columns' values, so that joins and windows share a partitioning."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])


def first_of_each(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """One row of df for each of keys' distinct values (column key), all columns of df kept.

    Rows travel as one struct, so that no column of df can clash with those made here.
    Repeats are aggregated where they lie before they meet, so none fills a task.
    """
    rows = df.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    once = rows.groupBy("key").agg(F.first("row").alias("row"))
    return once.join(keys.select("key").distinct(), "key", "left_semi").select("row.*")


def words(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def slices(batch: pa.RecordBatch, text: int, rows: int = 500, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``rows`` rows and some ``size`` bytes of whole texts, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop

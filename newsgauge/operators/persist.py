"""Idempotent writes: DataFrames of what a table holds after an upsert, and a table that is swapped whole.

Parquet has no transactional merge, so an upsert is a join of the old table with the
incoming rows, written to a new folder that a one-line pointer file then names. The
writer is alone; readers see one version or the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, for batches that hold a key twice."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table afterwards, rows that were new). The first write of a key wins."""
    new = first_of(incoming, key, order).join(table.select(*key), key, "left_anti")
    return table.unionByName(new.select(*table.columns)), new


def upsert(table: DataFrame, incoming: DataFrame, key: list[str], keep: tuple[str, ...] = (), parity: tuple[str, ...] = ()) -> DataFrame:
    """table after incoming rows (one a key) overwrote theirs; columns in keep hold their first value.

    Columns in parity keep the old value while the incoming one is null: a pending row
    does not erase a label. Leave parity empty to overwrite them with null.
    """
    old, new = table.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    joined = old.join(new.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")

    def value(c: str):
        if c in key or c in keep:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        if c in parity:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def new_pairs(before: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keys that the table did not hold: newness is decided by the write, not by a clock."""
    return incoming.select(*key).distinct().join(before.select(*key), key, "left_anti")


def pending_alerts(alerts: DataFrame, sent: DataFrame, channels: list[str]) -> DataFrame:
    """Each alert with each channel that has not recorded it. channels is the configured list, repeated by explode."""
    every = alerts.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return every.join(sent.select("mention_id", "channel"), ["mention_id", "channel"], "left_anti")


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def swap_file(spark: SparkSession, root: str, name: str, text: str) -> None:
    """Write a small file below root in one step: readers see the old text until the rename and this one from then on."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fresh, path = hadoop_path(spark, f"{root}/NEXT-{uuid.uuid4().hex}"), hadoop_path(spark, f"{root}/{name}")
    fs = path.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(text.encode())
    out.close()
    kinds = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(path), how)


class Table:
    """A Parquet table of versions below one folder; the pointer names the current one."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, name: str):
        return hadoop_path(self.spark, f"{self.root}/{name}")

    def current(self) -> str | None:
        """The version that the pointer names; none only for a table that was never written."""
        path = self._path("CURRENT")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            return self.spark.read.text(f"{self.root}/CURRENT").first()[0]
        if fs.exists(self._path("NAMED")):
            raise RuntimeError(f"{self.root} has versions but no pointer to one")
        return None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{version}")

    def replace(self, rows: DataFrame) -> DataFrame:
        """Write rows as the next version, then move the pointer to it in one step.

        Readers see the last version until the rename and this one from then on.
        """
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        swap_file(self.spark, self.root, "CURRENT", version)
        fs = self._path("NAMED").getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.create(self._path("NAMED"), True).close()
        return self.read()


def set_state(table: Table, values: dict[str, str | None]) -> DataFrame:
    """A table of key and value after these were set; None removes a key."""
    keys = table.spark.createDataFrame(list(values.items()), "key string, value string")
    kept = table.read().join(keys, "key", "left_anti").select("key", "value")
    return table.replace(kept.unionByName(keys.where("value IS NOT NULL")))

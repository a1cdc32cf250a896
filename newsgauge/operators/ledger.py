"""Several keyed tables below one folder, of which a write touches what changed, named by one manifest.

Rows lie in buckets by a hash of their key. An insert adds files to the buckets of its new
rows and reads only the keys of these buckets; an upsert writes the buckets of its rows anew; files of
other buckets keep their names. Nothing is visible until the manifest, one small file that
names the files of every bucket of every table, is replaced in one step: a batch that writes
three tables changes all or none. The manifest also holds marks, such as the number of the last batch, so
that a batch that comes again after a failure can be told. There is one writer; readers see one manifest or the next.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import stored
from .persist import first_of, hadoop_path, swap_file, upsert


@dataclass(frozen=True)
class Keyed:
    """A table's columns, its key, and into how many buckets its rows are dealt."""

    schema: str
    key: tuple[str, ...]
    buckets: int = 64


class Ledger:
    """Tables by name below one folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Keyed]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def manifest(self) -> dict:
        """{"tables": {name: {bucket: [folder, ...]}}, "marks": {...}} as last published."""
        path = hadoop_path(self.spark, f"{self.root}/MANIFEST")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {"tables": {}, "marks": {}}
        return json.loads(self.spark.read.text(f"{self.root}/MANIFEST", wholetext=True).first()[0])

    def mark(self, name: str):
        return self.manifest()["marks"].get(name)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as last published, or only some buckets of it."""
        return self._read(name, self.manifest()["tables"].get(name, {}), buckets)

    def _read(self, name: str, held: dict[str, list[str]], buckets: list[int] | None = None) -> DataFrame:
        wanted = held.keys() if buckets is None else [str(b) for b in buckets if str(b) in held]
        paths = [f"{self.root}/{name}/{folder}" for b in wanted for folder in held[b]]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Commit:
        return Commit(self)

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self, name)

    def vacuum(self) -> int:
        """Remove the files that the manifest does not name; returns the number of folders removed. No reader may still hold an older one."""
        named = {f"{t}/{f}" for t, held in self.manifest()["tables"].items() for folders in held.values() for f in folders}
        removed = 0
        for name in self.tables:
            top = hadoop_path(self.spark, f"{self.root}/{name}")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for commit in fs.listStatus(top) if fs.exists(top) else []:
                for part in fs.listStatus(commit.getPath()):
                    folder = f"{name}/{commit.getPath().getName()}/{part.getPath().getName()}"
                    if part.isDirectory() and folder not in named:
                        fs.delete(part.getPath(), True)
                        removed += 1
        return removed


class Commit:
    """Writes to several tables that become visible together."""

    def __init__(self, ledger: Ledger):
        self.ledger = ledger
        was = ledger.manifest()
        self.tables, self.marks = {n: {b: list(f) for b, f in held.items()} for n, held in was["tables"].items()}, dict(was["marks"])

    def _dealt(self, name: str, rows: DataFrame) -> tuple[DataFrame, list[int]]:
        """rows with the table's columns and their bucket, written once, and the buckets they touch."""
        of = self.ledger.tables[name]
        empty = self.ledger.spark.createDataFrame([], of.schema)
        fitted = rows.select(*[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema
        ])
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in of.key]), F.lit(of.buckets)).cast("int")
        dealt = stored(fitted.withColumn("bucket_", bucket), name)
        return dealt, [r[0] for r in dealt.select("bucket_").distinct().collect()]  # at most the table's buckets

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """One file for each bucket of rows; bucket -> folder."""
        commit = f"c-{uuid.uuid4().hex}"
        rows.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.ledger.root}/{name}/{commit}")
        top = hadoop_path(self.ledger.spark, f"{self.ledger.root}/{name}/{commit}")
        fs = top.getFileSystem(self.ledger.spark._jsc.hadoopConfiguration())
        folders = [p.getPath().getName() for p in fs.listStatus(top) if p.isDirectory() and "=" in p.getPath().getName()]
        return {f.partition("=")[2]: f"{commit}/{f}" for f in folders}

    def insert(self, name: str, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Add the rows whose key the table does not hold; returns them. Of rows with one key the first by order counts."""
        of = self.ledger.tables[name]
        dealt, touched = self._dealt(name, rows)
        held = self.tables.setdefault(name, {})
        before = self.ledger._read(name, held, touched).select(*of.key)
        new = first_of(dealt, list(of.key), order or of.key[0]).join(before, list(of.key), "left_anti")
        written = self._write(name, new.select(*dealt.columns))
        for bucket, folder in written.items():
            held.setdefault(bucket, []).append(folder)
        return self.ledger._read(name, {b: [f] for b, f in written.items()})

    def upsert(self, name: str, rows: DataFrame, keep: tuple[str, ...] = (), parity: tuple[str, ...] = ()) -> None:
        """Overwrite the rows of the same key (one a key comes in) and add the others; see persist.upsert for keep and parity."""
        of = self.ledger.tables[name]
        dealt, touched = self._dealt(name, rows)
        held = self.tables.setdefault(name, {})
        after = upsert(self.ledger._read(name, held, touched), dealt.drop("bucket_"), list(of.key), keep, parity)
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in of.key]), F.lit(of.buckets)).cast("int")
        for b, folder in self._write(name, after.withColumn("bucket_", bucket)).items():
            held[b] = [folder]

    def compact(self, name: str, most: int = 8) -> None:
        """Write the buckets that more than ``most`` inserts left files in as one file each."""
        held = self.tables.get(name, {})
        many = [b for b, folders in held.items() if len(folders) > most]
        if many:
            of = self.ledger.tables[name]
            bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in of.key]), F.lit(of.buckets)).cast("int")
            rows = self.ledger._read(name, {b: held[b] for b in many}).withColumn("bucket_", bucket)
            for b, folder in self._write(name, rows).items():
                held[b] = [folder]

    def publish(self, **marks) -> None:
        """Make all writes visible in one step, with marks set."""
        self.marks |= marks
        swap_file(self.ledger.spark, self.ledger.root, "MANIFEST", json.dumps({"tables": self.tables, "marks": self.marks}))


class KeyedTable:
    """One table of a ledger, each write a commit of its own."""

    def __init__(self, ledger: Ledger, name: str):
        self.ledger, self.name = ledger, name

    def read(self) -> DataFrame:
        return self.ledger.read(self.name)

    def insert(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        commit = self.ledger.begin()
        new = commit.insert(self.name, rows, order)
        commit.compact(self.name)
        commit.publish()
        return new

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = (), parity: tuple[str, ...] = ()) -> None:
        commit = self.ledger.begin()
        commit.upsert(self.name, rows, keep, parity)
        commit.publish()

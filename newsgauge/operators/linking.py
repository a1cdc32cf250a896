"""Which rows belong together: tables written between steps, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read back: its rows are made once and outlive an executor."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="newsgauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/newsgauge-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _contracted(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (u, v) with the same components: what a task holds, ``most`` at once, as one edge from each node to the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def of(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def given() -> pa.RecordBatch:
            pairs = [(x, r) for x in root if (r := of(x)) != x]
            root.clear()
            columns = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], names=["u", "v"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = of(u), of(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > most:
                yield given()
        if kind is not None:
            yield given()

    return edges.mapInArrow(run, edges.schema)


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge at most that leads on, and none leads to a node with such an edge."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("on")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("on")))
    seen = ends.groupBy("x").agg(F.sum("on").alias("on"), F.min("on").alias("least"))
    return seen.where((F.col("on") > 1) | ((F.col("on") > 0) & (F.col("least") == 0))).isEmpty()


def groups(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): the least node reachable from each node that has an edge.

    Each task first contracts the edges that it holds. Every round then links the greater neighbours of a node to the
    least one around it, and the smaller ones; chains halve, so the rounds grow with the logarithm of their length.
    """
    edges = stored(_contracted(edges.select("u", "v").where("u <> v")), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(_contracted(small.unionByName(down.select("u", F.col("m").alias("v")))), "stars")
    return edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("root")).distinct()

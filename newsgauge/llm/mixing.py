"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, once through for
each repeat it may give. A document's virtual finish time is the number of words its
source has sent by its end, over the source's weight. All queues are merged in order
of finish time and the merged sequence is truncated at the total budget. A source
that has sent all its repeats stops, and the others go on in proportion to their
weights; so each source ends near the share that resharing the excess gives it.

Scale: words are counted once and only (id, source, size, shuffle key) go on. Running
totals of a source are taken in two steps, over the sums of hash buckets and inside a
bucket. The merged order is cut into ranges of finish time; only the range in which the
budget ends is cut again, until what is left of it is small enough to be sorted at once.
So no window holds a source or the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_key

#: Bins of virtual time, and the rows of the bin at the budget that are put in order at once.
TIME_BINS, EDGE_ROWS = 4096, 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget_ratio: float, max_repeats: int) -> DataFrame:
    """source, src_no, source_size, weight, target, one row per source.

    Sources sorted by how early they fill up: those before the water level give all
    their repeats, the others their weight times the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("src_no", F.row_number().over(order))
    turn = (F.col("src_no") - 1) % len(weights) + 1
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn))
    cap = F.col("source_size") * F.lit(max_repeats)
    totals = totals.withColumn("cap", cap)
    early = Window.orderBy(F.col("cap") / F.col("weight"), "src_no")
    before, everything = early.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget_ratio))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    totals = totals.withColumn("level", level)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    water = F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), F.col("src_no"), F.col("level")))).over(everything)
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * water["level"])
    return totals.select("source", "src_no", "source_size", "weight", "budget", target.alias("target"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies; one row per input row.

    size counts words (null text: 0); source_size and target are the source's; copies
    is how often the mix takes the document and taken = copies * size. Sources go by
    code point, null (a source of its own) last, and get the weights in turn. The
    order inside a source is that of md5 of the id, then id, then size; rows equal in
    all of these are interchangeable. Null ids count as the empty string. An empty
    input gives no rows; other columns are not read.
    """
    sizes = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k"),
    )
    sizes = materialize(sizes, "sizes")
    targets = source_targets(sizes, weights, budget_ratio, max_repeats)

    # running words inside each source: totals of hash buckets, then inside the bucket
    bucket = F.substring("k", 1, 3)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    t, s = targets.alias("t"), sums.alias("s")
    offsets = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.source", "s.bucket", "s.before", "src_no", "source_size", "weight", "budget", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    d = sizes.withColumn("bucket", bucket).withColumn("cum", F.sum("size").over(inside)).alias("d")
    o = offsets.alias("o")
    same = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket"))
    queued = d.join(o, same).select(
        "doc_id", "d.source", "size", "k", "src_no", "source_size", "weight", "budget", "target",
        (F.col("cum") + F.col("before")).alias("cum"),
    )
    queued = materialize(queued, "queued")

    def finish(epoch: Column) -> Column:
        return (F.col("cum") + epoch * F.col("source_size")) / F.col("weight")

    def place(epoch: Column) -> Column:
        return F.struct(
            finish(epoch).alias("finish"), "src_no", epoch.alias("epoch"), "k", "doc_id", "size"
        )

    epochs = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    items = queued.select("size", F.explode(F.transform(epochs, place)).alias("at"))
    low, high, budget = queued.agg(F.lit(0.0), F.max(finish(F.lit(max_repeats - 1))), F.first("budget")).first()
    items = items.where("size > 0")  # others do not move the total
    before, crossed = 0, None
    while high is not None:
        place_in = F.floor((F.col("at.finish") - F.lit(low)) / F.lit(high - low or 1.0) * F.lit(TIME_BINS))
        items = items.withColumn("bin", F.least(place_in, F.lit(TIME_BINS - 1)))
        bins = items.groupBy("bin").agg(
            F.sum("size").alias("s"), F.count("*").alias("n"), F.min("at.finish").alias("low"), F.max("at.finish").alias("high")
        )
        up_to = F.sum("s").over(Window.orderBy("bin")) + F.lit(before)  # at most TIME_BINS rows
        crossed = bins.withColumn("total", up_to).where(F.col("total") > F.lit(budget)).orderBy("bin").first()
        if crossed is None:
            break
        items, before = items.where(F.col("bin") == crossed["bin"]), crossed["total"] - crossed["s"]
        low, high = crossed["low"], crossed["high"]
        if crossed["n"] <= EDGE_ROWS or low == high:  # equal times are at most one of each source and epoch
            break
    if crossed is None:
        copies = F.lit(max_repeats)
    else:
        running = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        total = running + F.lit(before)
        cut = items.withColumn("total", total).where(F.col("total") > F.lit(budget)).agg(F.min("at").alias("at"))
        at = cut.first()["at"]
        limit = F.struct(
            F.lit(at["finish"]).alias("finish"), F.lit(at["src_no"]).alias("src_no"), F.lit(at["epoch"]).alias("epoch"),
            F.lit(at["k"]).alias("k"), F.lit(at["doc_id"]).cast(sizes.schema["doc_id"].dataType).alias("doc_id"),
            F.lit(at["size"]).cast("bigint").alias("size"),
        )
        copies = sum(
            (F.when(place(F.lit(e)) < limit, F.lit(1)).otherwise(F.lit(0)) for e in range(max_repeats)), F.lit(0)
        )
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def apply_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of df as often as the mix takes them, with their columns. Ids name documents."""
    mixed = mix_sources(df, id_col=id_col, source_col=source_col, **options)
    copies = mixed.groupBy(row_key(F.col("doc_id")).alias("key")).agg(F.max("copies").alias("copies"))
    rows = df.select(row_key(df[id_col]).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    held = rows.join(copies.where("copies > 0"), "key")
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

"""Raw items to articles: what can be stored, and which items report the same article."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.text import article_id, content_key, text_or_empty
from newsgauge.functions.urls import canonical_url, host, opaque_host, publisher_of_host

from .linking import groups, stored


def normalize_items(raw: DataFrame) -> DataFrame:
    """Raw items with skip_reason, and where it is null the stored form: id, canonical_url, publisher, content_key.

    Reasons in order: no-title, no-date, invalid-url. Needs url, title, source_name and
    published_at; all columns stay.
    """
    made = raw.select("*", canonical_url("url").alias("canonical_url"), host("url").alias("_host"))  # each made once a row
    made = made.withColumn("publisher", publisher_of_host(F.col("_host"), "source_name"))
    reason = (
        F.when(F.trim(text_or_empty("title")) == "", "no-title")
        .when(F.col("published_at").isNull(), "no-date")
        .when(F.col("canonical_url").isNull(), "invalid-url")
    )
    return made.select(
        *[made[c] for c in raw.columns], reason.alias("skip_reason"), "canonical_url", article_id("canonical_url").alias("id"),
        "publisher", content_key(F.trim("title"), "publisher").alias("content_key"), opaque_host(F.col("_host")).alias("opaque"),
    )


def best_of_url(items: DataFrame, by: list[str], order: str = "position") -> DataFrame:
    """One item for each key: a readable link before a redirect, the earlier, the first to arrive."""
    place = F.struct(F.col("opaque"), F.col("published_at"), F.col(order))
    everything = F.struct(*[c for c in items.columns])
    best = items.groupBy(*by).agg(F.min_by(everything, place).alias("_best"), F.count("*").alias("reports"))
    return best.select("_best.*", "reports")


class _Fold:
    """Items in order of arrival: each joins the first slot it matches or opens one.

    A slot's holder may change; the keys of earlier holders still lead to it. Slots of a
    content key are found by the week (or whatever the tolerance is) of their holder, so a row
    looks at three weeks however many slots there are.
    """

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.holders: list[tuple] = []
        self.urls: dict[tuple, int] = {}
        self.named: list[list[tuple]] = []  # of each slot: (content key, number among the slots of that key)
        self.slots: dict[tuple, list[int]] = {}
        self.weeks: dict[tuple, dict[int | None, set[int]]] = {}

    def _week(self, date: int | None) -> int | None:
        return None if date is None else date // self.tolerance

    def _same_content(self, key: tuple, date: int | None) -> int | None:
        slots = self.slots.get(key)
        if not slots or date is None:
            return slots[0] if slots else None
        weeks, week = self.weeks[key], self._week(date)
        near = [
            n
            for w in (None, week - 1, week, week + 1)
            for n in weeks.get(w, ())
            if w is None or abs(self.holders[slots[n]][3] - date) <= self.tolerance
        ]
        return slots[min(near)] if near else None

    def _stays(self, a: tuple, b: tuple) -> bool:
        """Whether the holder a stays before b."""
        if a[2] != b[2]:
            return not a[2]
        return a[3] is None or b[3] is None or a[3] <= b[3]

    def add(self, row: tuple) -> tuple | None:
        """row: url key, content key, opaque, date, name. Returns (name, reason) of the row that this one makes a duplicate."""
        slot, reason, lost = self.urls.get(row[0]), "same-url", None
        if slot is None:
            slot, reason = self._same_content(row[1], row[3]), "same-content"
        if slot is None:
            slot = len(self.holders)
            self.holders.append(row)
            self.named.append([])
        else:
            held = self.holders[slot]
            if self._stays(held, row):
                return row[4], reason
            for key, n in self.named[slot]:
                self.weeks[key][self._week(held[3])].discard(n)
                self.weeks[key].setdefault(self._week(row[3]), set()).add(n)
            self.holders[slot], lost = row, (held[4], reason)
        self.urls[row[0]] = slot
        if all(key != row[1] for key, _ in self.named[slot]):
            n = len(self.slots.setdefault(row[1], []))
            self.slots[row[1]].append(slot)
            self.named[slot].append((row[1], n))
            self.weeks.setdefault(row[1], {}).setdefault(self._week(row[3]), set()).add(n)
        return lost


def _nodes(spans: DataFrame, tolerance: int) -> DataFrame:
    """content, week, node: runs of weeks of a content key without a gap above the tolerance.

    spans: content, week, low, high. Counted by (content key, week) first, so that a key of very many items is a few rows.
    A key with an item without a date is one run, since such an item is near to any.
    """
    cells = spans.groupBy("content", "week").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("content").orderBy("week")
    undated = F.max(F.col("low").isNull()).over(Window.partitionBy("content"))
    gap = (F.col("low") - F.lag("high").over(order) > tolerance).cast("int")
    cut = cells.withColumn("gap", F.when(undated, 0).otherwise(F.coalesce(gap, F.lit(0))))
    return cut.select("content", "week", F.xxhash64("content", F.sum("gap").over(order)).alias("node"))


def _by_cell(rows: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """rows with a column of their cell; cells: one row a content key and week."""
    cells = cells.select(F.col("content").alias("_c"), F.col("week").alias("_w"), name)
    return rows.join(cells, (F.col("content") == F.col("_c")) & F.col("week").eqNullSafe(F.col("_w"))).drop("_c", "_w")


def _pieces(rows: DataFrame, spans: DataFrame, tolerance: int) -> DataFrame:
    """content, week, story: whatever can bear on one another in the fold has one story.

    Content keys are cut at gaps in time, and pieces of one key that a URL was reported in are joined again. A key that
    shares a URL with another key stays whole: a holder may take its slot to the other key's dates, near to any of its
    pieces. Only rows whose URL is found under several keys or weeks are looked at for this. Names are hashes: two that
    fall together make one story of two, which the fold keeps apart.
    """
    nodes = stored(_nodes(spans, tolerance), "nodes")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("content", "week") for f in (F.min, F.max)]
    seen = rows.groupBy("url").agg(*ends, F.count("*").alias("n"), F.count("week").alias("weeks"))
    several = "min_content <> max_content OR min_week <> max_week OR (weeks > 0 AND weeks < n)"
    shared = stored(seen.where(several).select("url"), "shared")
    if shared.isEmpty():
        return nodes.withColumnRenamed("node", "story")
    placed = _by_cell(rows.select("url", "content", "week").join(shared, "url", "left_semi"), nodes, "node")
    placed = stored(placed, "placed")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("node", "content") for f in (F.min, F.max)]
    reported = stored(placed.groupBy("url").agg(*ends).where("min_node <> max_node"), "reported")
    near = placed.join(reported.select("url", F.col("min_node").alias("v")), "url").select(F.col("node").alias("u"), "v")
    whole = placed.join(reported.where("min_content <> max_content"), "url", "left_semi").select("content").distinct()
    least = nodes.groupBy("content").agg(F.min("node").alias("v")).join(whole, "content", "left_semi")
    parts = nodes.join(least, "content").select(F.col("node").alias("u"), "v")
    links = stored(near.unionByName(parts).where("u <> v").distinct(), "links")
    if links.isEmpty():
        return nodes.withColumnRenamed("node", "story")
    return nodes.join(groups(links), "node", "left").select("content", "week", F.coalesce("root", "node").alias("story"))


def _stories(rows: DataFrame, tolerance: int) -> DataFrame:
    """rows with their ``story`` (see _pieces)."""
    spans = rows.select("content", "week", F.col("date").alias("low"), F.col("date").alias("high"))
    return _by_cell(rows, _pieces(rows, spans, tolerance), "story")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """What _judged needs of rows, numbers only, so that any number of rows of a key is summed up where it lies."""
    first = [F.min_by(c, "position").alias(f"first_{c}") for c in ("opaque", "date")]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("date").alias("dated"), F.min("date").alias("low"), F.max("date").alias("high"),
        F.min(F.when(~F.col("opaque"), F.col("date"))).alias("open_low"), F.min("position").alias("first"), *first,
    )


def _judged(counted: DataFrame, tolerance: int) -> DataFrame:
    """story, n, scope, first, plain: how many items a story has, the first to arrive, and whether it stays for certain.

    It does where it is alone, or where all items have one content key and dates within the tolerance of one another, and
    none is better than the first: then each joins its slot and none takes it, so only the first one's URL ever leads there.
    """
    of = F.struct("scope", "content_key")
    seen = counted.groupBy("story").agg(
        F.sum("n").alias("n"), F.sum("dated").alias("dated"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("open_low").alias("open_low"), F.min("first").alias("first"), F.min_by("first_opaque", "first").alias("opaque"),
        F.min_by("first_date", "first").alias("date"), F.min(of).alias("least"), F.max(of).alias("most"),
    )
    one = (F.col("least") == F.col("most")) & (F.col("dated") == F.col("n")) & (F.col("high") - F.col("low") <= tolerance)
    redirect = F.col("open_low").isNull() & (F.col("date") <= F.col("low"))
    stays = F.when(F.col("opaque"), redirect).otherwise(F.col("date") <= F.col("open_low"))
    plain = (F.col("n") == 1) | F.coalesce(one & stays, F.lit(False))
    return seen.select("story", "n", F.col("least.scope").alias("scope"), "first", plain.alias("plain"))


def _heads(placed: DataFrame, tolerance: int) -> DataFrame:
    """story, n, scope, first, plain of the stories of several items."""
    return _judged(_counted(placed, "story", "scope", "content_key"), tolerance).where("n > 1")


def _folded(told: DataFrame, tolerance: int, remain: bool) -> DataFrame:
    """scope, position of the items of stories that remain; else of those that do not, with the reason."""
    told = told.select("story", "scope", "position", "id", "content_key", "opaque", "date")
    told = told.repartition("story").sortWithinPartitions("story", "position")
    names = ["scope", "position"] if remain else ["scope", "position", "reason"]
    schema = told.select("scope", "position", F.lit("").alias("reason")).select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        story, fold, types = None, None, None

        def given(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ((),) * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.field(n).type for n in ("scope", "position")] + ([] if remain else [pa.string()])
            out = []
            for at, of, position, ident, key, opaque, date in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if fold is None or at != story:
                    if remain and fold is not None:
                        out.extend(held[4] for held in fold.holders)
                    story, fold = at, _Fold(tolerance)
                found = fold.add(((of, ident), (of, key), opaque, date, (of, position)))
                if found and not remain:
                    out.append((*found[0], found[1]))
            yield given(out)
        if remain and fold is not None:
            yield given([held[4] for held in fold.holders])

    return told.mapInArrow(run, schema)


def _narrow(items: DataFrame, scope: str, key: str, tolerance: int) -> DataFrame:
    """Of items what decides which of them are the same, with hashes of content key and URL, each within its scope."""
    date, of = F.unix_micros(F.col("published_at").cast("timestamp")), F.col(scope)
    return items.select(
        of.alias("scope"), "position", F.col(key).alias("id"), "content_key", "opaque", date.alias("date"),
        F.xxhash64(of.cast("string"), F.lit(1), "content_key").alias("content"), F.xxhash64(of.cast("string"), F.lit(2), key).alias("url"),
        F.floor(date / tolerance).alias("week"),
    )


def _micros(days: int) -> int:
    return max(1, days * 86_400_000_000)


def dedupe_items(items: DataFrame, scope: str, tolerance_days: int = 7) -> DataFrame:
    """items with duplicate_reason: null for those that remain, else same-url or same-content.

    Items of one scope (a company) are the same article if their canonical URLs are, or
    if title and publisher are and their dates are within the tolerance; a missing date
    is within any. Which items remain depends on the order of arrival (``position``,
    unique in a scope). A title is cut into stories where no report comes for longer than the
    tolerance and no shared URL crosses. Stories whose first report stays are settled by an aggregate; the others
    are folded apart, each as a stream of five narrow columns of which only open slots are held. ``items``
    is read twice and must give the same rows.
    """
    tolerance, of = _micros(tolerance_days), F.col(scope)
    rows = stored(_narrow(items, scope, "id", tolerance), "items")
    placed = stored(_stories(rows, tolerance).drop("content", "url", "week"), "placed")
    heads = stored(_heads(placed, tolerance), "heads")
    told = placed.join(heads.where("NOT plain").select("story"), "story", "left_semi")
    plain = heads.where("plain").select("story", "scope", F.col("first").alias("position"))
    named = rows.join(plain, rows["scope"].eqNullSafe(plain["scope"]) & (rows["position"] == plain["position"]))
    named = named.select("story", rows["position"].alias("first"), rows["id"].alias("url"))
    same = F.when(F.col("id").eqNullSafe(F.col("url")), "same-url").otherwise("same-content")
    settled = placed.join(named, "story").where("position <> first").select("scope", "position", same.alias("reason"))
    lost = settled.unionByName(_folded(told, tolerance, False))
    lost = lost.select(F.col("scope").alias("_of"), F.col("position").alias("_at"), F.col("reason").alias("duplicate_reason"))
    return items.join(lost, of.eqNullSafe(F.col("_of")) & (F.col("position") == F.col("_at")), "left").select(*items.columns, "duplicate_reason")


def remaining_items(items: DataFrame, scope: str, key: str = "id", tolerance_days: int = 7) -> DataFrame:
    """The items that remain in dedupe_items, without the reasons of the others.

    What is written is content keys by week and which items remain, never all items nor all duplicates. key: what is
    equal where the article is, ``id`` or what that is made of. ``items`` is read up to five times: let it be a stored table.
    """
    tolerance, of = _micros(tolerance_days), F.col(scope)
    rows = _narrow(items, scope, key, tolerance)
    cells = stored(_counted(rows, "content", "week", "scope", "content_key"), "cells")
    pieces = _pieces(rows, cells, tolerance)
    heads = stored(_judged(_by_cell(cells, pieces, "story"), tolerance), "heads")
    told = _by_cell(rows, pieces.join(heads.where("NOT plain").select("story"), "story", "left_semi"), "story")
    remain = heads.where("plain").select("scope", F.col("first").alias("position")).unionByName(_folded(told, tolerance, True))
    remain = stored(remain.select(F.col("scope").alias("_of"), F.col("position").alias("_at")), "remain")
    return items.join(remain, of.eqNullSafe(F.col("_of")) & (F.col("position") == F.col("_at")), "left_semi")


def outcome(reason: Column, duplicate: Column) -> Column:
    return F.when(reason.isNotNull(), "skipped").when(duplicate.isNotNull(), "duplicate").otherwise("stored")


def recency_cap(items: DataFrame, by: str, date: str, order: str, most: int = 25) -> DataFrame:
    """The newest items of each group, ties in order of arrival."""
    newest = Window.partitionBy(by).orderBy(F.col(date).desc_nulls_last(), F.col(order))
    return items.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= most).drop("_rn")

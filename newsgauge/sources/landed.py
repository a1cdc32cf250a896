"""Landed payloads as a data source: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

A payload is one answer of a provider about a company, a JSON file
``<path>/company=<id>/provider=<name>/<file>.json`` with ``items`` (url, title, snippet, source_name,
published_at, language) or with ``error`` where the call failed; a file of an item a line is one as well. Each (company, provider) is a
partition of the scan. Comparisons of company_id, provider and published_at with constants are pushed into it: folders
outside are not opened, items outside the window are not parsed into rows. A payload that cannot be
read, is no payload or reports an error is one row with ``error`` and no item, so that a failing provider neither
fails the others nor looks like one without coverage; it passes every window.

As a stream the source's offset is the last file name seen of each folder; a file must sort after
those that landed before it (names begin with a time or a sequence number).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual,
)

SCHEMA = (
    "company_id string, provider string, file string, position int, url string, title string, snippet string, source_name string, "
    "published_at timestamp, language string, error string"
)
_ITEM = ("url", "title", "snippet", "source_name")


@dataclass
class Folder(InputPartition):
    """One (company, provider): its folder, and the files after ``after`` up to ``until`` (both by name, None: all)."""

    path: str
    company: str
    provider: str
    after: str | None = None
    until: str | None = None

    def __post_init__(self):
        self.value = (self.company, self.provider)


def _files(path: str):
    """The file system of a path and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def folders(path: str) -> list[Folder]:
    """A folder for each company and provider that has landed."""
    from pyarrow import fs

    system, top = _files(path)
    found = []
    for company in sorted(system.get_file_info(fs.FileSelector(top, allow_not_found=True)), key=lambda f: f.path):
        if company.type != fs.FileType.Directory or not company.base_name.startswith("company="):
            continue
        for provider in sorted(system.get_file_info(fs.FileSelector(company.path)), key=lambda f: f.path):
            if provider.base_name.startswith("provider="):
                where = f"{path.rstrip('/')}/{company.base_name}/{provider.base_name}"
                found.append(Folder(where, company.base_name.partition("=")[2], provider.base_name.partition("=")[2]))
    return found


def _names(folder: Folder) -> list[str]:
    from pyarrow import fs

    system, top = _files(folder.path)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(top)) if f.is_file and f.base_name.endswith(".json"))
    return [n for n in names if (folder.after is None or n > folder.after) and (folder.until is None or n <= folder.until)]


def _instant(value) -> datetime | None:
    """An ISO instant, in UTC without zone; None for anything else."""
    try:
        at = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return at.replace(tzinfo=None) - (at.utcoffset() or at - at) if at.tzinfo else at


class Window:
    """What was pushed: bounds of published_at (value, inclusive) and wanted companies and providers."""

    def __init__(self):
        self.low: list[tuple[datetime, bool]] = []
        self.high: list[tuple[datetime, bool]] = []
        self.only: dict[str, set[str]] = {}

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that this source applies itself; then it does."""
        name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if name == "published_at" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            at = f.value.replace(tzinfo=None) if f.value.tzinfo is None else _instant(f.value.isoformat())
            (self.low if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else self.high).append((at, isinstance(f, (GreaterThanOrEqual, LessThanOrEqual))))
            return True
        if name in ("company_id", "provider") and isinstance(f, (EqualTo, In)):
            wanted = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
            self.only[name] = self.only.get(name, wanted) & wanted
            return True
        return False

    def opens(self, folder: Folder) -> bool:
        own = {"company_id": folder.company, "provider": folder.provider}
        return all(own[name] in wanted for name, wanted in self.only.items())

    def holds(self, at: datetime | None) -> bool:
        if not self.low and not self.high:
            return True
        if at is None:
            return False
        return all(at > x or same and at == x for x, same in self.low) and all(at < x or same and at == x for x, same in self.high)


def _payload(data: bytes) -> dict:
    """A file's payload: one object with items or an error, or an item a line."""
    try:
        whole = json.loads(data)
    except ValueError:
        whole = {"items": [json.loads(line) for line in data.splitlines() if line.strip()]}
    if isinstance(whole, dict) and "url" in whole:
        whole = {"items": [whole]}
    if not isinstance(whole, dict) or not (isinstance(whole.get("items"), list) or whole.get("error")):
        raise ValueError("neither items nor an error")
    return whole


def read_folder(folder: Folder | None, window: Window) -> Iterator[tuple]:
    """The rows of a folder's payloads, file by file."""
    if folder is None:  # a scan without partitions
        return
    system, top = _files(folder.path)
    for name in _names(folder):
        head = (folder.company, folder.provider, name)
        try:
            with system.open_input_stream(f"{top}/{name}") as stream:
                payload = _payload(stream.readall())
        except (ValueError, OSError) as problem:
            yield (*head, None, *[None] * 6, f"unreadable: {problem}"[:200])
            continue
        if payload.get("error"):
            yield (*head, None, *[None] * 6, str(payload["error"])[:200])
        for position, item in enumerate(payload.get("items") or []):
            if not isinstance(item, dict):
                yield (*head, position, *[None] * 6, "no item")
                continue
            at = _instant(item.get("published_at"))
            if window.holds(at):
                text = [None if item.get(k) is None else str(item[k]) for k in (*_ITEM, "language")]
                yield (*head, position, *text[:4], at, text[4], None)


class LandedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.window = path, Window()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.window.take(f) or ".".join(f.attribute) == "published_at":
                yield f  # rows of errors pass the window here, so Spark looks at it again

    def partitions(self) -> list[Folder]:
        return [f for f in folders(self.path) if self.window.opens(f)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return read_folder(partition, self.window)


class LandedStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The last file of each folder, by the folder's place below the path."""
        return {f"{f.company}\n{f.provider}": names[-1] for f in folders(self.path) if (names := _names(f))}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        made = []
        for folder in folders(self.path):
            own = f"{folder.company}\n{folder.provider}"
            if own in end and end[own] != start.get(own):
                made.append(Folder(folder.path, folder.company, folder.provider, start.get(own), end[own]))
        return made

    def read(self, partition: Folder) -> Iterator[tuple]:
        return read_folder(partition, Window())

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """Option path: the folder of payloads."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)


def health(rows):
    """company_id, provider, items, failures, ok of each pair: ok if some payload was read and none of its calls failed."""
    from pyspark.sql import functions as F

    failed = F.col("error").isNotNull()
    counted = rows.groupBy("company_id", "provider").agg(F.count_if(~failed).alias("items"), F.count_if(failed).alias("failures"))
    return counted.withColumn("ok", F.col("failures") == 0)

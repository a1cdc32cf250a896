"""JSON records held to a schema one by one: those that fit, typed, and those that do not, with each fault.

A record is a VARIANT, so a number and its text stay apart and one bad field hides no other. A file that is
no JSON is one rejected record; nothing fails the read and nothing is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of a record. kind: string, url, integer, boolean or strings; least and most bound a number or the length
    of each string (code points), items the number of strings."""

    name: str
    kind: str = "string"
    nullable: bool = False
    optional: bool = False
    least: int | None = None
    most: int | None = None
    items: int | None = None
    choices: tuple[str, ...] = ()


#: The levels that records may name.
TIERS = ("critical", "high", "medium", "low")
VOLUMES = ("high", "normal")
QUERY_SOURCES = ("human-approved", "llm-enriched", "triage-default", "fallback")

TRIAGE_RECORD = (
    Field("idx", "integer", least=1), Field("name", least=1), Field("tier", choices=tuple(t.upper() for t in TIERS)),
    Field("volume", choices=tuple(v.upper() for v in VOLUMES)), Field("reason"), Field("query", least=1), Field("neg"), Field("sector"),
)
COMPANY_RECORD = (
    Field("id"), Field("name"), Field("slug"), Field("aliases", "strings"), Field("domain", nullable=True), Field("sector", nullable=True),
    Field("ambiguity", choices=TIERS), Field("volume", choices=VOLUMES), Field("query"), Field("negativeKeywords", "strings"),
    Field("querySource", choices=QUERY_SOURCES), Field("enrichedBy", nullable=True), Field("enrichedAt", nullable=True),
)
CORPUS_ITEM = (
    Field("url", "url"), Field("title", least=1), Field("snippet", nullable=True, optional=True), Field("sourceName", nullable=True, optional=True),
    Field("publishedAt", nullable=True, optional=True), Field("language", nullable=True, optional=True),
)
ENRICHMENT_RECORD = (
    Field("known", "boolean"), Field("sector", most=80), Field("aliases", "strings", most=120, items=5), Field("domain", nullable=True, most=120),
    Field("ambiguity", choices=TIERS), Field("contextTerms", "strings", most=60, items=5), Field("negativeKeywords", "strings", most=60, items=5),
)

_TYPES = {"string": "string", "url": "string", "integer": "bigint", "boolean": "boolean", "strings": "array<string>"}


def parse_records(rows: DataFrame, text: str = "value", inside: str = "$") -> DataFrame:
    """rows with record (VARIANT) and at in place of text: a record for each element of the array at path ``inside``, or that one value.

    Text that is no JSON, or has nothing at the path, gives one record that is null. at counts from 0.
    """
    whole = F.try_variant_get(F.try_parse_json(text), F.lit(inside), "variant")
    each = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, F.lit("$"), "array<variant>")).otherwise(F.array(whole))
    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.posexplode(each).alias("at", "record"))


def read_records(spark: SparkSession, path: str, inside: str = "$", lines: bool = False) -> DataFrame:
    """file, at, record. Small files are read whole, one task a file; of JSON lines (``lines``) any file is split."""
    raw = spark.read.text(path, wholetext=not lines)
    return parse_records(raw.select(F.col("_metadata.file_path").alias("file"), "value"), inside=inside)


def _fault(field: Field, record: Column) -> Column:
    """struct(field, problem, found), or null if the field is as it should be; the first problem of a field only."""
    value = F.try_variant_get(record, F.lit(f"$.{field.name}"), "variant")
    kind = F.schema_of_variant(value)
    typed = F.try_variant_get(record, F.lit(f"$.{field.name}"), _TYPES[field.kind])
    number = F.try_variant_get(record, F.lit(f"$.{field.name}"), "double")
    values = F.try_variant_get(record, F.lit(f"$.{field.name}"), "array<variant>")
    right = {
        "string": kind == "STRING",
        "url": (kind == "STRING") & typed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"),
        "integer": (kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")) & (number == F.floor(number)),
        "boolean": kind == "BOOLEAN",
        "strings": (kind == "ARRAY<STRING>") | (kind.startswith("ARRAY") & (F.size(values) == 0)),
    }[field.kind]
    problem = F.when(value.isNull(), F.lit(None if field.optional else "missing"))
    problem = problem.when(kind == "VOID", F.lit(None if field.nullable else "null")).when(~F.coalesce(right, F.lit(False)), "type")
    sizes = {"string": F.length(typed), "integer": typed, "strings": None, "boolean": None, "url": None}[field.kind]
    if field.choices:
        problem = problem.when(~typed.isin(*field.choices), "choice")
    if field.kind == "strings" and field.items is not None:
        problem = problem.when(F.size(typed) > field.items, "too many")
    if field.kind == "strings" and field.most is not None:
        problem = problem.when(F.exists(typed, lambda s: F.length(s) > field.most), "too big")
    if sizes is not None and field.least is not None:
        problem = problem.when(sizes < field.least, "too small")
    if sizes is not None and field.most is not None:
        problem = problem.when(sizes > field.most, "too big")
    return F.when(problem.isNotNull(), F.struct(F.lit(field.name).alias("field"), problem.alias("problem"), F.to_json(value).alias("found")))


def faults(record: Column, fields: tuple[Field, ...]) -> Column:
    """array<struct<field, problem, found>> in the order of the fields, empty for a record that fits.

    What is no JSON object has one fault without a field: json where the text could not be read, else object.
    """
    one = lambda word: F.array(
        F.struct(F.lit(None).cast("string").alias("field"), F.lit(word).alias("problem"), F.to_json(record).alias("found"))
    )
    each = F.filter(F.array(*[_fault(f, record) for f in fields]), lambda x: x.isNotNull())
    return F.when(record.isNull(), one("json")).when(~F.schema_of_variant(record).startswith("OBJECT"), one("object")).otherwise(each)


def split_records(rows: DataFrame, fields: tuple[Field, ...], record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(records that fit, their fields as columns; the others with record as text and faults). Other columns stay in both.

    Every row is in one of the two; neither shuffles. A field named like another column of rows must be renamed before.
    """
    others = [c for c in rows.columns if c != record]
    judged = rows.withColumn("faults", faults(F.col(record), fields))
    typed = [F.try_variant_get(record, F.lit(f"$.{f.name}"), _TYPES[f.kind]).alias(f.name) for f in fields]
    bad = judged.where(F.size("faults") > 0).select(*others, F.to_json(record).alias(record), "faults")
    return judged.where(F.size("faults") == 0).select(*others, *typed), bad


def require_records(rows: DataFrame, fields: tuple[Field, ...], record: str = "record", shown: int = 5) -> DataFrame:
    """The typed records; raises ValueError with the first few faults if any record does not fit."""
    good, bad = split_records(rows, fields, record)
    found = bad.select(F.explode("faults").alias("f")).select("f.*").limit(shown).collect()
    if found:
        raise ValueError("records do not fit: " + "; ".join(f"{r['field'] or 'record'}: {r['problem']} ({r['found']})" for r in found))
    return good

"""Repair of loosely typed model answers, and small numeric helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cap_words, col

#: What models write for each label; an empty label means "does not apply".
SENTIMENTS = {
    "positive": "positive", "pos": "positive", "good": "positive", "favourable": "positive", "favorable": "positive",
    "negative": "negative", "neg": "negative", "bad": "negative", "unfavourable": "negative", "unfavorable": "negative",
    "neutral": "neutral", "neu": "neutral", "mixed": "neutral", "balanced": "neutral",
    "none": "", "null": "", "na": "", "n_a": "", "not_applicable": "", "notapplicable": "", "irrelevant": "",
}


def to_boolean(x: Column | str) -> Column:
    """true, yes, y, 1 and relevant in any case, numbers other than 0; anything else, null too, is false."""
    raw = F.lower(F.trim(col(x).cast("string")))
    number = F.try_to_number(raw, F.lit("S999999999D999999"))
    return F.coalesce(raw.isin("true", "yes", "y", "1", "relevant") | (F.coalesce(number, F.lit(0)) != 0), F.lit(False))


def to_boolean_text(x: Column | str) -> Column:
    """As to_boolean for answers that are text: a number other than 1 is no assent."""
    return F.coalesce(F.lower(F.trim(col(x))).isin("true", "yes", "y", "1", "relevant"), F.lit(False))


def to_confidence(x: Column | str) -> Column:
    """The number a text begins with; none: 0.5; above 1 a percentage; kept within 0 and 1."""
    prefix = F.regexp_extract(F.trim(col(x).cast("string")), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    n = F.nullif(prefix, F.lit("")).cast("double")
    scaled = F.when(n > 1, n / 100).otherwise(n)
    return F.when(n.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def sentiment_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(x))), r"[\s/-]+", "_")


def to_sentiment(x: Column | str) -> Column:
    """struct(label, known): label is null where none applies, known is false for words of no meaning here."""
    key = sentiment_key(x)
    table = F.create_map(*[F.lit(v) for pair in SENTIMENTS.items() for v in pair])
    found = F.try_element_at(table, key)
    blank = key.isNull() | (key == "")
    return F.struct(
        F.when(~blank, F.nullif(found, F.lit(""))).alias("label"), (blank | found.isNotNull()).alias("known")
    )


def repair(relevant: Column, sentiment: Column, confidence: Column, rationale: Column, evidence: Column) -> Column:
    """A raw answer of text fields as struct(relevant, sentiment, confidence, rationale, evidence, repair_error).

    Relevance is read as text: a number other than 1 is no assent (see repair_answer for typed answers). An answer of no relevance has no sentiment. Unknown sentiments, and relevance
    without one, are errors; the error is a value, never an exception.
    """
    unknown = F.concat(F.lit("unrecognised sentiment: "), sentiment)
    return _answer(to_boolean_text(relevant), to_sentiment(sentiment), confidence, rationale, evidence, unknown)


def _answer(yes: Column, mood: Column, confidence: Column, rationale: Column, evidence: Column, unknown: Column) -> Column:
    error = F.when(~mood["known"], unknown).when(yes & mood["label"].isNull(), "relevant article returned no sentiment")
    return F.struct(
        yes.alias("relevant"),
        F.when(yes, mood["label"]).alias("sentiment"),
        to_confidence(confidence).alias("confidence"),
        cap_words(rationale, 15).alias("rationale"),
        cap_words(evidence, 20).alias("evidence"),
        error.alias("repair_error"),
    )


#: Kinds of number that a parsed answer may hold.
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$"
#: The fields of an answer and the kinds that each may have; a field that may lack may be absent.
ANSWER_KINDS = {
    "relevant": rf"^BOOLEAN$|^STRING$|{_NUMBER}", "sentiment": "^STRING$|^VOID$", "confidence": rf"^STRING$|{_NUMBER}",
    "rationale": "^STRING$", "evidence": "^STRING$",
}


def answer_field(answer: Column, name: str) -> tuple[Column, Column]:
    """A field of a parsed answer and its kind (BOOLEAN, STRING, BIGINT, ...; VOID for null, null for none)."""
    value = F.try_variant_get(answer, f"$.{name}", "variant")
    return value, F.schema_of_variant(value)


def parse_answer(text: Column | str) -> Column:
    """A model's answer as VARIANT, types kept: the text, else the first object inside it; null if the fields do not fit."""
    raw = col(text)

    def fits(v: Column) -> Column:
        ok = F.schema_of_variant(v).startswith("OBJECT")
        for name, kinds in ANSWER_KINDS.items():
            kind = answer_field(v, name)[1]
            ok = ok & (kind.rlike(kinds) if name == "relevant" else F.coalesce(kind.rlike(kinds), F.lit(True)))
        return F.coalesce(ok, F.lit(False))

    whole = F.try_parse_json(raw)
    inner = F.try_parse_json(extract_json_object(F.when(~fits(whole), raw)))
    return F.when(fits(whole), whole).when(fits(inner), inner)


def repair_answer(answer: Column) -> Column:
    """As repair, for a parsed answer: true, numbers other than 0 and words of assent are relevant; 0.9 and "90%" are one confidence."""
    text = lambda name: F.try_variant_get(answer, f"$.{name}", "string")
    value, kind = answer_field(answer, "relevant")
    number = F.try_variant_get(value, "$", "double")
    yes = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind.rlike(_NUMBER), number != 0)
    yes = F.coalesce(yes, to_boolean_text(F.when(kind == "STRING", text("relevant"))))
    mood = to_sentiment(text("sentiment"))
    unknown = F.concat(F.lit("unrecognised sentiment: "), F.to_json(answer_field(answer, "sentiment")[0]))
    return _answer(yes, mood, text("confidence"), text("rationale"), text("evidence"), unknown)


def _first_object(text: str | None) -> str | None:
    """The first balanced braces of a text, braces inside quotes not counted."""
    if not text or (start := text.find("{")) < 0:
        return None
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : at + 1]
        at += 1
    return None


def extract_json_object(text: Column | str) -> Column:
    """The first balanced JSON object of each text, null if none."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_first_object)

    return F.pandas_udf(run, "string")(text)


def parse_json(text: Column | str, schema: str, required: str) -> Column:
    """The text as JSON, else the first object inside it; null unless the required field is there."""
    raw = col(text)
    whole = F.from_json(raw, schema)
    inner = F.from_json(extract_json_object(F.when(whole[required].isNull(), raw)), schema)
    return F.coalesce(F.when(whole[required].isNotNull(), whole), F.when(inner[required].isNotNull(), inner))


def tolerant_json(text: Column | str, schema: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(col(text), schema), fallback)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("bigint")


def server_timing(total_ns: Column, eval_count: Column, eval_ns: Column) -> Column:
    """struct(total_ms, tokens_per_second) of a model server's counters; null where they are absent."""
    return F.struct(
        (total_ns / 1e6).alias("total_ms"),
        F.when(eval_count.isNotNull() & (eval_ns > 0), eval_count / (eval_ns / 1e9)).alias("tokens_per_second"),
    )

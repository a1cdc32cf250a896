"""Text expressions: whole-word phrases, identity keys, ids, word caps, line formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accents that identity keys drop once a text is decomposed.
_MARKS = r"[\x{0300}-\x{036F}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once a row. A Column that stands at several places of another is made anew at each of them."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def phrase_pattern(phrase: Column) -> Column:
    """Pattern that finds the phrase literally, in any case, not next to a letter or a digit."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.trim(phrase), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))


def contains_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Whole-word, case-insensitive containment. A blank phrase matches nothing; null counts as empty.

    phrase is a Column, or a Python string for a fixed one (then the pattern is compiled once).
    """
    if isinstance(phrase, str):
        if not phrase.strip():
            return F.lit(False)
        literal = phrase.strip().replace("\\E", "\\E\\\\E\\Q")
        return text_or_empty(text).rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{literal}\E(?![\p{{L}}\p{{N}}])")
    term = F.coalesce(phrase, F.lit(""))
    return (F.trim(term) != "") & F.regexp_like(text_or_empty(text), phrase_pattern(term))


def _decomposed(x: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return values
        return pa.array((None if v is None else unicodedata.normalize("NFKD", v) for v in values.to_pylist()), values.type)

    return F.arrow_udf(run, "string")(x)


def _latin_core(x: Column | str, separator: str) -> Column:
    """Lower-case ASCII letters and digits, everything else a separator. Python sees only non-ASCII values."""
    raw = col(x)
    plain = F.when(raw.rlike(r"^[\x00-\x7F]*$"), raw).otherwise(
        F.regexp_replace(_decomposed(F.when(raw.rlike(r"[^\x00-\x7F]"), raw)), _MARKS, "")
    )
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]+", separator)


def slugify(x: Column | str) -> Column:
    trimmed = F.regexp_replace(_latin_core(x, "-"), "^-+|-+$", "")
    return F.substring(trimmed, 1, 60)


def normalize_title(x: Column | str) -> Column:
    """Identity key of a title. Never match text against it: it drops the spacing that matching needs."""
    return F.trim(_latin_core(x, " "))


def content_key(title: Column | str, domain: Column | str) -> Column:
    return F.concat(normalize_title(title), F.lit("|"), text_or_empty(domain))


def squash(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def same_name(a: Column, b: Column) -> Column:
    """Whether two names, squashed, contain one another; empty names match nothing."""
    x, y = squash(a), squash(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def quote(x: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(col(x), F.lit('"'), F.lit("")), F.lit('"'))


def cap_words(x: Column | str, most: int = 15) -> Column:
    """At most that many words, single-spaced, an ellipsis where some were cut."""
    words = F.filter(F.split(F.trim(text_or_empty(x)), r"\s+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, most), " ")
    return F.when(F.size(words) > most, F.concat(head, F.lit("…"))).otherwise(head)


def company_id(name: Column | str) -> Column:
    return F.sha2(F.concat(F.lit("company:"), F.lower(F.trim(col(name)))), 256)


def article_id(canonical_url: Column | str) -> Column:
    return F.sha2(col(canonical_url), 256)


def mention_id(company: Column | str, article: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", col(company).cast("string"), col(article).cast("string")), 256)


def alert_id(mention: Column | str, channel: Column | str) -> Column:
    return mention_id(mention, channel)


def cache_key(model: Column, version: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, version, F.trim(text)), 256)


def prompt_version_tag(name: Column | str, prompt: Column | str) -> Column:
    """The name, @ and twelve hex digits of the prompt's SHA-256."""
    return F.concat(col(name), F.lit("@"), F.substring(F.sha2(col(prompt), 256), 1, 12))


def pad_end(x: Column, width: int) -> Column:
    """Pad to a width without cutting what is longer."""
    return F.concat(x, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(x))))


def alert_line(date: Column, sentiment: Column, company: Column, title: Column) -> Column:
    return F.concat_ws(
        "  ",
        F.coalesce(F.substring(date, 1, 10), F.lit("—")),
        pad_end(F.upper(F.coalesce(sentiment, F.lit("unclassified"))), 11),
        pad_end(company, 22),
        title,
    )


def enrichment_query(name: Column, tier: Column, terms: Column) -> Column:
    """The quoted name, and for ambiguous names a choice of at most four context terms."""
    kept = F.slice(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != ""), 1, 4)
    choice = F.array_join(F.transform(kept, quote), " OR ")
    return F.when((tier == "low") | (F.size(kept) == 0), quote(name)).otherwise(
        F.concat(quote(name), F.lit(" AND ("), choice, F.lit(")"))
    )


def split_negatives(x: Column | str) -> Column:
    """Comma-separated terms, unquoted; blanks and a lone em dash dropped."""
    parts = F.transform(F.split(text_or_empty(x), ","), lambda s: F.regexp_replace(F.trim(s), '^"|"$', ""))
    return F.filter(parts, lambda s: (s != "") & (s != "—"))


def classify_prompt(company: Column, sector: Column, aliases: Column, exclusions: Column, headline: Column) -> Column:
    """The user part of a classification request: at most three aliases and five exclusions, blank ones passed over.

    Exclusions come as an instruction with a line each, set off by blank lines, and so does the headline.
    """
    named = F.slice(F.filter(aliases, lambda a: a != ""), 1, 3)
    left_out = F.slice(F.filter(F.transform(exclusions, lambda k: F.trim(k)), lambda k: k != ""), 1, 5)
    listed = F.array_join(F.transform(left_out, lambda k: F.concat(F.lit("  - "), k)), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Company: "), company),
        F.when(text_or_empty(sector) != "", F.concat(F.lit("Sector: "), sector)),
        F.when(F.size(named) > 0, F.concat(F.lit("Also written as: "), F.array_join(named, ", "))),
        # fixed value: the instruction as models are given it
        F.when(F.size(left_out) > 0, F.concat(F.lit("\nEXCLUDE — if the headline is about any of these, answer relevant: false:\n"), listed)),
        F.concat(F.lit("\nHeadline: "), F.trim(text_or_empty(headline))),
    )

"""Many phrases in one pass over a text: an automaton of all phrases, run once for each text.

A phrase is found as contains_phrase finds it: literally, in any case, not next to a letter or
a digit. Case is folded letter by letter (upper, then lower), which keeps the places of a text,
so that what stands beside a find can be looked at in the text itself.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases are sent to every executor up to this many characters in all; beyond, they are joined.
MOST_CHARS = 20_000_000


def _folds() -> dict[int, int]:
    """Letters whose folded form is another one: upper case first, then lower, one letter for one."""
    out = {}
    for code in range(0x110000):
        c = chr(code)
        up = c.upper()
        up = up if len(up) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else "i" if up == "İ" else up
        if low != c:
            out[code] = ord(low)
    return out


_TABLE: dict[int, int] = {}


def fold(text: str) -> str:
    """The text in one case, as long as before."""
    if text.isascii():
        return text.lower()
    if not _TABLE:
        _TABLE.update(_folds())
    return text.translate(_TABLE)


def _inside_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


class Matcher:
    """Finds which of the given phrases (trimmed, none blank) a text contains."""

    def __init__(self, phrases: Iterable[str]):
        import ahocorasick

        self.found_by: dict[str, list[str]] = {}
        for phrase in phrases:
            self.found_by.setdefault(fold(phrase), []).append(phrase)
        self.automaton = ahocorasick.Automaton()
        for folded in self.found_by:
            self.automaton.add_word(folded, folded)
        if self.found_by:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        if not text or not self.found_by:
            return []
        found: dict[str, None] = {}
        for end, folded in self.automaton.iter(fold(text)):
            start = end + 1 - len(folded)
            if folded in found or start and _inside_word(text[start - 1]) or end + 1 < len(text) and _inside_word(text[end + 1]):
                continue
            found[folded] = None
        return sorted(p for folded in found for p in self.found_by[folded])


_MATCHERS: dict[str, Matcher] = {}


def send_phrases(phrases: DataFrame, column: str, most_chars: int = MOST_CHARS):
    """The distinct trimmed phrases of a column as a broadcast, None if they are more than most_chars characters."""
    distinct = phrases.select(F.trim(F.col(column)).alias("p")).where("p <> ''").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    if size > most_chars:
        return None
    session: SparkSession = phrases.sparkSession
    return session.sparkContext.broadcast((uuid.uuid4().hex, [r[0] for r in distinct.collect()]))  # most_chars at most


def found_phrases(text: Column, sent) -> Column:
    """Array of those of the sent phrases that the text contains, in order; empty for null."""

    def run(texts: pa.Array) -> pa.Array:
        name, phrases = sent.value
        if name not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[name] = Matcher(phrases)
        # one text of the batch at a time is a Python string
        return pa.array((_MATCHERS[name](t.as_py()) for t in texts), pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)

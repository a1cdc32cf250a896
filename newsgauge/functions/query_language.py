"""Boolean phrase queries: compiled to one Column, or carried by rows as a short program.

A query is a tree of phrases, all-of and any-of. A fixed query becomes an expression that
stays inside code generation; rows that have queries of their own carry them as steps for a
stack, as long as the query, which one fold runs. OR binds least; phrases side by side are all required; a missing bracket or
a stray operator broadens the query and never fails it; nothing at all matches all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .text import contains_phrase

_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<quoted>[^"]*)(?:"|\Z)|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Query:
    """kind is phrase, all or any; parts are strings for a phrase (one) and queries otherwise."""

    kind: str
    parts: tuple

    @property
    def phrases(self) -> list[str]:
        return list(self.parts) if self.kind == "phrase" else [p for q in self.parts for p in q.phrases]

    @property
    def has_all(self) -> bool:
        """Whether some phrases must occur together."""
        return self.kind == "all" or (self.kind == "any" and any(q.has_all for q in self.parts))


def _tokens(text: str) -> list[tuple[str, str]]:
    found = []
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[m.lastgroup].strip()
        if kind == "word" and value.lower() in ("and", "or"):
            found.append((value.lower(), ""))
        elif kind in ("open", "close"):
            found.append((kind, ""))
        elif value:
            found.append(("phrase", value))
    return [*found, ("end", "")]


def _join(kind: str, parts: list[Query]) -> Query | None:
    return Query(kind, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def parse(text: str | None) -> Query | None:
    """The query's tree, None if it asks for nothing."""
    tokens, at = _tokens(text or ""), 0

    def unit() -> Query | None:
        nonlocal at
        kind, value = tokens[at]
        at += kind != "end"
        if kind == "phrase":
            return Query("phrase", (value,))
        if kind != "open":
            return None
        inside = level("or")
        at += tokens[at][0] == "close"
        return inside

    def level(operator: str) -> Query | None:
        nonlocal at
        below = unit if operator == "and" else lambda: level("and")
        parts = [x] if (x := below()) else []
        while tokens[at][0] == operator or (operator == "and" and parts and tokens[at][0] in ("phrase", "open")):
            at += tokens[at][0] == operator
            if x := below():
                parts.append(x)
        return _join("all" if operator == "and" else "any", parts)

    return level("or")


def compile_query(query: str | Query | None, text: Column | str) -> Column:
    """Whether a text satisfies the query; never null."""
    tree = parse(query) if isinstance(query, str) else query
    if tree is None:
        return F.lit(True)
    if tree.kind == "phrase":
        return contains_phrase(text, tree.parts[0])
    parts = [compile_query(q, text) for q in tree.parts]
    return reduce((lambda a, b: a & b) if tree.kind == "all" else (lambda a, b: a | b), parts)


def shape(query: str | None) -> dict[str, bool]:
    """What planner and filter ask of a query: more than one phrase, and phrases required together."""
    tree = parse(query)
    return {"disambiguates": tree is not None and tree.kind != "phrase", "conjunctive": tree is not None and tree.has_all}


def postfix(query: str | Query | None) -> list[tuple[str, str | None]]:
    """The query as steps for a stack: ("phrase", text) puts a truth value, ("all", None) and ("any", None) join two.

    As many steps as the query has phrases and operators. No step at all matches everything.
    """
    tree = parse(query) if isinstance(query, str) else query
    if tree is None:
        return []
    if tree.kind == "phrase":
        return [("phrase", tree.parts[0])]
    steps: list[tuple[str, str | None]] = []
    for n, part in enumerate(tree.parts):
        steps += postfix(part)
        if n:
            steps.append((tree.kind, None))
    return steps


PROGRAM = "array<struct<op string, phrase string>>"


def run_program(program: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether a row's program (PROGRAM) comes out true; holds says whether one phrase does. Never null."""
    none = F.array().cast("array<boolean>")

    def step(stack: Column, at: Column) -> Column:
        put = F.array_append(stack, F.coalesce(holds(at["phrase"]), F.lit(False)))
        a, b = F.element_at(stack, -1), F.try_element_at(stack, F.lit(-2))
        both = F.when(at["op"] == "all", a & b).otherwise(a | b)
        return F.when(at["op"] == "phrase", put).otherwise(F.array_append(F.slice(stack, 1, F.size(stack) - 2), both))

    end = F.aggregate(F.coalesce(program, F.array().cast(PROGRAM)), none, step)
    return F.coalesce(F.get(end, F.lit(0)), F.lit(True))


class ParseQuery:
    """SQL: ``SELECT * FROM parse_query('"a" AND ("b" OR c)')`` gives the steps, op and phrase by number."""

    def eval(self, query: str):
        for n, (op, phrase) in enumerate(postfix(query)):
            yield n, op, phrase


def register(spark: SparkSession) -> None:
    """Make parse_query a table function of the session's SQL."""
    spark.udtf.register("parse_query", udtf(ParseQuery, returnType="step int, op string, phrase string"))

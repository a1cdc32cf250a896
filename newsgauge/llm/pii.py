"""Personal data: patterns propose, checksums confirm, context words adjust the score. SQL functions only.

Patterns propose spans of e-mail and IP addresses, payment cards, phone numbers, bank
account numbers, identity numbers and local phone numbers. Luhn confirms cards, mod-97
confirms account numbers. Each kind has a score, raised if a word of its context stands
within ``reach`` code points; spans of at least ``threshold`` are reported. The contract's
four kinds score above any threshold up to theirs and are always reported.

Scale: narrow, row by row; no shuffle, no Python. Patterns are guarded by cheaper tests
and anchored so that no text makes them start again inside a run they have rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import count_kind, find, joined, let, ordered

#: The contract's patterns. A match may begin at the start of a run or where the last one
#: ended; possessive repeats cannot match less than the plain ones would.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds that the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: Length of an account number by country (ISO 13616), which ends one that is printed in groups.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BODIES = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[\x20-]?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items())
#: Only the first four characters are taken, so a rejected proposal hides no number after it.
GROUPED = rf"(?<![A-Za-z0-9])(?=((?:{_BODIES})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"
NATIONAL = r"(?<![0-9.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+().-])(?<![0-9+().-]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"

BASE, ADDED = ["email", "ip", "card", "phone"], ["iban", "national", "local"]
#: kind -> score without context, and the words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.3, "local": 0.3}
CONTEXT = {
    "email": "mail|contact|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|pay|payment|cvv|expir\\w*",
    "phone": "phone|tel|call|mobile|cell|fax|contact",
    "iban": "iban|bank|account|transfer|bic|swift",
    "national": "ssn|social|security|identity|tax|tin",
    "local": "phone|tel|call|mobile|cell|fax|contact",
}
RAISE = 0.3


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    numbers = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's digits, letters as 10 to 35 and the first four last, leave 1 by 97; gaps are skipped."""
    bare = F.regexp_replace(value, r"[\x20-]", "")
    moved = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _proposed(text: Column) -> tuple[Column, Column]:
    digit = text.rlike("[0-9]")
    base = F.concat(
        find(text, "email", EMAIL, text.contains("@")),
        find(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        find(
            text, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
            lambda m: F.when(_digits(m).between(16, 19), luhn(m)).otherwise(False),
        ),
        find(text, "phone", PHONE, text.rlike(r"\+[0-9]"), lambda m: _digits(m).between(8, 15)),
    )
    iban = F.concat(
        find(text, "iban", IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), mod97),
        find(text, "iban", GROUPED, text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{0,28}[\x20-][A-Z0-9]"), mod97, 1),
    )
    added = F.concat(
        F.array_distinct(iban),
        find(text, "national", NATIONAL, digit & text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
        find(text, "local", LOCAL, digit & text.rlike(r"[0-9]{3}[.-][0-9]{4}")),
    )
    return base, added


def _scored(text: Column, spans: Column, reach: int) -> Column:
    def one(s: Column) -> Column:
        start = F.greatest(s["start"] - reach, F.lit(0))
        before = F.substring(text, start + 1, s["start"] - start)
        around = F.lower(F.concat(before, F.lit(" | "), F.substring(text, s["end"] + 1, F.lit(reach))))
        near, score = F.lit(False), F.lit(0.0)
        for kind, words in CONTEXT.items():
            near = F.when(s["kind"] == kind, around.rlike(rf"\b(?:{words})\b")).otherwise(near)
            score = F.when(s["kind"] == kind, F.lit(SCORES[kind])).otherwise(score)
        score = F.least(F.lit(1.0), score + F.when(near, F.lit(RAISE)).otherwise(F.lit(0.0)))
        return s.withField("score", score)

    return F.transform(spans, one)


def find_pii(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, threshold: float = 0.5
) -> DataFrame:
    """doc_id, base (the four kinds of the contract), found (with the added kinds); one row per input row.

    Spans are structs of kind, start, end (code points, end exclusive), value and score.
    Spans of different kinds may overlap. A null or empty text has none; repeated rows
    are read alike; an empty input gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, added = _proposed(F.col("text"))
    both = F.struct(base.alias("base"), added.alias("added"))

    def judged(x: Column) -> Column:
        text = F.col("text")
        strong = F.filter(_scored(text, x["added"], reach), lambda s: s["score"] >= threshold)
        return F.struct(_scored(text, x["base"], reach).alias("base"), strong.alias("added"))

    rows = rows.select("doc_id", let(both, judged).alias("x"))
    return rows.select(
        "doc_id",
        ordered(F.col("x.base"), BASE, True).alias("base"),
        ordered(F.concat("x.base", "x.added"), BASE + ADDED, True).alias("found"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of find_pii's output."""
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        scores.alias("scores"),
    )



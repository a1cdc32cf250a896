"""Secret scan with multipart credential linking. SQL functions only.

Strong spans (assignments of secrets, access key ids, long hex runs) are reported as
they are. Weak candidates, which are common in harmless text, are reported only as
parts of a credential: a long mixed token counts beside an access identifier or an
endpoint, a login name or an endpoint beside a secret. Parts are linked by an interval
join of their offsets inside one document: two parts are in one scope if they begin at
most ``scope`` code points apart.

Scale: texts are read once, in narrow passes; what goes on are offsets. The join is on
(row, interval bin) and meets at most one row for each bin and role, its first and last
offset, since any part of the same bin is in scope and of the bin beside it only the
nearest one matters. A document full of candidates makes rows in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .spans import SPAN, count_kind, find, joined, ordered

#: Fixed by the contract; letters of the names in either case, spelled out for every engine.
_ANY = "".join
_WORDS = ["password", "passwd", "secret", "token"]


def _either(word: str) -> str:
    return _ANY(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join([*map(_either, _WORDS), _either("api") + "_?" + _either("key")])
ASSIGN = rf"(?:{NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak kinds: a mixed token of 20 or more characters, a named login, an address with a scheme.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
LOGIN = r"\b[uU][sS][eE][rR](?:[nN][aA][mM][eE]|_?[iI][dD])?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
ENDPOINT = r"\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:-]{3,}"

BASE, WEAK = ["assign", "access", "hex"], ["token", "login", "endpoint"]
#: Of each kind, the role it plays and the roles that complete a weak one.
ROLE = {"assign": "secret", "access": "identity", "hex": "secret", "token": "secret", "login": "identity", "endpoint": "endpoint"}
COMPLETES = {"token": ["identity", "endpoint"], "login": ["secret"], "endpoint": ["secret"]}


def _mixed(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def _parts(text: Column) -> tuple[Column, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    base = F.concat(
        find(text, "assign", ASSIGN, text.rlike(rf"(?:{NAMES})[\"']?\x20*[:=]"), value),
        find(text, "access", ACCESS, text.contains("AKIA") & text.rlike(ACCESS)),
        find(text, "hex", HEX, text.rlike(HEX)),
    )
    weak = F.concat(
        find(text, "token", TOKEN, text.rlike(r"[A-Za-z0-9+/_-]{20}"), _mixed),
        find(text, "login", LOGIN, text.rlike(r"[uU][sS][eE][rR]")),
        find(text, "endpoint", ENDPOINT, text.contains("://")),
    )
    return base, weak


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """doc_id, base (strong spans), found (with linked weak ones), links; one row per input row.

    Spans are structs of kind, start, end (code points, end exclusive) and value. links
    counts the reported weak parts. A weak token that begins inside a strong span is
    left out. A null or empty text has no span; repeated rows are scanned alike; an
    empty input gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    base, weak = _parts(F.col("text"))
    rows = materialize(rows.select("rid", "doc_id", base.alias("base"), weak.alias("weak")), "parts")

    held = rows.where(F.size("weak") > 0)
    some = held.select("rid", F.explode("base").alias("s")).unionByName(_outside(held))
    some = some.select("rid", "s", F.element_at(_map(ROLE), F.col("s.kind")).alias("role"), F.col("s.start").alias("at"))
    bin_ = F.floor(F.col("at") / scope)
    near = some.groupBy("rid", "role", bin_.alias("bin")).agg(F.min("at").alias("low"), F.max("at").alias("high"))

    wanted = F.element_at(
        F.create_map(*[x for k, v in COMPLETES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))]), F.col("s.kind")
    )
    asked = some.where(F.col("s.kind").isin(WEAK)).withColumn("want", F.explode(wanted))
    asked = asked.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    asked = asked.select("rid", "s", "at", "step", F.col("want").alias("role"), (bin_ + F.col("step")).alias("bin"))
    met = asked.join(near, ["rid", "role", "bin"]).where(
        (F.col("step") == 0)
        | ((F.col("step") == -1) & (F.col("high") >= F.col("at") - scope))
        | ((F.col("step") == 1) & (F.col("low") <= F.col("at") + scope))
    )
    linked = met.groupBy("rid").agg(F.collect_set("s").alias("linked"))  # the parts of one document
    out = rows.join(linked, "rid", "left").withColumn("linked", F.coalesce("linked", F.array().cast(SPAN)))
    return out.select(
        "doc_id",
        ordered(F.col("base"), BASE, False).alias("base"),
        ordered(F.concat("base", "linked"), BASE + WEAK, False).alias("found"),
        F.size("linked").alias("links"),
    )


def _outside(rows: DataFrame) -> DataFrame:
    """rid and the weak spans that begin in no strong one: a sweep over the starts and ends of each row's spans."""
    none = F.lit(None).cast("struct<kind:string,start:int,end:int,value:string>")
    event = lambda at, order, step, s: F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(step).alias("step"), s.alias("s"))
    events = F.concat(
        F.transform("base", lambda b: event(b["end"], 0, -1, none)), F.transform("base", lambda b: event(b["start"], 1, 1, none)),
        F.transform("weak", lambda w: event(w["start"], 2, 0, w)),
    )
    sweep = Window.partitionBy("rid").orderBy("e.at", "e.order").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("rid", F.explode(events).alias("e")).withColumn("open", F.sum("e.step").over(sweep))
    return within.where((F.col("e.order") == 2) & (F.col("open") == 0)).select("rid", "e.s")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of secret_scan's output."""
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.col("links").alias("n_linked"),
    )

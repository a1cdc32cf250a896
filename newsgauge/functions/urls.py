"""URL expressions: canonical form, hosts, publisher and article domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, text_or_empty

#: Parameters that identify a campaign and not a page.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid",
    "mc_cid", "mc_eid", "ref", "ref_src", "sh", "guccounter", "ncid",
)
#: Hosts whose links are redirects, and publishers without reporting of their own.
OPAQUE_HOSTS = ("news.google.com",)
BLOCKED_DOMAINS = ("newswav.com", "biggo.com", "finance.biggo.com")

#: Schemes whose URLs have a host, with their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SPECIAL = r"(?i)^(?:https?|wss?|ftp):"
#: scheme, user, host, port, path, query of such a URL; slashes after the scheme may lean either way or lack.
_URL = r"(?i)^(https?|wss?|ftp):[/\\]*(?:([^/?#\\]*)@)?(\[[^\]/?#\\]*\]|[^/?#\\:]*)(?::([^/?#\\]*))?([^?#]*)(?:\?([^#]*))?"
#: A URL that is its canonical form already: plain host, no query, no escape, no dot segment, no slash at the end.
_CANONICAL = (
    r"^https://(?!www\.)[a-z0-9-]+(?:\.[a-z0-9-]+)*(?!.*/\.\.?(?:/|\z))"
    r"/(?:[\x21\x24\x26-\x3B\x3D\x40-\x5B\x5D-\x5F\x61-\x7A\x7C\x7E]*[\x21\x24\x26-\x2E\x30-\x3B\x3D\x40-\x5B\x5D-\x5F\x61-\x7A\x7C\x7E])?\z"
)
#: The same of any other URL that has an authority.
_OTHER = r"^([A-Za-z][A-Za-z0-9+.-]*):/*([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Characters of a path that stay; all others are written as bytes.
_ESCAPED = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E\x25]"
#: Characters that no host has.
_NO_HOST = r"[\x00-\x20\x7F\"#%/<>?@\[\\\]^`{|}]"


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def percent_encode_path(path: Column) -> Column:
    """Characters outside the path set as the bytes of their UTF-8; escapes that are there stay as they are."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")

    def escaped(path: Column) -> Column:
        each = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
        made = F.array_join(F.transform(each, lambda c: F.when(c.rlike(_ESCAPED), code(c)).otherwise(c)), "")
        return F.when(path.rlike(_ESCAPED), made).otherwise(path)

    return bound(path, escaped)


def remove_dot_segments(path: Column) -> Column:
    """The path without ``.`` and ``..`` (also written %2e); one at the end leaves a slash."""
    plain = lambda s: F.regexp_replace(F.lower(s), "%2e", ".")
    numbered = lambda parts: F.transform(
        parts, lambda s, i: F.struct(s.alias("s"), plain(s).alias("p"), (i == F.size(parts) - 1).alias("last"))
    )

    def step(kept: Column, at: Column) -> Column:
        end = F.when(at["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))  # the first is what stands before the leading slash
        return F.when(at["p"] == ".", F.concat(kept, end)).when(at["p"] == "..", F.concat(up, end)).otherwise(F.array_append(kept, at["s"]))

    made = lambda path: F.array_join(F.aggregate(bound(F.split(path, "/"), numbered), F.array().cast("array<string>"), step), "/")
    return bound(path, lambda path: F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), made(path)).otherwise(path))


def _form_decoded(x: Column) -> Column:
    """Form decoding: plus is a space, escapes are UTF-8 bytes, a percent sign of no escape stays."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_query(query: Column) -> Column:
    """The parameters that do not track, in order of name (equal names keep theirs), form-encoded anew."""
    given = F.filter(F.split(query, "&"), lambda p: p != "")
    parts = lambda p: (F.substring_index(p, "=", 1), F.substr(p, F.length(F.substring_index(p, "=", 1)) + F.lit(2)))
    pairs = F.transform(given, lambda p, i: F.struct(_form_decoded(parts(p)[0]).alias("n"), i.alias("i"), _form_decoded(parts(p)[1]).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["n"]).isin(*TRACKING))
    keyed = F.transform(kept, lambda p: F.struct(F.encode(p["n"], "UTF-16BE").alias("k"), p["i"].alias("i"), p["n"].alias("n"), p["v"].alias("v")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")


def ascii_host(host: Column) -> Column:
    """Lower-case host in ASCII: escapes decoded, labels of other letters in Punycode; null where that cannot be."""
    plain = lambda host: F.when(
        host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
    ).otherwise(host)

    def coded(dotted: Column) -> Column:
        other = dotted.rlike(r"[^\x00-\x7F]")
        made = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.when(other, dotted).otherwise(F.lit("a")))
        return F.lower(F.when(other, made).otherwise(dotted))

    made = bound(F.regexp_replace(bound(host, plain), "[。．｡]", "."), coded)
    return bound(made, lambda made: F.when((made != "") & (made.startswith("[") | ~made.rlike(_NO_HOST)), made))


def canonical_url(raw: Column | str) -> Column:
    """One form for all links to a page; null where the URL cannot be read.

    As browsers read it: https for http, host in ASCII and lower case without www., no default
    port, dot segments resolved, other characters of the path escaped, no fragment, no
    tracking parameters, the others form-encoded in order of name, no trailing slash. Links of
    other schemes keep their parts as they are written.
    """
    return F.when(col(raw).rlike(_CANONICAL), col(raw)).otherwise(_made_canonical(col(raw)))


def _made_canonical(raw: Column) -> Column:
    url = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return bound(url, lambda url: F.when(url.rlike(_SPECIAL), _special_url(url)).otherwise(_other_url(url)))


def _path_or_slash(path: Column) -> Column:
    return bound(F.regexp_replace(path, "(?<=.)/+$", ""), lambda path: F.when(path == "", "/").otherwise(path))


def _special_url(url: Column) -> Column:
    part = lambda n: F.regexp_extract(url, _URL, n)
    parts = F.struct(F.lower(part(1)).alias("given"), F.regexp_replace(part(4), "^0+(?=.)", "").alias("digits"))
    usual = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])
    user = bound(part(2), lambda user: F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""))
    name = F.regexp_replace(ascii_host(part(3)), r"^www\.(?=.)", "")
    path = _path_or_slash(remove_dot_segments(percent_encode_path(F.translate(part(5), "\\", "/"))))
    query = bound(canonical_query(part(6)), lambda query: F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

    def made(parts: Column) -> Column:
        given, digits = parts["given"], parts["digits"]
        scheme = F.when(given == "http", "https").otherwise(given)
        default = (digits == "") | (digits == F.try_element_at(usual, given)) | (digits == F.try_element_at(usual, scheme))
        port = F.when(default, "").otherwise(F.concat(F.lit(":"), digits))
        sound = digits.rlike(r"^\d{0,5}$") & (F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0)) < 65_536)
        return F.when(sound, F.concat(scheme, F.lit("://"), user, name, port, path, query))

    return bound(parts, made)


def _other_url(url: Column) -> Column:
    part = lambda n: F.regexp_extract(url, _OTHER, n)
    query = bound(part(4), lambda query: F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    made = F.concat(F.lower(part(1)), F.lit("://"), _bare(part(2)), _path_or_slash(part(3)), query)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), made)


def host(url: Column | str) -> Column:
    """Lower-case host without www.; null where there is none."""
    return _bare(F.try_parse_url(F.trim(col(url)), F.lit("HOST")))


def opaque_host(host: Column) -> Column:
    return F.coalesce(host.isin(*OPAQUE_HOSTS), F.lit(False))


def is_opaque(url: Column | str) -> Column:
    return opaque_host(host(url))


def _declared(source: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(source))), r"^www\.", "")


def publisher_of_host(host: Column, source: Column | str) -> Column:
    """The declared source if it looks like a domain, else the host of the link, else whatever was declared."""
    named = _declared(source)
    return F.when(named.contains(".") & ~named.contains(" "), named).otherwise(F.coalesce(host, named))


def publisher_domain(url: Column | str, source: Column | str) -> Column:
    return publisher_of_host(host(url), source)


def article_domain(url: Column | str, source: Column | str) -> Column:
    """The host first, the declared source where there is none."""
    return F.coalesce(host(url), _declared(source))


def blocking_entry(domain: Column, blocked: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    """The first entry that is the domain or a parent of it; null if none."""
    entries = F.array(*[F.lit(b.strip().lower()) for b in blocked if b.strip()]) if blocked else F.array().cast("array<string>")
    of = text_or_empty(domain)
    return F.get(F.filter(entries, lambda e: (of == e) | of.endswith(F.concat(F.lit("."), e))), F.lit(0))

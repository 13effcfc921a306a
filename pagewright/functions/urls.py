"""URLs as browsers read them, as columns: references in attributes, resolution against a base, usual form.

A reference is trimmed of control characters and blanks, then taken apart and put together with the base's parts: scheme and host in lower
case, no default port, dot segments folded away, backslashes as slashes, characters that a URL can't hold percent-encoded as UTF-8.
Opaque URLs (mailto, javascript, data and other schemes without authority) stay as they are. A reference that is no URL is null: an unknown
base, an empty host, a port above 65535, a host with a character that no host has. Left aside: punycode of hosts (kept, in lower case), IPv4 in other than
its usual form, and Windows drive letters.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes with an authority, and their default ports.
SPECIAL = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
#: What is percent-encoded in a path, a query and a fragment; what no host holds.
IN_PATH = "[\\x{0}-\\x{20}\"#<>?^`{}\\x{7f}-\\x{10ffff}]"
IN_QUERY = "[\\x{0}-\\x{20}\"#<>'\\x{7f}-\\x{10ffff}]"
IN_FRAGMENT = "[\\x{0}-\\x{20}\"<>`\\x{7f}-\\x{10ffff}]"
NO_HOST = "[\\x{0}-\\x{20}#%/<>?@\\\\^|]"
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _names() -> Column:
    """Characters by the names of references; those that need no semicolon have a name without one too."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _numbers() -> Column:
    """Characters of numbers that stand for those of an older code page."""
    old = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    return F.from_json(F.lit(json.dumps({k: v for k, v in old.items() if v != "�"})), "map<string,string>")


def decoded(c: Column | str) -> Column:
    """The value of an attribute with its character references replaced; unknown ones stay."""

    def one(part: Column) -> Column:
        token = F.regexp_extract(part, "^&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?", 0)
        body = F.regexp_replace(token, "^&#?|;$", "")
        code = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 20), 16, 10)).otherwise(body).try_cast("long")
        bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        character = F.when(bad, F.lit("�")).otherwise(F.coalesce(F.try_element_at(_numbers(), code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        rest = F.substring(part, F.length(token) + 1, F.length(part))
        name = F.try_element_at(_names(), F.substring(token, F.lit(2), F.length(token)))
        named = F.when(~token.endswith(";") & rest.startswith("="), None).otherwise(name)
        return F.when(token == "", part).when(token.startswith("&#"), F.concat(character, rest)).otherwise(F.concat(F.coalesce(named, token), rest))

    c = col(c)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), one), "")).otherwise(c)


def encoded(c: Column, held: str) -> Column:
    """c with the characters of a class percent-encoded."""
    byte = lambda x: F.when(F.rlike(x, F.lit(held)), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")).otherwise(x)
    return F.when(F.rlike(c, F.lit(held)), F.array_join(F.transform(F.split(c, ""), byte), "")).otherwise(c)


def folded(path: Column) -> Column:
    """A path that begins with a slash without its dot segments."""
    dot = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    none = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(dot(s) == "..", up).when(dot(s) == ".", done).otherwise(F.array_append(done, s))

    def walk(steps: Column) -> Column:
        last = F.when(dot(F.element_at(steps, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(steps, none, step), last), "/"))

    return let(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), walk)


def _authority(scheme: Column, given: Column) -> Column:
    """The authority in its usual form; null if it is none."""
    user = F.regexp_extract(given, "^(.*@)", 1)
    place = F.lower(F.regexp_replace(given, "^.*@", ""))
    host = F.regexp_replace(place, ":[0-9]*$", "")
    port = F.regexp_replace(F.regexp_extract(place, ":([0-9]*)$", 1), "^0+(?=.)", "")
    default = F.element_at(F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv]), scheme)
    bare = F.when(scheme == "file", F.when(host == "localhost", F.lit("")).otherwise(host)).otherwise(F.concat(user, host))
    bad = F.rlike(host, F.lit(NO_HOST)) | (F.contains(host, F.lit(":")) & ~F.rlike(host, F.lit("^\\[[0-9a-f:.]+\\]$"))) | ((host == "") & (scheme != "file")) | F.coalesce(port.try_cast("long") > 65535, F.lit(False))
    return F.when(bad, None).when((port == "") | (port == default), bare).otherwise(F.concat(bare, F.lit(":"), port))


PARTS = ("scheme", "authority", "path", "query", "fragment")


def _taken(c: Column) -> Column:
    """A reference in pieces: scheme ('' without one), body, query and fragment (each with its sign, '' without one)."""
    trimmed = F.regexp_replace(F.regexp_replace(c, "^[\\x{0}-\\x{20}]+|[\\x{0}-\\x{20}]+$", ""), "[\\t\\n\\r]", "")

    def pieces(s: Column) -> Column:
        scheme = F.lower(F.regexp_extract(s, SCHEME, 1))
        special = scheme.isin("", *SPECIAL)
        rest = F.regexp_replace(s, SCHEME, "")
        body = F.regexp_extract(rest, "^[^?#]*", 0)
        return F.struct(scheme.alias("scheme"), F.when(special, F.replace(body, F.lit("\\"), F.lit("/"))).otherwise(body).alias("body"), F.regexp_extract(rest, "^[^?#]*(\\?[^#]*)", 1).alias("query"), F.regexp_extract(rest, "(?s)(#.*)$", 1).alias("fragment"))

    return let(trimmed, pieces)


def parsed(c: Column | str, base: Column | None = None) -> Column:
    """PARTS of a reference, seen from a base (such parts, too); null if it is no URL. A path without authority is opaque."""
    none = F.lit(None).cast("struct<" + ",".join(f"{p}:string" for p in PARTS) + ">")
    b = none if base is None else base

    def placed(r: Column) -> Column:
        """Which scheme holds, whether the base's parts do, and what comes after the authority's slashes, if there are any."""
        same = F.coalesce(r["scheme"] == b["scheme"], F.lit(False)) & (r["scheme"] != "file")
        relative = (r["scheme"] == "") | (same & ~r["body"].startswith("/"))
        fields = {**{n: r[n] for n in ("body", "query", "fragment")}, "relative": relative, "scheme": F.when(relative, b["scheme"]).otherwise(r["scheme"])}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    def led(r: Column) -> Column:
        plain = r["relative"] | (r["scheme"] == "file")
        marked = F.when(plain, r["body"].startswith("//")).otherwise(F.lit(True))
        after = F.when(plain, F.substring(r["body"], F.lit(3), F.length(r["body"]))).otherwise(F.regexp_replace(r["body"], "^/*", ""))
        return F.struct(*(r[n].alias(n) for n in ("body", "query", "fragment", "relative", "scheme")), F.coalesce(marked, F.lit(False)).alias("led"), after.alias("after"))

    def build(r: Column) -> Column:
        relative, scheme, body = r["relative"], r["scheme"], r["body"]
        own = F.regexp_extract(r["after"], "^[^/]*", 0)
        authority = F.when(r["led"], _authority(scheme, own)).when(relative, b["authority"]).otherwise(F.lit(""))
        tail = F.substring(r["after"], F.length(own) + 1, F.length(r["after"]))
        inner = F.when(body.startswith("/"), body).when(relative & (body == ""), b["path"]).when(relative, F.concat(F.regexp_replace(b["path"], "[^/]*$", ""), body)).otherwise(body)
        path = F.when(r["led"], tail).otherwise(inner)
        path = encoded(folded(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))), IN_PATH)
        query = F.when(relative & (body == "") & (r["query"] == ""), b["query"]).otherwise(encoded_tail(r["query"], IN_QUERY))
        whole = [scheme, authority, path, query, encoded_tail(r["fragment"], IN_FRAGMENT)]
        kept = [scheme, F.lit(None), body, r["query"], r["fragment"]]  # an opaque URL
        known = F.coalesce(scheme.isin(*SPECIAL), F.lit(False))
        parts = F.struct(*(F.when(known, x).otherwise(y).cast("string").alias(n) for n, x, y in zip(PARTS, whole, kept)))
        return F.when(F.when(known, authority.isNotNull()).otherwise(~relative), parts)

    return let(let(let(_taken(col(c)), placed), led), build)


def encoded_tail(c: Column, held: str) -> Column:
    """A query or fragment with its sign kept; a sign alone stands for an empty one and stays."""
    return F.concat(F.substring(c, 1, 1), encoded(F.substring(c, F.lit(2), F.length(c)), held))


def spelled(p: Column) -> Column:
    """The URL of parsed parts."""
    return F.concat(p["scheme"], F.lit(":"), F.coalesce(F.concat(F.lit("//"), p["authority"]), F.lit("")), p["path"], p["query"], p["fragment"])


def resolved(reference: Column | str, base: Column | str | None = None) -> Column:
    """The absolute URL of a reference; base: an absolute URL. Null for what is no URL."""
    if base is None:
        return let(parsed(reference), spelled)
    return let(parsed(base), lambda b: let(parsed(reference, b), spelled))


def page_of(p: Column) -> Column:
    """The URL of parsed parts as a page's: no query, no fragment, no slashes at the end of a path longer than one."""
    bare = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(p["authority"].isNull(), p["path"]).when(bare == "", F.lit("/")).otherwise(bare)
    return F.concat(p["scheme"], F.lit(":"), F.coalesce(F.concat(F.lit("//"), p["authority"]), F.lit("")), path)


def page_url(c: Column | str, base: Column | str | None = None) -> Column:
    if base is None:
        return let(parsed(c), page_of)
    return let(parsed(base), lambda b: let(parsed(c, b), page_of))


def origin_of(c: Column | str) -> Column:
    """Scheme, host and port of an http or https URL; '' for others."""
    return F.regexp_replace(F.regexp_extract(col(c), "^(https?://[^/?#]*)", 1), "//.*@", "//")

"""The replay form of a page: its relative links keep their base and its scripts don't run. Only the tags that change are rewritten.

A page is cut into tokens that cover it whole: comments, scripts and styles with their bodies, tags, and what lies between. Edits are spliced in by token, so every byte outside
of them stays as it is. The first head gets a base element first; where no tag opens a head, one is made after the html tag, else after the doctype, else at the beginning. A base that an earlier
replay set goes. A script's src and type move to data attributes, and its type disables it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

_INSIDE = "(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = f"(?is)<!--.*?(?:-->|\\z)|<(?:script|style|title|textarea)\\b{_INSIDE}>.*?(?:</(?:script|style|title|textarea)\\b|\\z)|</?[a-z]{_INSIDE}>|<![^>]*>|[^<]++|<"
ATTRIBUTE = "(?s)\\s+[^\\s=>\"'/]+(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s>\"']+))?|/"
#: What marks our base and moved attributes, and the type of a script that doesn't run.
BASE, SRC, TYPE, DISABLED = "data-replay-base", "data-replay-script-src", "data-replay-script-type", "application/x-disabled"


def _script(token: Column) -> Column:
    """A script with its body, disabled."""
    start = F.regexp_extract(token, f"(?is)^<script\\b{_INSIDE}>", 0)
    named = lambda a, name: F.rlike(a, F.lit(f"(?is)^\\s+{name}\\s*(=|$)"))
    full = lambda a: F.rlike(a, F.lit("(?s)=\\s*(\"[^\"]|'[^']|[^\\s\"'])"))

    def moved(a: Column) -> Column:
        to = lambda name: F.regexp_replace(a, "(?i)^(\\s+)(?:src|type)", f"$1{name}")
        return F.when(named(a, "src"), F.when(full(a), to(SRC)).otherwise(a)).when(named(a, "type"), F.when(full(a), to(TYPE)).otherwise(F.lit(""))).otherwise(a)

    attributes = F.filter(F.regexp_extract_all(F.substring(start, F.lit(8), F.length(start) - 8), F.lit(ATTRIBUTE), F.lit(0)), lambda a: a != "/")
    return F.concat(F.substring(start, 1, 7), F.array_join(F.transform(attributes, moved), ""), F.lit(f' type="{DISABLED}">'), F.substring(token, F.length(start) + 1, F.length(token)))


def replayed(html: Column | str, url: Column | str) -> Column:
    """The replay form of html as fetched from url."""
    base = F.concat(F.lit(f'<base {BASE}="true" href="'), X.escape_html(url), F.lit('">'))
    ours = lambda t: F.rlike(t, F.lit(f"(?is)^<base\\b{_INSIDE}>")) & F.contains(t, F.lit(BASE))
    tokens = F.filter(F.regexp_extract_all(X.col(html), F.lit(TOKEN), F.lit(0)), lambda t: ~ours(t))

    def spliced(tokens: Column) -> Column:
        first = lambda pattern: F.array_position(F.transform(tokens, lambda t: F.rlike(t, F.lit(pattern))), F.lit(True))
        head, page, kind = first("(?is)^<head[\\s/>]"), first("(?is)^<html[\\s/>]"), first("(?is)^<!doctype")
        own = F.concat(F.lit("<head>"), base, F.lit("</head>"))
        after = F.when(head > 0, head).when(page > 0, page).otherwise(kind)
        added = F.when(head > 0, base).otherwise(own)

        def one(t: Column, i: Column) -> Column:
            edited = F.when(F.rlike(t, F.lit("(?is)^<script[\\s/>]")), _script(t)).otherwise(t)
            return F.when(i + 1 == after, F.concat(edited, added)).otherwise(edited)

        return F.concat(F.when(after == 0, added).otherwise(F.lit("")), F.array_join(F.transform(tokens, one), ""))

    return F.get(F.transform(F.array(tokens), spliced), F.lit(0))

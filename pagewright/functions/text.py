"""Text, hash and CSS functions as columns, and parts of URLs. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Fixed value: what counts as white space in page text; U+FEFF and U+00A0 do, U+0085 doesn't.
BLANK = "[\\t\\n\\x{0b}\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
#: Fixed value: path endings that a crawl leaves out.
ASSETS = "(?i)\\.(?:png|jpe?g|gif|webp|svg|ico|pdf|zip|mp4|mp3|webm|css|js|json|xml|txt)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: Column | str) -> Column:
    """The value, or null where it is empty: for chains of alternatives that skip both."""
    return F.nullif(col(c), F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Runs of white space as one blank, trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(col(c), BLANK, " ")), F.lit(""))


def escape_css(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "([^a-zA-Z0-9_-])", "\\\\$1")


def escape_html(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def asset(content: Column | str) -> tuple[Column, Column]:
    """Bytes and SHA-256 of a text as it would be written."""
    return F.octet_length(col(content)).cast("long"), F.sha2(F.encode(col(content), "UTF-8"), 256)


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def css_times(c: Column | str) -> Column:
    """Milliseconds of a CSS time list; what doesn't parse is 0."""
    def one(part: Column) -> Column:
        t = F.trim(part)
        number = F.coalesce(F.regexp_extract(t, "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)", 0).try_cast("double"), F.lit(0.0))
        return F.when(t.endswith("ms"), number).when(t.endswith("s"), number * 1000).otherwise(number)

    return F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), one)


def has_time(c: Column | str) -> Column:
    return F.exists(css_times(c), lambda x: x > 0)


def radius_pair(c: Column | str, width: Column, height: Column) -> Column:
    """(x, y) of a CSS radius, in pixels or percent of the box; a missing y is x."""
    parts = F.split(normalize_text(c), " ")

    def size(p: Column, of: Column) -> Column:
        n = F.coalesce(truthy(F.regexp_extract(p, "^[0-9.]+", 0)).try_cast("double"), F.lit(0.0))  # a cast that fails is slow
        return F.when(p.endswith("%"), n * of / 100).otherwise(n)

    return F.struct(size(F.get(parts, F.lit(0)), width).alias("x"), size(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))), height).alias("y"))


def corner_radii(corners: dict[str, Column | str], width: Column, height: Column, whole: Column | str | None = None) -> Column:
    """The radii of four corners (topLeft, topRight, bottomRight, bottomLeft) as the style gives them, rounded; an empty one is that of the whole box."""
    out = []
    for name, c in corners.items():
        r = radius_pair(truthy(c) if whole is None else F.coalesce(truthy(c), col(whole)), width, height)
        out.append(F.struct(*(F.greatest(F.lit(0), round_half_up(r[k])).alias(k) for k in "xy")).alias(name))
    return F.struct(*out)


def clamped_radii(radii: Column, width: Column, height: Column) -> Column:
    """Corner radii for drawing: at most half the box."""
    half = lambda r, size: F.greatest(F.lit(0), F.least(round_half_up(r), F.floor(size / 2)))
    return F.struct(*(F.struct(half(radii[n]["x"], width).alias("x"), half(radii[n]["y"], height).alias("y")).alias(n) for n in ("topLeft", "topRight", "bottomRight", "bottomLeft")))


def host(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^[a-z]+://([^/?#]*)", 1)


def origin(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^([a-z]+://[^/?#]*)", 1)


def path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^[a-z]+://[^/?#]*([^?#]*)", 1)


def slug(c: Column | str) -> Column:
    """The last step of the path, else the host, as at most 48 letters, digits and dashes."""
    last = F.regexp_extract(F.regexp_replace(path(c), "/+$", ""), "([^/]*)$", 1)
    s = F.regexp_replace(F.lower(F.coalesce(truthy(last), host(c))), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 48)
    return F.coalesce(truthy(s), F.lit("capture"))


def valid_url(c: Column | str) -> Column:
    """(url, error): an http, https or file URL in its usual form (see urls.py), or why not."""
    given = F.coalesce(col(c), F.lit(""))

    def judged(p: Column) -> Column:
        known = p["scheme"].isin("http", "https", "file")
        error = F.when(given == "", "URL is required").when(p.isNull(), "Invalid URL").when(~known, "Only http, https, and file URLs are supported")
        return F.struct(F.when(error.isNull(), urls.spelled(p)).alias("url"), error.alias("error"))

    return urls.let(urls.parsed(given), judged)


def bounded(c: Column | str, low: int, high: int, error: str) -> Column:
    """(value, error): a number within bounds, rounded down, or why not; NaN and infinite ones are none."""
    x = col(c).cast("double")
    ok = F.coalesce((x >= low) & (x <= high) & ~F.isnan(x), F.lit(False))
    return F.struct(F.when(ok, F.floor(x)).alias("value"), F.when(~ok, F.lit(error)).alias("error"))


def dimension(c: Column | str, name: str) -> Column:
    return bounded(c, 320, 10000, f"{name} must be a number between 320 and 10000")


def max_pages(c: Column | str) -> Column:
    return bounded(c, 1, 200, "--max-pages must be a number between 1 and 200")


def job_id(at: Column, url: Column | str, nonce: Column) -> Column:
    """Time (UTC, to the millisecond), slug and the first 8 characters of a random id."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("-"), slug(url), F.lit("-"), F.substring(nonce, 1, 8))


def resolved_path(base: Column | str, path_: Column | str) -> Column:
    """A path as seen from the folder of a file; '' stays '', an absolute one stays as it is, `.` and `..` are resolved."""
    p = F.coalesce(col(path_), F.lit(""))
    steps = F.filter(F.split(F.concat(F.regexp_replace(col(base), "[^/]*$", ""), p), "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda done, s: F.when(s != "..", F.array_append(done, s)).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))))
    return F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), F.array_join(walked, "/")))


def is_asset(c: Column | str) -> Column:
    return F.rlike(path(c), F.lit(ASSETS))


def crawl_by_default(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit("^https?://")) & path(c).isin("", "/") & ~F.contains(F.regexp_replace(col(c), "#.*$", ""), F.lit("?"))


def item_line(n: Column, kind: Column, label: Column, x: Column, y: Column, w: Column, h: Column, *others: Column) -> Column:
    """`N. [kind] label (WxH+X+Y)`; without a label the first of others (selector, id) that isn't empty."""
    bounds = F.when(w.isNull(), F.lit("unknown-bounds")).otherwise(F.format_string("%dx%d+%d+%d", w, h, x, y))
    return F.concat(n.cast("string"), F.lit(". ["), kind, F.lit("] "), F.coalesce(truthy(label), *map(truthy, others), F.lit("untitled")), F.lit(" ("), bounds, F.lit(")"))


def item_indexes(text: Column | str, most: Column) -> Column:
    """0-based positions of a selection: 'all', or numbers from 1 separated by commas.

    Parts that are no whole numbers are left out, repeated ones count once, an empty part is 0; a number out of
    range raises an error.
    """
    parts = F.transform(F.split(col(text), ","), lambda p: F.when(F.trim(p) == "", F.lit(0)).otherwise(F.trim(p).try_cast("int")))
    whole = F.array_distinct(F.filter(parts, lambda i: i.isNotNull()))
    bad = F.exists(whole, lambda i: (i < 1) | (i > most))
    return F.when(col(text) == "all", F.sequence(F.lit(0), most.cast("int") - 1)).when(bad, F.raise_error(F.lit("item index out of range")).cast("array<int>")).otherwise(F.transform(whole, lambda i: i - 1))

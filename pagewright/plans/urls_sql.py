"""Resolution of references as DuckDB SQL, step by step over a table, for the queries' own SQL.

It covers http, https and opaque references against http and https bases in their usual form.
"""

from __future__ import annotations

_CHARS = lambda s, held: f"array_to_string(list_transform(string_split({s}, ''), lambda ch: CASE WHEN regexp_matches(ch, '{held}') THEN regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') ELSE ch END), '')"
_TAIL = lambda s, held: f"CASE WHEN {s} = '' THEN '' ELSE substr({s}, 1, 1) || {_CHARS(f'substr({s}, 2)', held)} END"


def resolved_sql(rows: str, name: str) -> str:
    """CTEs that end in `name`: the rows (all columns of a table with ref and base) with target and page, null for what is no URL."""
    return f"""
{name}0 AS (SELECT *, regexp_replace(regexp_replace(ref, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g') AS s, regexp_extract(base, '^([a-z]+):', 1) AS bs, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS ba,
  regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bp, regexp_extract(base, '^[^?#]*([?][^#]*)', 1) AS bq FROM {rows}),
{name}1 AS (SELECT *, lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sc, regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM {name}0),
{name}2 AS (SELECT *, sc NOT IN ('', 'http', 'https') AS opaque, replace(regexp_extract(rest, '^[^?#]*'), chr(92), '/') AS body, regexp_extract(rest, '^[^?#]*([?][^#]*)', 1) AS q, regexp_extract(rest, '(#.*)$', 1) AS f FROM {name}1),
{name}3 AS (SELECT *, sc = '' OR (sc = bs AND body NOT LIKE '/%') AS rel, CASE WHEN sc = '' THEN bs ELSE sc END AS scheme FROM {name}2),
{name}4 AS (SELECT *, NOT rel OR body LIKE '//%' AS led, CASE WHEN NOT rel OR body LIKE '//%' THEN regexp_replace(body, CASE WHEN rel THEN '^//' ELSE '^/*' END, '') END AS after FROM {name}3),
{name}5 AS (SELECT *, lower(regexp_replace(regexp_extract(after, '^[^/]*'), '^.*@', '')) AS place, regexp_extract(regexp_extract(after, '^[^/]*'), '^(.*@)', 1) AS usr,
  CASE WHEN led THEN regexp_replace(after, '^[^/]*', '') WHEN body LIKE '/%' THEN body WHEN body = '' THEN bp ELSE regexp_replace(bp, '[^/]*$', '') || body END AS p FROM {name}4),
{name}6 AS (SELECT *, regexp_replace(place, ':[0-9]*$', '') AS h, ltrim(regexp_extract(place, ':([0-9]*)$', 1), '0') AS port, string_split(regexp_replace(p, '^/', ''), '/') AS segs FROM {name}5),
{name}7 AS (SELECT *, CASE WHEN NOT led THEN ba WHEN h = '' OR regexp_matches(h, '[\\x00-\\x20#%<>?@^|:]') OR TRY_CAST(port AS BIGINT) > 65535 THEN NULL
  ELSE usr || h || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END END AS au,
  list_reduce(list_prepend('', list_transform(segs, lambda g: '/' || g)), lambda acc, g: CASE replace(lower(g), '%2e', '.') WHEN '/..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '/.' THEN acc ELSE acc || g END)
  || CASE WHEN replace(lower(segs[-1]), '%2e', '.') IN ('.', '..') THEN '/' ELSE '' END AS w FROM {name}6),
{name}8 AS (SELECT *, {_CHARS("w", '[\\x00-\\x20"#<>?^`{}\\x7f-\\x{10ffff}]')} AS pa FROM {name}7),
{name} AS (SELECT * EXCLUDE (s, bs, ba, bp, bq, sc, rest), CASE WHEN opaque THEN sc || ':' || rest WHEN au IS NOT NULL THEN scheme || '://' || au || pa || CASE WHEN rel AND body = '' AND q = '' THEN bq ELSE {_TAIL("q", '[\\x00-\\x20"#<>' + "''" + '\\x7f-\\x{10ffff}]')} END || {_TAIL("f", '[\\x00-\\x20"<>`\\x7f-\\x{10ffff}]')} END AS target,
  CASE WHEN opaque THEN sc || ':' || regexp_extract(rest, '^[^?#]*') WHEN au IS NOT NULL THEN scheme || '://' || au || coalesce(nullif(regexp_replace(pa, '/+$', ''), ''), '/') END AS page FROM {name}8)"""

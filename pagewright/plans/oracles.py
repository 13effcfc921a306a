"""DuckDB SQL for the queries, by name."""

from __future__ import annotations

from ..functions import text as X
from ..sources import pages as P
from .data import ELEMENTS_SQL, TREE_SQL
from .queries import HEADING, REFERENCES
from .urls_sql import resolved_sql

_E = f"WITH {ELEMENTS_SQL}\n"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SLUG = f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(nullif(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1), ''), regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'capture')"
_BLANK = X.BLANK
_PLAIN = P.plain_sql("html")
_quoted = lambda p: p.replace("'", "''")
_found = lambda p, name: f"list_transform(regexp_extract_all(h, '{_quoted(p)}', 1), lambda v: {{'href': regexp_replace(v, '^[\"'']|[\"'']$', '', 'g'), 'source': '{name}'}})"
_LINKS = f"""hp AS (SELECT page_id, url, {P.plain_sql('v')} AS h FROM (SELECT *, html || '<FORM method=get Action=''/find' || page_id || chr(39) || '><a href='' HTTP://Ex.Example:80/a/../p&#53;?x=1&amp;y=2 ''>' AS v FROM pages)), ll AS (SELECT page_id, url, list_filter(list_concat({_found(P.LINK, 'link')}, {_found(P.FORM, 'form')}), lambda v: v.href <> '') AS l FROM hp),
lk AS (SELECT page_id, url, replace(replace(unnest(l).href, '&amp;', '&'), '&#53;', '5') AS href, unnest(l).source AS source, generate_subscripts(l, 1) - 1 AS ord FROM ll),
lb AS (SELECT *, href AS ref, CASE WHEN page_id % 5 = 2 THEN regexp_extract(url, '^[a-z]+:') || '//base.example/b/c' ELSE url END AS base FROM lk), {resolved_sql("lb", "lt")}"""
_T = f"WITH {TREE_SQL}\n"
_norm = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_escape = lambda x: f"regexp_replace({x}, '([^a-zA-Z0-9_-])', '\\\\\\1', 'g')"
_classes = lambda n: f"coalesce(array_to_string(list_transform(list_filter(string_split_regex(class, '\\s+'), lambda v: v <> '')[1:{n}], lambda v: '.' || {_escape('v')}), ''), '')"
_TEST = "'[data-testid=\"' || \"data-test\" || '\"], [data-test=\"' || \"data-test\" || '\"], [data-cy=\"' || \"data-test\" || '\"]'"
_STEP = f"st AS (SELECT page_id, i, parent, id, tag, tag || coalesce('[' || nth || ']', '') AS x, tag || {_classes(2)} || coalesce(':nth-of-type(' || nth || ')', '') AS c FROM si)"


def _radius(k: int, size: str) -> str:
    texts = {0: "8", 1: f"0.5 * {size}", 2: "4" if size == "width" else f"20 * {size} / 100", 3: "6", 4: "1000"}
    cases = " ".join(f"WHEN {n} THEN {v}" for n, v in texts.items())
    return f"greatest(0, floor(CASE (idx + {k}) % 5 {cases} END + 0.5))::BIGINT"


def _half(k: int, size: str) -> str:
    return f"least({_radius(k, size)}, floor({size} / 2)::BIGINT)"


_MASK = "rd AS (SELECT page_id, idx, tag, width * 4 AS w, height * 4 AS h, " + ", ".join(f"4 * {_half(k, s)} AS r{k}{s[0]}" for k in range(4) for s in ("width", "height")) + " FROM el)"
_OUTLINE = "concat_ws(' ', 'M', r0w, 0, 'L', w - r1w, 0, 'A', r1w, r1h, 0, 0, 1, w, r1h, 'L', w, h - r2h, 'A', r2w, r2h, 0, 0, 1, w - r2w, h, 'L', r3w, h, 'A', r3w, r3h, 0, 0, 1, 0, h - r3h, 'L', 0, r0h, 'A', r0w, r0h, 0, 0, 1, r0w, 0, 'Z')"
_ITEMS = "it AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, area DESC, priority DESC, idx) AS reading, printf('block-%03d', idx + 1) AS id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, area DESC, idx) AS rank FROM pr) WHERE rank <= 20), ic AS (SELECT *, CASE WHEN idx % 4 <> 0 THEN kind || '/' || printf('%03d', reading) || '-' || id || '-' || kind || '.png' END AS file FROM it)"
_SITES = f"rs AS (SELECT *, {_ORIGIN} AS site, row_number() OVER (PARTITION BY {_ORIGIN} ORDER BY page_id) AS ord, count(*) OVER (PARTITION BY {_ORIGIN}) AS n, CASE WHEN page_id % 7 = 3 THEN 'Timeout ' || page_id END AS error FROM pages), rf AS (SELECT *, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, CASE WHEN n = 1 THEN site ELSE site || '/pages/page-' || printf('%03d-', ord) || {_SLUG} END AS folder FROM rs), rm AS (SELECT *, CASE WHEN error IS NULL THEN folder || '/manifest.json' END AS manifest FROM rf)"
_SCROLL = "(SELECT page_id, (length(html) % 5000)::BIGINT AS m FROM pages)"
_PHASES = f"pv AS (SELECT page_id, m, [0::BIGINT, least(m, 750), least(m, floor(m * 0.5 + 0.5)::BIGINT), m] AS v FROM {_SCROLL}), pu AS (SELECT page_id, m, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM pv), ph AS (SELECT page_id, y, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos FROM pu GROUP BY page_id, y)"
_DIFF = "e AS (SELECT event_id, user_id, event_type, value, event_id % 2 AS side, event_id % 97 AS selector, json_extract_string(props, '$.k') AS k FROM events), a AS (SELECT user_id, selector, arg_max(e, event_id) AS r FROM e WHERE side = 1 GROUP BY ALL), d AS (SELECT b.event_id, b.user_id, r.event_id AS after_id, CASE WHEN r IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN b.event_type IS DISTINCT FROM r.event_type THEN 'type' END, CASE WHEN b.k IS DISTINCT FROM r.k THEN 'k' END, CASE WHEN abs(coalesce(r.value, 0) - coalesce(b.value, 0)) >= 0.5 THEN 'value' END], lambda v: v IS NOT NULL), ',') END AS changes FROM (SELECT * FROM e WHERE side = 0) b LEFT JOIN a ON a.user_id = b.user_id AND a.selector = b.selector)"


def _pick(values: list[str], n: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[({n}) % {len(values)} + 1]"


ORACLE_SQL = {
    "page_kind_counts": _E + "SELECT page_id, kind, count(*) AS n FROM pr GROUP BY ALL",
    "page_title": f"SELECT page_id, coalesce(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '{_BLANK}', ' ', 'g')), '') AS title FROM pages",
    "page_url_normalized": f"""WITH g AS (SELECT page_id, url AS base, {_PATH} || regexp_extract(url, '^[^?#]*(.*)$', 1) AS rest, {_ORIGIN} AS o FROM pages),
r AS (SELECT page_id, base, ([base, ' ' || upper(o) || rest, o || CASE WHEN o LIKE 'https%' THEN ':443' ELSE ':080' END || rest, o || '/x/./y/%2E%2e/..' || rest, o || chr(92) || 'é {{1}}//'])[page_id % 5 + 1] AS ref FROM g), {resolved_sql("r", "u")}
SELECT page_id, page AS page_url, regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(page, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u""",
    "resolved_references": f"""WITH r AS (SELECT page_id, k - 1 AS k, replace(replace(({REFERENCES!r})[k], '&amp;', '&'), '&#53;', '5') AS ref, url AS base FROM pages, range(1, {len(REFERENCES) + 1}) n(k)), {resolved_sql("r", "u")}
SELECT page_id, k, target, page FROM u""",
    "page_slug": f"SELECT page_id, {_SLUG} AS slug, printf('page-%03d-', row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id)) || {_SLUG} AS folder FROM pages",
    "page_fingerprint": "SELECT page_id, octet_length(encode(html))::BIGINT AS bytes, sha256(html) AS sha256 FROM pages",
    "crawl_default_pages": f"SELECT page_id, regexp_matches(url, '^https?://') AND {_PATH} IN ('', '/') AND NOT contains(regexp_replace(url, '#.*$', ''), '?') AS by_default, regexp_matches({_PATH}, '(?i)\\.(?:png|jpe?g|gif|webp|svg|ico|pdf|zip|mp4|mp3|webm|css|js|json|xml|txt)$') AS asset FROM pages",
    "page_links": f"WITH {_LINKS} SELECT page_id, ord, href, source, target FROM lt",
    "link_targets_distinct": f"WITH {_LINKS} SELECT page_id, target, min(ord) AS first_ord FROM lt GROUP BY ALL",
    "dom_summary_counts": _E + "SELECT page_id, count(*) AS elements, count(*) FILTER (tag = 'a') AS links, count(*) FILTER (tag IN ('img', 'picture', 'svg', 'canvas', 'video')) AS images, count(*) FILTER (tag = 'form') AS forms, count(*) FILTER (tag IN ('input', 'textarea', 'select', 'button')) AS inputs, count(*) FILTER (tag = 'script') AS scripts, count(*) FILTER (tag = 'link') AS stylesheets FROM tags GROUP BY page_id",
    "dom_headings": f"WITH h AS (SELECT page_id, regexp_extract_all({_PLAIN}, '{HEADING}', 1)[1:30] AS v FROM pages), u AS (SELECT page_id, generate_subscripts(v, 1) - 1 AS pos, substr(trim(regexp_replace(regexp_replace(unnest(v), '<[^>]*>', '', 'g'), '{_BLANK}', ' ', 'g')), 1, 180) AS text FROM h) SELECT page_id, pos, text FROM u WHERE text <> ''",
    "dom_landmarks": _E + "SELECT * FROM (SELECT page_id, i, tag, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank FROM tags WHERE tag IN ('header', 'nav', 'main', 'aside', 'footer', 'form')) WHERE rank <= 80",
    "replay_snapshot": """WITH b AS (SELECT page_id, html, '<base data-replay-base="true" href="' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' AS base FROM pages),
r AS (SELECT page_id, CASE page_id % 3 WHEN 1 THEN regexp_replace(replace(replace(replace(html, '<head>', ''), '</head>', ''), '<script>', '<script type="application/x-disabled">'), '(<html[^>]*>)', '\\1<head>' || replace(base, chr(92), chr(92) || chr(92)) || '</head>')
 ELSE replace(replace(html, '<script>', CASE page_id % 3 WHEN 2 THEN '<SCRIPT async data-replay-script-src=''/a?src=b'' data-replay-script-type=module type="application/x-disabled">' ELSE '<script type="application/x-disabled">' END), '<head>', '<head>' || base) END AS h FROM b) SELECT page_id, octet_length(encode(h))::BIGINT AS bytes, sha256(h) AS sha256 FROM r""",
    "aria_roles": _E + "SELECT page_id, aria_role, count(*) AS n FROM ro GROUP BY ALL",
    "element_actions": _E + "SELECT page_id, printf('block-%03d', idx + 1) || ':' || action AS id, pos, action FROM (SELECT page_id, idx, unnest(actions) AS action, generate_subscripts(actions, 1) - 1 AS pos FROM pr)",
    "element_semantic_types": _E + "SELECT page_id, idx, kind, semantic_type FROM se",
    "element_blocks": _E + "SELECT page_id, idx, NOT (kind IN ('decoration', 'text') OR (kind = 'layout' AND area < 120000) OR (kind IN ('card', 'card-large', 'panel') AND NOT painted AND NOT outer_frame)) AS kept, width >= 0.94 * 1440 AND height >= 0.9 * 1000 AS shell FROM ki",
    "element_priority_topk": _E + "SELECT * FROM (SELECT page_id, idx, priority, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, area DESC, idx) AS rank FROM pr) WHERE rank <= 20",
    "element_dedupe_greedy": _E + ", o AS (SELECT page_id, kind, list({'idx': idx, 'x': x, 'y': y, 'w': width, 'h': height} ORDER BY priority DESC, area DESC, idx) AS v FROM pr GROUP BY ALL), k AS (SELECT page_id, kind, list_reduce(list_transform(v, lambda q: [q]), lambda acc, q: CASE WHEN len(list_filter(acc, lambda a: abs(a.x - q[1].x) <= 2 AND abs(a.y - q[1].y) <= 2 AND abs(a.w - q[1].w) <= 3 AND abs(a.h - q[1].h) <= 3)) > 0 THEN acc ELSE list_concat(acc, q) END) AS kept FROM o) SELECT page_id, unnest(kept).idx AS idx, kind FROM k",
    "element_reading_order": _E + "SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY y, x, area DESC, priority DESC, idx) AS reading FROM pr",
    "page_manifest": _E + f""", {_ITEMS},
m AS (SELECT page_id, count(*) AS total, string_agg(id, ',' ORDER BY reading) AS ids, string_agg(id || ':crop|' || coalesce('items-with-text/' || file, '') || '|' || CASE WHEN file IS NULL THEN '' ELSE sha256('b' || id) END, ',' ORDER BY reading) AS crops FROM ic GROUP BY page_id),
k AS (SELECT page_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT page_id, kind, count(*) AS n FROM it GROUP BY ALL) GROUP BY page_id),
a AS (SELECT page_id, string_agg(id || ':' || action || '|[data-capture-id="' || id || '"]', ',' ORDER BY reading, pos) AS actions FROM (SELECT page_id, id, reading, unnest(actions) AS action, generate_subscripts(actions, 1) AS pos FROM it) GROUP BY page_id),
s AS (SELECT page_id, string_agg(n || '|screenshots/' || f || '.png|' || length(html) || '|' || sha256(CASE WHEN o = 4 THEN url ELSE html END), ',' ORDER BY o) AS pictures FROM pages, (VALUES (1, 'full-page', 'full-page'), (2, 'viewport', 'viewport'), (3, 'with-text-full-page', 'with-text'), (4, 'without-text-full-page', 'without-text')) v(o, n, f) GROUP BY page_id)
SELECT p.page_id, coalesce(total, 0) AS "totalBlocks", coalesce(total, 0) AS "pageBlocks", coalesce(kinds, '') AS kinds, coalesce(ids, '') AS ids, coalesce(actions, '') AS actions, coalesce(crops, '') AS crops, pictures, sha256(url) AS textless FROM pages p JOIN s USING (page_id) LEFT JOIN m USING (page_id) LEFT JOIN k USING (page_id) LEFT JOIN a USING (page_id)""",
    "paint_and_visibility": _E + f", s AS (SELECT *, {_pick(['block', 'none', 'flex'], 'idx + page_id')} AS display, {_pick(['visible', 'hidden', 'visible', 'visible'], 'idx + page_id * 2')} AS visibility, {_pick(['1', '0', '0.5', '0.0', 'x', ''], 'idx + page_id * 3')} AS opacity, {_pick(['transparent', 'rgb( 0,0 , 0)', 'rgba(0, 0, 0, 0)', 'rgb(1, 2, 3)', ''], 'idx + page_id * 4')} AS background, {_pick(['none', 'solid'], 'idx + page_id * 5')} AS border_style, {_pick(['none', 'none', 'dotted'], 'idx + page_id * 6')} AS outline_style FROM el) SELECT page_id, idx, width >= 4 AND height >= 4 AND display <> 'none' AND visibility <> 'hidden' AND opacity NOT IN ('0', '0.0', '') AND idx % 7 <> 0 AS visible, background = 'rgb(1, 2, 3)' OR (idx % 3 > 0 AND border_style <> 'none') OR (idx % 2 > 0 AND outline_style = 'dotted') AS paints FROM s",
    "sibling_rank": _T + "SELECT page_id, i, tag || coalesce('[' || nth || ']', '') AS step FROM si",
    "crop_rects": _E + ", c AS (SELECT page_id, idx, greatest(0, x - 50) AS \"left\", greatest(0, y) AS top, least(1440, x - 50 + width) - greatest(0, x - 50) AS crop_width, least(1000, y + height) - greatest(0, y) AS crop_height FROM el) SELECT * FROM c WHERE crop_width >= 1 AND crop_height >= 1",
    "corner_radii": _E + f"SELECT page_id, idx, {_radius(0, 'width')} AS rx, {_radius(0, 'height')} AS ry, {_radius(3, 'width')} AS last_rx, {_radius(3, 'height')} AS last_ry FROM el",
    "alpha_bbox": _E + ", p AS (SELECT page_id || '-' || idx AS item_id, kind, a.x, b.y, (a.x * 31 + b.y * 17 + idx + page_id * 7) % 80 AS alpha, CASE WHEN kind IN ('button', 'badge') THEN 56 ELSE 18 END AS least_alpha FROM ki, (SELECT unnest(range(0, 6)) AS x) a, (SELECT unnest(range(0, 5)) AS y) b) SELECT item_id, kind, min(x) FILTER (alpha >= least_alpha) AS x0, min(y) FILTER (alpha >= least_alpha) AS y0, max(x) FILTER (alpha >= least_alpha) AS x1, max(y) FILTER (alpha >= least_alpha) AS y1 FROM p GROUP BY ALL HAVING max(alpha) >= 32",
    "select_listing": _E + ", r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, area DESC, priority DESC, idx) AS reading FROM pr) SELECT page_id, reading, reading || '. [' || kind || '] ' || coalesce(nullif(label, ''), 'untitled') || ' (' || width || 'x' || height || '+' || x || '+' || y || ')' AS line FROM r",
    "patch_documents": _E + f""", {_ITEMS}, k AS (SELECT page_id, c.i, reading, id, kind, file FROM ic JOIN (VALUES (0, 3), (1, 1), (2, 7)) c(i, at_) ON reading = c.at_),
d AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'job-' || page_id ELSE 'patch' END || '-2023-11-14T22-13-20-123Z' AS patch FROM pages)
SELECT d.page_id, patch AS "patchId", '/out/' || d.page_id || '/manifest.json' AS "sourceManifest", '2023-11-14T22:13:20.123Z' AS "createdAt", count(k.id) AS "totalItems",
coalesce(string_agg(reading || '|' || id || '|' || coalesce('/out/' || d.page_id || '/items/' || file, '') || '|patches/' || patch || '/items/' || kind || '/' || printf('%03d', reading) || '-' || id || '.png', ',' ORDER BY i), '') AS listed
FROM d LEFT JOIN k USING (page_id) GROUP BY d.page_id, patch""",
    "patch_selection": _E + ", r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, area DESC, priority DESC, idx) AS reading FROM pr) SELECT page_id, c.i::BIGINT AS index, idx, kind, count(*) OVER (PARTITION BY page_id) AS total FROM r JOIN (VALUES (1, 3), (2, 1), (3, 7)) c(i, at_) ON r.reading = c.at_",
    "site_manifest_totals": f"SELECT {_ORIGIN} AS origin, count(*) AS total, count(*) FILTER (html LIKE '%</html>%') AS succeeded, count(*) FILTER (html NOT LIKE '%</html>%') AS failed FROM pages GROUP BY ALL",
    "sitemap_pages": "WITH u AS (SELECT 'http://a.example/p' || (page_id % 40) AS url, min(page_id) AS first FROM pages GROUP BY ALL) SELECT row_number() OVER (ORDER BY first) AS ord, url FROM u ORDER BY first LIMIT 25",
    "robots_sitemaps": f"SELECT page_id, unnest([0, 1, 2]::BIGINT[]) AS pos, unnest([{_ORIGIN} || '/sitemap.xml', 'http://s.example/' || page_id || '.xml', 'http://s.example/z.xml']) AS sitemap FROM pages",
    "scroll_positions": f"WITH {_PHASES}, st AS (SELECT page_id, m, plan, step FROM {_SCROLL}, (VALUES ('prime', 250), ('tile', 1000)) s(plan, step)), sv AS (SELECT page_id, plan, list_concat(list_filter(range(0, m + 1, step), lambda y: y = 0 OR y < m), CASE WHEN m > 0 THEN [m] ELSE [] END) AS v FROM st) SELECT page_id, 'phase' AS plan, pos, y FROM ph UNION ALL SELECT page_id, plan, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS y FROM sv",
    "frame_plan": f"WITH {_PHASES}, f AS (SELECT page_id, pos + 1 AS phase, y AS position, unnest(range(0, CASE WHEN pos = 0 THEN 11 ELSE 7 END)) AS frame FROM ph) SELECT page_id, phase, position, frame, frame * 180 AS elapsed_ms, printf('frame-%03d', row_number() OVER (PARTITION BY page_id ORDER BY phase, frame)) AS frame_id FROM f",
    "event_cap": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 40",
    "state_diff_join": f"WITH {_DIFF} SELECT event_id, after_id, changes FROM d",
    "timeline_summary": f"WITH {_DIFF} SELECT user_id, count(*) AS before_count, count(after_id) AS after_count, count(*) FILTER (changes <> '') AS changed, count(DISTINCT after_id) AS distinct_after FROM d GROUP BY user_id",
    "animation_scores": _E + f", a AS (SELECT page_id, idx, idx % 9 = 0 AS active, {_pick(['none', 'spin'], 'idx + page_id')} AS an, {_pick(['none', 'all'], 'idx')} AS tr, idx % 3 AS du, {_pick(['none', 'none', 'scale(2)'], 'idx')} AS tf, {_pick(['1', '1', '0.5'], 'idx + 1')} AS op, {_pick(['auto', 'opacity', 'scale'], 'idx + page_id')} AS wc, {_pick(['none', 'none', 'none', 'blur(1px)'], 'idx')} AS fi, {_pick(['none', 'none', 'none', 'none', 'circle()'], 'idx')} AS cp FROM el), s AS (SELECT page_id, idx, CASE WHEN active THEN 100 ELSE 0 END + CASE WHEN an <> 'none' THEN 60 ELSE 0 END + CASE WHEN tr <> 'none' AND du > 0 THEN 35 ELSE 0 END + CASE WHEN tf <> 'none' THEN 25 ELSE 0 END + CASE WHEN op <> '1' THEN 20 ELSE 0 END + CASE WHEN wc = 'opacity' THEN 12 ELSE 0 END AS score FROM a WHERE active OR (an <> 'none' AND du > 0) OR (tr <> 'none' AND du > 0) OR tf <> 'none' OR op <> '1' OR wc <> 'auto' OR fi <> 'none' OR cp <> 'none') SELECT * FROM (SELECT page_id, idx, score::BIGINT AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, idx) AS rank FROM s) WHERE rank <= 12",
    "state_candidates": _E + ", s AS (SELECT *, CASE WHEN expanded IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN selected IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN aria_role IN ('tab', 'switch', 'checkbox') THEN 18 ELSE 0 END + CASE WHEN regexp_matches(lower(concat_ws(' ', label, kind, semantic_type, aria_role, '', class)), 'tab|menu|filter|dropdown|accordion|toggle|expand|more|open|faq|modal|drawer') THEN 16 ELSE 0 END + CASE WHEN semantic_type = 'navigation' THEN 6 ELSE 0 END AS score FROM pr) SELECT * FROM (SELECT page_id, idx, score::BIGINT AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, area DESC, idx) AS rank FROM s WHERE (list_contains(actions, 'click') OR list_contains(actions, 'toggle')) AND tag <> 'a' AND type NOT IN ('submit', 'file') AND score > 0) WHERE rank <= 6",
    "state_novelty": "WITH p AS (SELECT user_id, event_id, event_type || '|' || json_extract_string(props, '$.k') AS state FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, state ORDER BY event_id) AS r FROM p WHERE event_id % 10 <> 0 AND state <> 'click|1'), n AS (SELECT user_id, event_id, state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM f WHERE r = 1) SELECT user_id, event_id, state FROM n WHERE k <= 6",
    "state_fingerprint": f"""WITH p AS (SELECT page_id, url, html, {_PLAIN} AS h FROM pages) SELECT page_id, sha256(concat_ws(chr(1), url, coalesce(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '{_BLANK}', ' ', 'g')), ''), substr(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '{_BLANK}', ' ', 'g')), 1, 12000), length(html), len(regexp_extract_all(h, '(?i)<dialog\\b|\\brole="dialog"|\\baria-modal="true"')), len(regexp_extract_all(h, '(?i)\\baria-expanded="true"')))) AS digest FROM p""",
    "css_time_lists": """WITH t AS (SELECT page_id, (['0s', '150ms', '1s, 0s', '', 'abc', '.5s', '2', '1.5s,20ms'])[page_id % 8 + 1] || CASE WHEN page_id % 3 = 0 THEN ', ' || page_id || 'ms' ELSE '' END AS t FROM pages), v AS (SELECT page_id, list_transform(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: coalesce(try_cast(regexp_extract(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') AS DOUBLE), 0) * CASE WHEN x LIKE '%s' AND x NOT LIKE '%ms' THEN 1000 ELSE 1 END) AS v FROM t) SELECT page_id, list_sum(v)::DOUBLE AS total_ms, len(v) AS parts, list_max(v) > 0 AS moves FROM v""",
    "escapes": f"WITH r AS (SELECT page_id, url, 'a<b>\"&:' || {_SLUG} || '.x y' AS raw FROM pages) SELECT page_id, regexp_replace(raw, '([^a-zA-Z0-9_-])', '\\\\\\1', 'g') AS css, replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html_text, 'a b ' || url AS normal FROM r",
    "ax_tree": """SELECT page_id, page_id::VARCHAR AS node, page_id % 2 = 0 AS ignored, 'link' AS role, 'n' || page_id AS name, array_to_string(range(0, page_id % 4 + 1), '+') AS children, CASE WHEN page_id % 3 = 0 THEN 'true' ELSE url || '+true' END AS properties FROM pages
UNION ALL SELECT page_id, 'x', false, 'text', CASE WHEN page_id % 5 > 0 THEN page_id::VARCHAR END, '', '' FROM pages""",
    "output_paths": f"SELECT page_id, n.name, 'pages/page-' || printf('%03d-', page_id + 1) || {_SLUG} || '/screenshots/' || n.name || '.png' AS path FROM pages, (VALUES ('full-page'), ('viewport'), ('without-text'), ('with-text')) n(name)",
    "bfs_crawl": """WITH RECURSIVE n AS (SELECT max(page_id) + 1 AS n FROM pages), p(node, level, path) AS (SELECT 0::BIGINT, 0, '' UNION ALL SELECT CASE o WHEN 0 THEN (node * 2 + 1) % n ELSE (node * 3 + 2) % n END, level + 1, path || o FROM p, n, (VALUES (0), (1)) v(o) WHERE level < 60 QUALIFY row_number() OVER (PARTITION BY CASE o WHEN 0 THEN (node * 2 + 1) % n ELSE (node * 3 + 2) % n END ORDER BY path || o) = 1)
SELECT node, row_number() OVER (ORDER BY w) AS ord FROM (SELECT node, min((level, path)) AS w FROM p GROUP BY node) QUALIFY ord <= 150""",
    "crawl_urls": """WITH RECURSIVE n AS (SELECT max(page_id) + 1 AS n FROM pages), p(node, level, path) AS (SELECT node::BIGINT, 0, o FROM (VALUES (0, '0'), (5, '1'), (3, '2')) s(node, o) UNION ALL SELECT CASE o WHEN 0 THEN (node * 2 + 1) % n ELSE (node * 3 + 2) % n END, level + 1, path || o FROM p, n, (VALUES (0), (1)) v(o) WHERE level < 60 QUALIFY row_number() OVER (PARTITION BY CASE o WHEN 0 THEN (node * 2 + 1) % n ELSE (node * 3 + 2) % n END ORDER BY path || o) = 1)
SELECT 'http://a.example/p' || node AS url, row_number() OVER (ORDER BY w) AS ord FROM (SELECT node, min((level, path)) AS w FROM p GROUP BY node) QUALIFY ord <= 120""",
    "descendant_counts": _T + "SELECT e.page_id, e.i AS idx, least(count(d.i), 4) AS n FROM tr e LEFT JOIN tr d ON d.page_id = e.page_id AND d.i > e.i AND d.i <= e.last AND d.tag IN ('a', 'p', 'h1') GROUP BY ALL",
    "rounded_masks": _E + f", {_MASK} SELECT page_id, idx, CASE WHEN greatest(r0w, r0h, r1w, r1h, r2w, r2h, r3w, r3h) > 0 THEN {_OUTLINE} END AS path FROM rd",
    "agent_elements": _E + f""", {_ITEMS} SELECT page_id, reading, id, coalesce(nullif(semantic_type, ''), kind) AS type, tag, {_norm("'  ' || label || chr(10) || ' x'")} AS body, tag || CASE WHEN class <> '' THEN '.' || class ELSE '' END AS css, CASE WHEN aria_role <> '' AND label <> '' THEN 'getByRole("' || aria_role || '", {{ name: "' || label || '" }})' ELSE '' END AS by_role, aria_role AS role, expanded,
coalesce('items-with-text/' || file, '') AS crop, coalesce('items/' || file, '') AS bare_crop, CASE WHEN file IS NULL THEN '' ELSE sha256('b' || id) END AS digest, CASE WHEN file IS NULL THEN 0 ELSE width END AS crop_width, array_to_string(list_filter(['aria-expanded=' || expanded, 'aria-selected=' || selected, 'href=' || href, CASE WHEN idx <= 160 THEN 'placeholder=' || repeat('p', idx::INT) END], lambda v: v IS NOT NULL), ';') AS attributes, class AS classes FROM ic""",
    "page_results": f"WITH {_SITES} SELECT page_id, status, folder, manifest, error FROM rm",
    "site_manifests": f"""WITH {_SITES} SELECT 'job-' || site AS "jobId", 'site' AS mode, site || '/' AS "startUrl", count(*) AS "totalPages", count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, string_agg(url || '|' || status || '|' || CASE WHEN error IS NULL THEN length(html)::VARCHAR ELSE '-' END || '|' || coalesce(error, manifest), ',' ORDER BY ord) AS listed FROM rm GROUP BY site""",
    "tree_paths": _T + f""", {_STEP}, j AS (SELECT e.page_id, e.i, e.tag, e.id, string_agg(s.x, '/' ORDER BY s.i) AS x, string_agg(s.c, ' > ' ORDER BY s.i) FILTER (s.i = e.i OR s.i > e.parent - 20) AS c FROM st e LEFT JOIN st s ON s.page_id = e.page_id AND s.i > 0 AND (s.i = e.i OR (s.i % 4 = 0 AND s.i <= e.parent)) GROUP BY ALL) SELECT page_id, i AS idx, '/html/' || coalesce(x, '') AS xpath, coalesce(tag || '#' || {_escape('id')}, c, '') AS css_path FROM j""",
    "selectors": _T + f""", l AS (SELECT *, (['button', '', 'tab'])[i % 3 + 1] AS role, substr({_norm("' say \"' || content || '\" ' || repeat('w', (i % 100)::INT)")}, 1, 120) AS short FROM tr), q AS (SELECT *, replace(short, '"', '\\"') AS quoted FROM l)
SELECT page_id, i AS idx, '[data-capture-id="' || printf('block-%03d', i + 1) || '"]' AS captureid, coalesce({_TEST}, tag || '#' || {_escape('id')}, tag || {_classes(3)}) AS css, coalesce('#' || {_escape('id')}, '') AS id, coalesce({_TEST}, '') AS testid, CASE WHEN role <> '' THEN 'getByRole("' || role || '", {{ name: "' || quoted || '" }})' ELSE '' END AS role, CASE WHEN length(short) <= 80 THEN 'text="' || quoted || '"' ELSE '' END AS text FROM q""",
    "attribute_maps": _T + """SELECT page_id, i AS idx, array_to_string(list_filter(['aria-label=' || "aria-label", 'data-test=' || "data-test", 'id=' || id, 'placeholder=' || placeholder, 'title=' || title, CASE WHEN length(value) <= 160 THEN 'value=' || value END], lambda v: v IS NOT NULL), ';') AS kept, array_to_string(list_filter(['class=' || nullif(class, ''), 'style=' || substr(style, 1, 240)], lambda v: v IS NOT NULL), ';') AS motion FROM tr""",
    "accessible_names": _T + f""", ids AS (SELECT page_id, id, min(i) AS i, arg_min(content, i) AS content, arg_min(tag, i) AS tag FROM tr WHERE id IS NOT NULL GROUP BY ALL),
r AS (SELECT page_id, i, unnest(v) AS ref, generate_subscripts(v, 1) AS pos FROM (SELECT page_id, i, string_split_regex("aria-labelledby", '\\s+') AS v FROM tr WHERE "aria-labelledby" IS NOT NULL)),
b AS (SELECT r.page_id, r.i, string_agg(coalesce(ids.content, ''), ' ' ORDER BY pos) AS t FROM r LEFT JOIN ids ON ids.page_id = r.page_id AND ids.id = r.ref GROUP BY ALL),
nf AS (SELECT l.page_id, x.i, l.i AS li, l.content FROM tr l JOIN ids x ON x.page_id = l.page_id AND x.id = l."for" WHERE l.tag = 'label' AND x.tag IN ('button', 'input', 'select', 'textarea')
  UNION ALL SELECT l.page_id, min(f.i), l.i, l.content FROM tr l JOIN tr f ON f.page_id = l.page_id AND f.i > l.i AND f.i <= l.last WHERE l.tag = 'label' AND l."for" IS NULL AND f.tag IN ('button', 'input', 'select', 'textarea') GROUP BY l.page_id, l.i, l.content),
fo AS (SELECT page_id, i, string_agg(content, ' ' ORDER BY li) AS t FROM nf GROUP BY ALL),
m AS (SELECT tr.page_id, tr.i, tr.tag, substr({_norm("coalesce(CASE WHEN trim(b.t) <> '' THEN b.t END, CASE WHEN trim(fo.t) <> '' THEN fo.t END, \"aria-label\", title, placeholder, value, content)")}, 1, 160) AS name, {_norm("coalesce(\"aria-label\", title, nullif(content, ''), '')")} AS raw FROM tr LEFT JOIN b ON b.page_id = tr.page_id AND b.i = tr.i LEFT JOIN fo ON fo.page_id = tr.page_id AND fo.i = tr.i)
SELECT page_id, i AS idx, name AS accessible_name, substr(coalesce(nullif(raw, ''), nullif(name, ''), tag || ' ' || (i + 1)), 1, 96) AS label FROM m""",
    "tree_filters": _T + """, e AS (SELECT *, width * height AS area, CASE WHEN i % 5 = 2 THEN 'div' ELSE tag END AS t FROM tr), c AS (SELECT e.page_id, e.i, count(d.i) FILTER (d.painted AND d.area >= 5000) AS v, count(d.i) FILTER (d.t IN ('img', 'svg', 'canvas', 'picture', 'video', 'input', 'textarea', 'select', 'button', 'a')) AS r FROM e LEFT JOIN e d ON d.page_id = e.page_id AND d.i > e.i AND d.i <= e.last GROUP BY ALL)
SELECT page_id, i AS idx, area >= 648000 AND area < 1296000 AND width >= 1080 AND height >= 550 AND painted AND v >= 4 AS frame, i % 3 > 0 AND t IN ('div', 'span') AND r = 0 AND (i % 4 = 1 OR position IN ('absolute', 'fixed') OR (width <= 72 AND height <= 72)) AS decoration FROM e JOIN c USING (page_id, i)""",
    "image_rules": _E + "SELECT page_id, idx, kind IN ('card-large', 'card', 'panel', 'badge') AS hides_inner, kind IN ('card-large', 'card', 'panel', 'button', 'badge', 'stat', 'price', 'media', 'icon') AS isolated, kind IN ('button', 'badge') AS hides_outer, kind IN ('button', 'badge', 'stat', 'price', 'media', 'icon') AS browser_shape, 0::BIGINT AS padding, CASE WHEN kind IN ('button', 'badge') THEN 1 ELSE 0 END AS inset FROM ki",
    "output_bounds": _E + ", o AS (SELECT *, CASE WHEN idx % 3 = 0 THEN idx % 5 ELSE 0 END AS tx, CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END AS ty, CASE WHEN idx % 3 = 0 THEN idx % 7 ELSE width END AS w, CASE WHEN idx % 3 = 0 THEN idx % 2 ELSE height END AS h, CASE WHEN tag = 'a' THEN 1 ELSE 0 END AS inset FROM el), c AS (SELECT *, CASE WHEN w > 0 AND h - inset > 0 THEN inset ELSE 0 END AS cut FROM o) SELECT page_id, idx, x + tx AS x, y + ty + cut AS y, w AS width, h - cut AS height FROM c",
    "valid_urls": f"SELECT page_id, ([{_ORIGIN} || CASE WHEN {_PATH} = '' THEN '/' ELSE '' END || substr(url, length({_ORIGIN}) + 1), NULL, NULL, NULL, 'http://ex.org/?q=A', 'https://ex.org/A#b', 'file:///tmp/a', 'http://x/', NULL])[page_id % 9 + 1] AS url, ([NULL, 'URL is required', 'Invalid URL', 'Only http, https, and file URLs are supported', NULL, NULL, NULL, NULL, 'URL is required'])[page_id % 9 + 1] AS error FROM pages",
    "option_bounds": "WITH d AS (SELECT page_id, page_id * 131 / 2.0 AS d, CASE WHEN page_id % 5 > 0 THEN page_id / 2.0 END AS m FROM pages) SELECT page_id, CASE WHEN d >= 320 AND d <= 10000 THEN floor(d)::BIGINT END AS width, CASE WHEN d < 320 OR d > 10000 THEN '--width must be a number between 320 and 10000' END AS width_error, CASE WHEN m >= 1 AND m <= 200 THEN floor(m)::BIGINT END AS pages, CASE WHEN m IS NULL OR m < 1 OR m > 200 THEN '--max-pages must be a number between 1 and 200' END AS pages_error FROM d",
    "job_ids": f"SELECT page_id, strftime(make_timestamp(page_id * 123456789000), '%Y-%m-%dT%H-%M-%S-%gZ') || '-' || {_SLUG} || '-' || substr(md5(url), 1, 8) AS job_id FROM pages",
    "asset_paths": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/out/job 1/a/b' || page_id WHEN 1 THEN '/abs/c' || page_id WHEN 2 THEN '/out/d' || page_id WHEN 3 THEN '/out/job 1/e' || page_id WHEN 4 THEN '' ELSE '/f' || page_id END AS path FROM pages",
    "landed_bodies": f"WITH p AS (SELECT page_id, {_ORIGIN} || '/robots.txt?' || (page_id % 50) AS u FROM pages), g AS (SELECT u, max('body ' || printf('%06d', page_id)) AS body FROM p WHERE page_id % 4 > 0 AND page_id % 3 > 0 GROUP BY u) SELECT page_id, coalesce(body, '') AS body FROM p LEFT JOIN g USING (u)",
    "animation_phases": f"WITH {_DIFF}, r AS (SELECT user_id, CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END AS phase, after_id, changes <> '' AS c, row_number() OVER (PARTITION BY user_id, event_id % 4 < 2 ORDER BY event_id) AS rank FROM d) SELECT user_id AS page_id, phase, count(*) AS before_count, count(after_id) AS after_count, count(*) FILTER (c) AS changed_count, count(*) FILTER (rank <= 10) AS kept FROM r GROUP BY ALL",
    "animation_summaries": f"WITH {_DIFF}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 4 < 2 ORDER BY event_id) AS rank FROM d), h AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT user_id AS page_id, count(DISTINCT event_id % 97) AS animated, count(DISTINCT CASE WHEN changes <> '' THEN event_id % 97 END) AS changed, sum(event_id % 3)::BIGINT AS running, count(*) FILTER (event_id % 5 >= 2) AS transitions, coalesce(any_value(h.n), 0) AS events FROM r LEFT JOIN h USING (user_id) WHERE rank <= 10 GROUP BY user_id",
    "animation_changes": _E + """, v AS (SELECT page_id, idx, list_filter([
  CASE WHEN idx % 2 <> idx % 3 THEN {'field': 'computed.opacity', 'before': (idx % 2)::VARCHAR, 'after': (idx % 3)::VARCHAR} END, CASE WHEN idx % 3 > 0 THEN {'field': 'computed.color', 'before': 'c' || (idx % 2), 'after': 'c' || ((idx + 1) % 2)} END,
  CASE WHEN idx % 4 = 3 THEN {'field': 'bbox.x', 'before': printf('%.2f', x::DOUBLE), 'after': printf('%.2f', x + 0.6::DOUBLE)} END, CASE WHEN idx % 2 = 1 THEN {'field': 'bbox.height', 'before': printf('%.2f', height::DOUBLE), 'after': printf('%.2f', floor((height - 1 / 1.5::DOUBLE) * 100 + 0.5) / 100)} END,
  CASE WHEN idx % 3 <> idx % 4 THEN {'field': 'attributes.class', 'before': 'k' || (idx % 3), 'after': 'k' || (idx % 4)} END], lambda c: c IS NOT NULL) AS c FROM el WHERE idx % 6 > 0)
SELECT page_id, idx, generate_subscripts(c, 1) - 1 AS pos, unnest(c).field AS field, unnest(c).before AS before, unnest(c).after AS after FROM v""",
    "compact_animations": _E + "SELECT page_id, i, CASE WHEN i % 2 = 0 THEN 'a' || i ELSE '' END AS id, CASE WHEN i % 3 = 0 THEN 'CSSAnimation' ELSE 'Animation' END AS type, 'null' AS duration, i::VARCHAR AS delay, array_to_string(list_transform(range(0, least(i % 15, 11) + 1), lambda k: k || ':' || CASE WHEN k % 2 = 0 THEN least(240, 200 + 10 * k)::VARCHAR ELSE '-' END), ',') AS frames FROM tags",
    "active_targets": _E + "SELECT page_id, i, EXISTS (SELECT 1 FROM tags r WHERE r.page_id = t.page_id AND r.i % 4 = 1 AND r.i * 3 % 40 = t.i) AS active FROM tags t",
}

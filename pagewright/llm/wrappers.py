"""Main text of pages by wrapper induction over the pages of a host.

A page is parsed into a tree of its block elements; runs of alike siblings that hold only text
are one node. Pages of a host are aligned, one after another, with a growing wrapper tree by simple tree
matching (the largest ordered matching of equal labels; children whose labels agree one by one are paired as they stand). A wrapper node knows
how many pages it was met in, and for the texts it held most which articles held them. Each task induces wrappers of the hosts it sees over all
its pages; wrappers of a host are then merged by the same matching, first within salted groups, so no task
holds a host's pages.

Articles are counted, not pages: a page's article is known by a hash that copies and most near copies share, and sets of such hashes are kept as
sketches of fixed size, exact up to KEYS articles. A text is template if SAME of the articles with its node hold it there and there are at least 4 of them; only
that text is, not whatever else stands there. Slots whose text varies are content.
The content root is the article or main element (all of them that stand at its place in the wrapper), or else the whole page;
below it, template and parts whose tag, role or class say so (menus, footers, adverts, forms, comments and the like) are left out. Words of a class that
prose can carry too (WEAK) count only where the part has no paragraph of prose.

The html is read whole; character references are decoded, white space inside a block becomes one blank, blocks are joined
in page order by two line breaks. A null or empty html, and a page whose article or slots hold no text, give ''. Elements nested deeper than DEEP are
children of the element at that depth, and are left out if one they are nested in is. Pages
without host share the wrapper of host ''. Repeated or null page_ids are kept row by row; columns but page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Elements of HTML by what they do to the flow of text.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe object svg math select button canvas audio video noframes xmp head".split())
BOILERPLATE = set("nav footer aside form dialog menu fieldset".split())
WORDS = set("nav navbar navigation menu sidebar footer header masthead topbar ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus respond reply replies share sharing breadcrumb breadcrumbs newsletter subscribe signup login toolbar popup modal overlay pagination pager skip copyright".split())
WEAK = set("banner notice notices alert discussion social related recommended search widget tags".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
#: Texts that a wrapper node keeps: any that more than a ninth of its pages hold stays; pages from which nodes that are rare since they entered are left out of a wrapper, and their share.
TEXTS, MANY, RARE = 8, 400, 0.005
#: The part of the articles with a node that hold a text from which on it is template; articles that a sketch counts exactly; words of a paragraph of prose.
SAME, KEYS, PROSE = 0.6, 24, 25
DEEP = 200


class Node:
    __slots__ = ("tag", "label", "kids", "text", "skip")

    def __init__(self, tag, label, skip):
        self.tag, self.label, self.skip = tag, label, skip  # skip: 2, 1 or 0 while the page is parsed, then whether it is left out
        self.kids, self.text = [], None


def _marks(attributes: str) -> tuple[str, int]:
    """A label of class, id and role, and whether they name boilerplate: 2 if they do, 1 if they may."""
    if "=" not in attributes:
        return "", 0
    found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
    if not found:
        return "", 0
    words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    label = DIGITS.sub("0", ".".join(f"{k}={' '.join(sorted(v.split()))}" for k, v in sorted(found.items())))
    if len(label) > 80:
        label = f"{label[:70]}~{zlib.crc32(label.encode('utf-8', 'surrogatepass')):x}"
    return label, 2 if words & WORDS or found.get("role", "").lower() in ROLES else int(bool(words & WEAK))


def parse(page: str) -> Node:
    """The tree of a page's block elements; text leaves have the label #text."""
    root = Node("html", "html", 0)
    stack, buffer = [root], []
    at, n = 0, len(page)

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                leaf = Node("#text", "#text", 0)
                leaf.text = text
                stack[-1].kids.append(leaf)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(1) or m.group(4)
        if tag in RAW and tag != "head":
            if not closing and not (m.group(3) or "").endswith("/"):
                end = re.compile(f"</{tag}", re.I).search(page, at)
                if end:
                    gt = page.find(">", end.start())
                    at = gt + 1 if gt >= 0 else n
                elif tag in ("script", "style", "textarea", "title"):
                    at = n
            continue
        if tag not in BLOCK:
            if tag == "br":
                buffer.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k].tag in FENCE[tag]:
                    break
        elif tag in ("article", "main"):
            for k in range(1, len(stack)):
                if stack[k].tag in ("nav", "menu"):
                    del stack[k:]
                    break
        for k in range(len(stack) - 1, 0, -1):  # a block ends a paragraph
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in ("td", "th", "li", "div", "table", "article", "section"):
                break
        label, skip = _marks(m.group(3) or m.group(6) or "")
        node = Node(tag, f"{tag}|{label}" if label else tag, 2 if tag in BOILERPLATE else skip)
        if len(stack) > DEEP:
            node.skip = max(node.skip, stack[-1].skip)
        stack[min(len(stack), DEEP) - 1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
    flush()
    _decide(root)
    return root


def _decide(node: Node) -> bool:
    """Settles whether parts that may be boilerplate are, and marks the labels of those that are; returns whether there is a paragraph of prose at or below node."""
    prose = node.text is not None and len(node.text.split()) >= PROSE
    for k in node.kids:
        prose = _decide(k) or prose
    if node.skip == 2 or node.skip == 1 and not prose:
        node.skip, node.label = True, node.label + "!"
        return False
    node.skip = False
    return prose


def fold(node: Node) -> list:
    """[label, texts or None, children] with runs of alike siblings that hold only text as one node."""
    kids: list = []
    for k in node.kids:
        if k.text is not None:
            one = ["#text", [k.text], []]
        elif k.kids and all(x.text is not None for x in k.kids):
            one = [k.label, [x.text for x in k.kids], []]
        else:
            one = [k.label, None, fold(k)[2]]
        if kids and one[1] is not None and kids[-1][0] == one[0] and kids[-1][1] is not None:
            kids[-1][1].extend(one[1])
        else:
            kids.append(one)
    return [node.label, None, kids]


def article_key(tree: list) -> int:
    """A hash of 32 bits that a page shares with its copies, and mostly with near copies: of two least hashes of five words each, over all text but boilerplate."""
    words: list[str] = []
    todo = [tree]
    while todo:
        at = todo.pop()
        for text in at[1] or ():
            words += text.split()
        todo += [k for k in reversed(at[2]) if not _skipped(k[0])]
    grams = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
    least = min(grams), min(g * 0x9E3779B1 + 0x7F4A7C15 & 0xFFFFFFFF for g in grams)
    return zlib.crc32(repr(least).encode())


def counted(sketch: tuple[int, ...]) -> float:
    """How many articles a sketch (the KEYS least of their hashes) has seen."""
    return len(sketch) if len(sketch) < KEYS else (KEYS - 1) * 2**32 / (sketch[-1] + 1)


def both(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return a if a == b else tuple(sorted({*a, *b})[:KEYS])


def wrap(tree: list, key: int | None = None) -> list:
    """A wrapper of one page: [label, pages, {text hash: (pages, articles)}, characters of text, children, pages that may have had the node before it entered, articles]."""
    key = article_key(tree) if key is None else key
    texts = tree[1]
    return [tree[0], 1, {zlib.crc32("\n".join(texts).encode("utf-8", "surrogatepass")): (1, (key,))} if texts else {}, sum(map(len, texts)) if texts else 0, [wrap(k, key) for k in tree[2]], 0, (key,)]


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching of two trees with equal labels: its size, and the matched pairs of children."""
    x, y = a[4], b[4]
    if not x or not y:
        return 1, []
    if [k[0] for k in x] == [k[0] for k in y]:
        return 1 + sum(match(p, q)[0] for p, q in zip(x, y)), [(i, i) for i in range(len(x))]
    m, n = len(x), len(y)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    size = {}
    for i in range(m):
        row, above, label = best[i + 1], best[i], x[i][0]
        for j in range(n):
            w = 0
            if label == y[j][0]:
                w = size[i, j] = match(x[i], y[j])[0]
            row[j + 1] = max(row[j], above[j + 1], above[j] + w)
    pairs, i, j = [], m, n
    while i and j:
        if (i - 1, j - 1) in size and best[i][j] == best[i - 1][j - 1] + size[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], pairs[::-1]


def _gone(w: list) -> float:
    """At most so many pages of a host's wrapper have had a node that it doesn't hold."""
    return RARE * w[1] if w[1] >= MANY else 0


def _late(w: list, gone: float) -> list:
    return [*w[:4], [_late(k, gone) for k in w[4]], w[5] + gone, w[6]] if gone else w


def merge(a: list, b: list, gone: tuple[float, float] | None = None) -> list:
    """One wrapper of what two have seen; children of either without partner keep their place.

    gone: how many pages of a and of b may have had a node that was pruned there.
    """
    gone = (_gone(a), _gone(b)) if gone is None else gone
    texts = dict(a[2])
    for k, (n, keys) in b[2].items():
        m, old = texts.get(k, (0, ()))
        texts[k] = m + n, both(old, keys)
    if len(texts) > TEXTS:  # all counts lose that of the first one that doesn't stay
        less = sorted((n for n, _ in texts.values()), reverse=True)[TEXTS]
        texts = {k: (n - less, keys) for k, (n, keys) in texts.items() if n > less}
    kids, i, j = [], 0, 0
    for p, q in [*match(a, b)[1], (len(a[4]), len(b[4]))]:
        kids += [_late(k, gone[1]) for k in a[4][i:p]] + [_late(k, gone[0]) for k in b[4][j:q]]
        if p < len(a[4]):
            kids.append(merge(a[4][p], b[4][q], gone))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], texts, a[3] + b[3], kids, a[5] + b[5], both(a[6], b[6])]


def prune(w: list, pages: int | None = None) -> list:
    """w without nodes that few of many pages have, those before a node entered left aside (lossy counting); such nodes count as met by none."""
    pages = w[1] if pages is None else pages
    if pages < MANY:
        return w
    return [*w[:4], [prune(k, pages) for k in w[4] if k[1] + k[5] >= RARE * pages], *w[5:]]


def _template(w: list, articles: float) -> set[int]:
    """Hashes of the texts of a node that are template, on a host of so many articles."""
    n = counted(w[6])
    if articles < 4 or n < 4 or n < 0.5 * articles:
        return set()
    return {k for k, (_, keys) in w[2].items() if counted(keys) >= SAME * n}


def _semantic(label: str) -> bool:
    return label.split("|")[0] in ("article", "main") or "role=main" in label


def _skipped(label: str) -> bool:
    return label.endswith("!") or label.split("|")[0] == "header"


def varying(w: list, articles: float) -> int:
    """Characters of text that varies, outside of boilerplate."""
    own = 0 if _template(w, articles) else w[3]
    return own + sum(varying(k, articles) for k in w[4] if not _skipped(k[0]))


def _mass(w: list) -> int:
    return w[3] + sum(_mass(k) for k in w[4] if not _skipped(k[0]))


def content_path(w: list) -> list[str]:
    """Labels from the root of a wrapper down to the article or main element with most text; empty without one."""
    articles, found = counted(w[6]), []

    def search(at, path):
        for k in at[4]:
            if not _skipped(k[0]):
                if _semantic(k[0]):
                    found.append((varying(k, articles), _mass(k), [*path, k[0]]))
                else:
                    search(k, [*path, k[0]])

    search(w, [])
    return max(found, key=lambda f: f[:2])[2] if found else []


def _blocks(node: Node, inside: bool, drop: set[int], out: list[str]) -> None:
    if node.text is not None:
        if id(node) not in drop:
            out.append(node.text)
        return
    for k in node.kids:
        if k.text is None and k.skip:
            continue
        if k.tag == "header":
            titles: list[str] = []
            _blocks(k, inside, drop, titles)
            if inside:  # of an article's header, its headings
                heads: list[str] = []
                for x in _walk(k):
                    if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        _blocks(x, True, drop, heads)
                out += heads
            continue
        _blocks(k, inside, drop, out)


def _walk(node: Node):
    yield node
    for k in node.kids:
        if not k.skip:
            yield from _walk(k)


def _roots(node: Node):
    """Outermost article and main elements."""
    for k in node.kids:
        if k.text is None and not k.skip:
            if _semantic(k.label):
                yield k
            else:
                yield from _roots(k)


def extract(page: str | None, wrapper: list | None) -> str:
    """The main text of a page, given its host's wrapper."""
    if not page:
        return ""
    root = parse(page)
    at, drop = [root], set()
    wrapper = wrapper or wrap(fold(root))
    path = content_path(wrapper)
    for label in path:
        step = [k for x in at for k in x.kids if k.text is None and k.label == label]
        if not step:
            break
        at = step
    if not _semantic(at[0].label):  # the host has no article, or the page isn't built like its host's others
        at = (list(_roots(root)) if path else []) or [root]
    _drop(root, wrapper, counted(wrapper[6]), drop)
    out: list[str] = []
    for x in at:
        _blocks(x, _semantic(x.label), drop, out)
    return "\n\n".join(out)


def _drop(node: Node, w: list, articles: float, drop: set[int]) -> None:
    """Aligns a page with its wrapper; text leaves that hold a node's template go into drop."""
    groups: list[tuple[list, list[Node]]] = []  # folded child, and the page's nodes it stands for
    for k in node.kids:
        one = wrap(["#text", [k.text], []] if k.text is not None else [k.label, [x.text for x in k.kids], []] if k.kids and all(x.text is not None for x in k.kids) else fold(k), 0)
        if groups and one[0] == groups[-1][0][0] and one[3] and groups[-1][0][3] and not one[4] and not groups[-1][0][4]:
            groups[-1][1].append(k)
        else:
            groups.append((one, [k]))
    for i, j in match(["", 1, {}, 0, [g[0] for g in groups]], w)[1]:
        inner = w[4][j]
        template = _template(inner, articles)
        if template:
            leaves = [x for g in groups[i][1] for x in ([g] if g.text is not None else g.kids)]
            if zlib.crc32("\n".join(x.text for x in leaves if x.text is not None).encode("utf-8", "surrogatepass")) in template:
                drop.update(id(x) for x in leaves)
        if inner[4]:
            for k in groups[i][1]:
                if k.text is None:
                    _drop(k, inner, articles, drop)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and wrapper (packed) over all pages."""
    rows = pages.select(_host(url).alias("host"), F.col(html))

    def packed(held):
        hosts = list(held)
        return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array([(part * 2654435761 + zlib.crc32(h.encode())) % 64 for h in hosts], pa.int32()), pa.array([zlib.compress(pickle.dumps(prune(held[h]), 5), 1) for h in hosts], pa.binary())], names=["host", "salt", "wrapper"])

    part = 0

    def induce(batches):
        nonlocal part
        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page:
                    w = wrap(fold(parse(page)))
                    held[host] = prune(merge(held[host], w)) if host in held else w
            if len(held) > 2000:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    def merged(t: pa.Table) -> pa.Table:
        out = None
        for x in t.column("wrapper").to_pylist():
            w = pickle.loads(zlib.decompress(x))
            out = w if out is None else prune(merge(out, w))
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": pa.array([zlib.compress(pickle.dumps(out, 5), 1)], pa.binary())})

    each = rows.mapInArrow(induce, "host string, salt int, wrapper binary")
    return each.groupBy("host", "salt").applyInArrow(merged, "host string, wrapper binary").groupBy("host").applyInArrow(merged, "host string, wrapper binary")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row.

    The wrappers are written first, so that Spark knows their size: small ones are broadcast, others joined by host.
    """
    kind = pages.select(key).schema[0].dataType.simpleString()
    found = C.written(wrappers(pages, url, html), "wrappers")
    joined = pages.select(F.col(key), F.col(url), F.col(html), _host(url).alias("_host")).join(found, F.col("_host") == F.col("host"), "left").select(key, url, html, "wrapper")

    def run(batches):
        seen: dict[bytes, list] = {}
        for b in batches:
            texts = []
            for page, packed in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if packed is not None and packed not in seen:
                    if len(seen) > 500:
                        seen.clear()
                    seen[packed] = pickle.loads(zlib.decompress(packed))
                texts.append(extract(page, seen.get(packed)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    return joined.mapInArrow(run, f"{key} {kind}, {url} string, text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.read(spark, sf_dir, "pages"))

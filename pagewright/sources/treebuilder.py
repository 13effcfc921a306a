"""Builds the tree of a page's elements as browsers do: implied elements and end tags, tables, misnested formatting.

The tokens come from the standard library's parser. What is done with each depends on the open elements: the innermost of table, section, row, cell,
select, body and head decides, so there is no mode to keep besides. Left aside: frames, templates' own documents, foreign content's own rules, quirks mode.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

#: Elements without content, whose content is text only, and that belong to the head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ONLY = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
#: Elements that end an open paragraph; formatting elements; elements that formatting can't reach across.
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul "
    "h1 h2 h3 h4 h5 h6 pre listing form li dd dt table hr xmp plaintext".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCK | VOID - {"embed"} | HEAD | frozenset("applet body button caption colgroup frame frameset head html iframe marquee noembed object select tbody td textarea tfoot th thead tr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: End tags that another tag implies; where looking for an open element stops.
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template"))
SECTIONS, CELLS = frozenset(("tbody", "tfoot", "thead")), frozenset(("td", "th"))
IN_TABLE = SECTIONS | {"table", "tr"}
DECIDES = IN_TABLE | CELLS | {"select", "caption", "colgroup", "body", "head", "html"}
BLANKS = " \t\n\f\r"
#: Elements deeper than this are siblings, as in common browsers.
DEEP = 512


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, None, []

    def put(self, kid: Node | str, at: int | None = None) -> None:
        if isinstance(kid, Node):
            if kid.parent is not None:
                kid.parent.kids.remove(kid)
            kid.parent = self
        self.kids.insert(len(self.kids) if at is None else at, kid)


class Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = TEXT_ONLY

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.active: list[Node | None] = []  # formatting elements; None: a cell or caption begins
        self.head = self.body = self.form = None
        self.drop_newline = False

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    # -- open elements

    @property
    def here(self) -> Node:
        return self.open[-1]

    def mode(self) -> str:
        return next(n.tag for n in reversed(self.open) if n.tag in DECIDES)

    def in_scope(self, tags, stop=SCOPE) -> bool:
        tags = (tags,) if isinstance(tags, str) else tags
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in stop:
                return False
        return False

    def until(self, *tags: str) -> None:
        """Closes elements up to and with the innermost of some."""
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def back_to(self, tags) -> None:
        """Closes elements down to the innermost of some, which stays open."""
        while self.here.tag not in tags and len(self.open) > 1:
            self.open.pop()

    def imply(self, but: str | None = None) -> None:
        while self.here.tag in IMPLIED and self.here.tag != but:
            self.open.pop()

    def close_paragraph(self) -> None:
        if self.in_scope("p", BUTTON_SCOPE):
            self.imply("p")
            self.until("p")

    # -- inserting

    def insert(self, kid: Node | str, under: Node | None = None) -> None:
        """Puts a node where the parser stands; what no table can hold goes before the table."""
        under = under or self.here
        if under.tag in IN_TABLE and (isinstance(kid, str) or kid.tag not in IN_TABLE | CELLS | {"caption", "colgroup", "col", "script", "style", "template"}):
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            hidden = isinstance(kid, Node) and (kid.tag == "form" or kid.tag == "input" and kid.attrs.get("type", "").lower() == "hidden")
            if table is not None and table.parent is not None and not hidden:
                under, at = table.parent, table.parent.kids.index(table)
                if isinstance(kid, str) and at and isinstance(under.kids[at - 1], str):
                    under.kids[at - 1] += kid
                else:
                    under.put(kid, at)
                return
        if isinstance(kid, str) and under.kids and isinstance(under.kids[-1], str):
            under.kids[-1] += kid
        else:
            under.put(kid)

    def add(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.insert(node)
        if tag not in VOID and (len(self.open) < DEEP or tag in TEXT_ONLY):
            self.open.append(node)
        return node

    def to_body(self) -> None:
        if self.body is None:
            self.to_head()
            del self.open[1:]
            self.body = self.add("body", {})

    def to_head(self) -> None:
        if self.head is None:
            self.head = self.add("head", {})

    def revive(self) -> None:
        """Opens formatting elements again that were closed with a block."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.open:
            at -= 1
        for k in range(at, len(self.active)):
            self.active[k] = self.add(self.active[k].tag, dict(self.active[k].attrs))

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tokens

    def handle_starttag(self, tag, attrs):
        names: dict[str, str] = {}
        for k, v in attrs:
            names.setdefault(k, v or "")
        self.drop_newline = False
        if tag == "html":
            self.root.attrs = {**names, **self.root.attrs}
        elif tag == "head":
            if self.head is None:
                self.head = self.add("head", names)
        elif tag == "body":
            if self.body is None:
                self.to_body()
                self.body.attrs = names
            else:
                self.body.attrs = {**names, **self.body.attrs}
        elif tag in ("frameset", "frame"):
            return
        elif self.body is None and tag in HEAD:
            self.to_head()
            if self.here.tag != "noscript" and self.head not in self.open:
                self.open.append(self.head)  # between head and body
            self.add(tag, names)
        else:
            self.to_body()
            self.starts(tag, names)

    def starts(self, tag: str, attrs: dict[str, str]) -> None:
        mode = self.mode()
        if mode == "select":
            if tag in ("option", "optgroup"):
                if self.here.tag == "option":
                    self.open.pop()
                if tag == "optgroup" and self.here.tag == "optgroup":
                    self.open.pop()
                self.add(tag, attrs)
                return
            if tag in ("hr", "script", "template"):
                self.add(tag, attrs)
                return
            if tag == "select":
                self.until("select")
                return
            if tag in ("input", "textarea", "keygen") or tag in IN_TABLE | CELLS | {"caption"} and self.in_scope("table", TABLE_SCOPE):
                self.until("select")
                return self.starts(tag, attrs)
            return
        if mode == "colgroup" and self.here.tag == "colgroup" and tag not in ("col", "template"):
            self.open.pop()
            return self.starts(tag, attrs)
        if tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr", "td", "th"):
            return self.table_part(tag, attrs, mode)
        if mode in IN_TABLE and tag == "table":
            self.until("table")
            return self.starts(tag, attrs)
        self.flow(tag, attrs)

    def table_part(self, tag: str, attrs: dict[str, str], mode: str) -> None:
        """A start tag that only counts inside a table; what it implies is opened or closed first."""
        if mode == "colgroup" and tag == "col":
            self.add(tag, attrs)
            return
        if mode in CELLS or mode == "caption":
            if tag == "col" and mode == "colgroup":
                return
            self.imply()
            self.until(mode)
            self.clear_active()
            return self.table_part(tag, attrs, self.mode())
        if mode not in IN_TABLE:
            return
        if tag in ("caption", "colgroup", "col", *SECTIONS):
            self.back_to(("table",))
            if tag == "col":
                self.add("colgroup", {})
            if tag == "caption":
                self.active.append(None)
        elif tag == "tr":
            self.back_to(SECTIONS | {"table"})
            if self.here.tag == "table":
                self.add("tbody", {})
        else:
            self.back_to(IN_TABLE)
            if self.here.tag == "table":
                self.add("tbody", {})
            if self.here.tag in SECTIONS:
                self.add("tr", {})
            self.active.append(None)
        self.add(tag, attrs)

    def flow(self, tag: str, attrs: dict[str, str]) -> None:
        """A start tag in the body."""
        if tag == "form" and self.form is not None:
            return
        if tag in BLOCK and tag not in ("li", "dd", "dt"):
            self.close_paragraph()
        if tag in HEADINGS and self.here.tag in HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt"):
            alike = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if n.tag in alike:
                    self.imply(n.tag)
                    self.until(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_paragraph()
        elif tag == "button" and self.in_scope("button"):
            self.imply()
            self.until("button")
        elif tag in ("option", "optgroup") and self.here.tag == "option":
            self.open.pop()
        elif tag in ("rb", "rtc", "rp", "rt") and self.in_scope("ruby"):
            self.imply("rtc" if tag in ("rp", "rt") else None)
        if tag in ("a", "nobr"):
            since = len(self.active) - next((i for i, n in enumerate(reversed(self.active)) if n is None), len(self.active))
            again = next((n for n in reversed(self.active[since:]) if n.tag == tag), None)
            if again is not None:
                self.adopt(tag)
                self.active = [n for n in self.active if n is not again]
                if again in self.open:
                    self.open.remove(again)
        if tag not in BLOCK and tag not in HEAD and tag not in ("param", "source", "track", "rb", "rtc", "rp", "rt"):
            self.revive()
        tag = "img" if tag == "image" else tag
        node = self.add(tag, attrs)
        if tag in FORMATTING:
            self.active.append(node)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)
        elif tag == "form":
            self.form = node
            if node.parent.tag in IN_TABLE:  # it holds nothing there
                self.open.pop()
        self.drop_newline = tag in ("pre", "listing", "textarea")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.here.tag == tag and tag in ("svg", "path", "circle", "rect", "line", "polygon", "polyline", "ellipse", "use", "g", "stop", "math"):
            self.open.pop()

    def handle_endtag(self, tag):
        self.drop_newline = False
        if tag in ("html", "body"):
            self.to_body()
        elif tag == "head":
            if self.body is None:
                self.to_head()
                del self.open[1:]
        elif self.body is None and (self.here.tag == tag or tag not in ("br", "p")):
            if self.here.tag == tag and self.here is not self.root:
                self.open.pop()
        elif self.body is not None or tag in ("br", "p"):
            self.to_body()
            self.ends(tag)

    def ends(self, tag: str) -> None:
        mode = self.mode()
        if tag == "select":
            if self.in_scope("select", frozenset()):
                self.until("select")
        elif tag == "table" or tag in SECTIONS or tag in CELLS or tag in ("tr", "caption"):
            if self.in_scope(tag, TABLE_SCOPE):
                if mode in CELLS or mode == "caption":
                    self.imply()
                    self.clear_active()
                self.until(tag)
        elif tag in ("colgroup", "col"):
            if tag == "colgroup" and self.here.tag == tag:
                self.open.pop()
        elif tag == "p":
            if not self.in_scope("p", BUTTON_SCOPE):
                self.add("p", {})
            self.imply("p")
            self.until("p")
        elif tag == "br":
            self.flow("br", {})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                self.until(*HEADINGS)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.open and self.in_scope("form"):
                self.imply()
                self.open.remove(node)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in BLOCK or tag in ("button", "object", "applet", "marquee"):
            if self.in_scope(tag, LIST_SCOPE if tag == "li" else SCOPE):
                self.imply(tag)
                self.until(tag)
                if tag in ("object", "applet", "marquee"):
                    self.clear_active()
        else:
            self.other_end(tag)

    def other_end(self, tag: str) -> None:
        for n in reversed(self.open[1:]):
            if n.tag == tag:
                self.imply(tag)
                self.until(tag)
                return
            if n.tag in SPECIAL:
                return

    def adopt(self, tag: str) -> None:
        """Ends a formatting element inside of which blocks are still open: it is split, and what is in the block is formatted there."""
        if self.here.tag == tag and self.here not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            since = len(self.active) - next((i for i, n in enumerate(reversed(self.active)) if n is None), len(self.active))
            old = next((n for n in reversed(self.active[since:]) if n.tag == tag), None)
            if old is None:
                return self.other_end(tag)
            if old not in self.open:
                self.active.remove(old)
                return
            if not self.in_scope(tag):
                return
            at = self.open.index(old)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(old)
                return
            above, mark, last = self.open[at - 1], self.active.index(old), block
            where, inner = self.open.index(block), 0
            while True:
                inner, where = inner + 1, where - 1
                node = self.open[where]
                if node is old:
                    break
                if inner > 3 and node in self.active:
                    mark -= self.active.index(node) < mark
                    self.active.remove(node)
                if node not in self.active:
                    del self.open[where]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = self.open[where] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                copy.put(last)
                last = copy
            self.insert(last, above)
            copy = Node(old.tag, dict(old.attrs))
            for kid in list(block.kids):
                if isinstance(kid, Node):
                    copy.put(kid)
                else:
                    copy.kids.append(kid)
            block.kids = []
            block.put(copy)
            mark -= self.active.index(old) < mark
            self.active.remove(old)
            self.active.insert(mark, copy)
            self.open.remove(old)
            self.open.insert(self.open.index(block) + 1, copy)

    def handle_data(self, data):
        if self.here.tag in ("textarea", "title"):
            data = unescape(data)
        if self.drop_newline and data.startswith("\n"):
            data = data[1:]
        self.drop_newline = False
        if not data:
            return
        if self.here.tag in TEXT_ONLY:
            self.insert(data)
        elif self.body is None:
            bare = data.lstrip(BLANKS)
            if bare:
                self.to_body()
                self.handle_data(bare)
            elif self.here is not self.root and self.head is not None:
                self.insert(data)
        elif data.strip(BLANKS):
            if self.here.tag == "colgroup":
                self.open.pop()
            self.revive()
            self.insert(data)
        elif self.here.tag in IN_TABLE:
            self.here.kids.append(data)
        elif self.here.tag != "colgroup":
            if self.mode() != "select":
                self.revive()
            self.insert(data)


def build(html: str) -> Node:
    """The root element of a page; it always holds a head and a body."""
    b = Builder()
    b.feed(html)
    b.close()
    b.to_body()
    return b.root

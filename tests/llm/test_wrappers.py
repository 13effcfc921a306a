import itertools
import random

from pagewright.llm import wrappers as X


def page(i, body, title="T"):
    return f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/x>Link {i}</a></li></ul></nav>{body}<footer>&copy; me</footer></body></html>"


def test_article_and_what_surrounds_it():
    body = "<!-- ad --><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p><b>One\n two<br><p>Three <i>fo</i>ur &lt;b&gt;</p><form>f</form><aside>s</aside><ul><li>a<li>b</ul><div class='comments'><p>me too</p></div><script>x</script></article><div id='cookie-notice'>c</div>"
    assert X.extract(page(1, body), None) == "Head & line\n\nOne two\n\nThree four <b>\n\na\n\nb"


def test_varying_slots_are_content(spark):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["oak", "elm", "ash", "fir"]) for _ in range(40))
    want, rows = {}, []
    for i in range(12):
        a, b = text(), text()
        body = f"<div class=top>Same words on top of all pages</div><div class=x{i}><div><h2>{a[:20]}</h2><div>{a}</div><div>{b}</div></div></div><div class=end>Same words below</div>"
        rows.append((i, f"http://h.example/{i}", page(i, body), i))
        want[i] = f"{a[:20].strip()}\n\n{a}\n\n{b}"
    rows += [(None, None, None, 0), (50, None, "", 0), (50, "x", "plain text", 0), (51, "http://h.example/z", page(1, ""), 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(4)
    got = {(x.page_id, x.url): x for x in X.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, t in want.items():
        assert got[i, f"http://h.example/{i}"].text == t and got[i, f"http://h.example/{i}"].n_chars == len(t)
    assert got[None, None].text == "" and got[50, None].text == "" and got[50, "x"].text == "plain text" and got[51, "http://h.example/z"].text == ""
    assert X.main_text(df.limit(0)).count() == 0


def brute(a, b):
    """Largest ordered matching by trying all pairs of equally long choices of children."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[4]), len(b[4])) + 1):
        for x in itertools.combinations(a[4], k):
            for y in itertools.combinations(b[4], k):
                best = max(best, sum(brute(p, q) for p, q in zip(x, y)))
    return 1 + best


def tree(r, depth):
    return [r.choice("ab") if depth < 3 else "r", 1, {}, 0, [tree(r, depth - 1) for _ in range(r.randrange(0, 4))] if depth else [], 0, (r.randrange(9),)]


def test_matching_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        a, b = tree(r, 3), tree(r, 3)
        size, pairs = X.match(a, b)
        assert size <= brute(a, b)
        if [k[0] for k in a[4]] != [k[0] for k in b[4]]:
            assert size == brute(a, b)
        assert all(a[4][i][0] == b[4][j][0] for i, j in pairs)
        assert X.merge(a, b)[1] == 2


def test_broken_pages():
    for p in ("<", "<a", "<p", "<!--", "<script>", "</p></p>", "<div " + 'a="' * 3000, "<div>" * 5000 + "x", "<li>" * 3000 + "y", "<p><b>" * 2000 + "z", "<table><tr><td>1<td>2<tr><td>3</table>"):
        X.extract(p, None)
    assert X.extract("<nav>menu<article>text</article>", None) == "text"
    assert X.extract("<p>" + "long " * 50000, None) == ("long " * 50000).strip()


def wrapper_of(pages):
    out = None
    for p in pages:
        w = X.wrap(X.fold(X.parse(p)))
        out = w if out is None else X.prune(X.merge(out, w))
    return out


def test_all_varying_slots_are_kept():
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["oak", "elm", "ash", "fir"]) for _ in range(n))
    bodies, want = [], []
    for _ in range(12):
        title, lead, one, two = text(4), text(8), text(60), text(40)
        bodies.append(page(1, f"<div class=bar>Same words</div><div class=page><div class=head><h1>{title}</h1><p>{lead}</p></div><div class=text><p>{one}</p><div>{two}</div></div></div>"))
        want.append(f"{title}\n\n{lead}\n\n{one}\n\n{two}")
    w = wrapper_of(bodies)
    assert [X.extract(b, w) for b in bodies] == want


def test_alike_siblings_are_kept():
    for tag in ("div class=content", "article", "article class=part"):
        end = tag.split()[0]
        two = [page(i, f"<div class=page><{tag}><h2>a {i}</h2><p>first of {i}</p></{end}><{tag}><h2>b {i}</h2><p>second and longer of {i}</p></{end}></div>") for i in range(8)]
        w = wrapper_of(two)
        assert [X.extract(p, w) for p in two] == [f"a {i}\n\nfirst of {i}\n\nb {i}\n\nsecond and longer of {i}" for i in range(8)]


def test_late_layouts_are_learned():
    old = [page(i, f"<div class=page><p>old {i}</p></div>") for i in range(500)]
    new = [page(i, f"<section class=body><div class=box>Constant words</div><p>text {i}</p><p>more {i}</p></section>") for i in range(1500)]
    w = wrapper_of(old + new)
    assert [k[1] for k in w[4] if k[0] == "section|class=body"] == [1500]
    assert X.extract(new[7], w) == "text 7\n\nmore 7"
    early, late = wrapper_of(old), wrapper_of(new[:450])
    both = X.prune(X.merge(early, late))
    assert {k[0]: k[1] for k in both[4]}["section|class=body"] == 450 and {k[0]: k[1] for k in both[4]}["div|class=page"] == 500


def test_wrappers_stay_bounded():
    w = wrapper_of([page(i, f"<div class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x><p>text {i}</p></div><div class=all>{i}</div>") for i in range(1500)])
    assert w[1] == 1500 and len(w[4]) <= 2 / X.RARE and max(k[1] for k in w[4]) == 1500


def test_template_inside_articles():
    """Constant nodes without telling names go, alike in and outside of articles; copies of an article make nothing template."""
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["oak", "elm", "ash", "fir"]) for _ in range(n))
    bodies, want = [], []
    for _ in range(12):
        title, one, two = text(4), text(40), text(30)
        bodies.append(page(1, f"<article><h1>{title}</h1><div class=k1>Read it to the end</div><p>{one}</p><section><p>{two}</p></section><div class=k2>Thanks for reading us</div></article>"))
        want.append(f"{title}\n\n{one}\n\n{two}")
    w = wrapper_of(bodies)
    assert [X.extract(b, w) for b in bodies] == want
    assert all("Read it to the end" in X.extract(b, None) for b in bodies)
    assert [X.extract(b, wrapper_of(bodies[::-1])) for b in bodies] == want
    for copies in (9, 12):
        same = [bodies[0]] * copies + bodies[1 : 13 - copies]
        w = wrapper_of(same)
        assert want[0].split("\n\n")[1] in X.extract(bodies[0], w)


def prose(r, n):
    return " ".join(r.choice(["oak", "elm", "ash", "fir", "yew", "bay"]) + str(r.randrange(30)) for _ in range(n))


def test_near_copies_keep_their_titles():
    """Copies and near copies of an article count once, on hosts of any size; a text of its own is kept where others have the template."""
    r = random.Random(7)
    title, body = prose(r, 5), prose(r, 120)
    near = [page(i, f"<article><h1>{title}</h1><p>{body} {i}</p></article>") for i in range(2)]
    alone = page(3, f"<article><h1>{title} alone</h1><p>{prose(r, 80)}</p></article>")
    other = page(4, f"<article><h1>Own title</h1><p>{prose(r, 80)}</p></article>")
    for pages in (near + [alone], near * 4 + [alone], near * 3 + [alone, other], [near[0]] * 9):
        w = wrapper_of(pages)
        for p in pages:
            assert X.extract(p, w) == X.extract(p, None) and "<h1>" in p and X.extract(p, w).count("\n\n") == 1
    rows = [page(i, f"<article><h1>Our weekly letter</h1><p>{prose(r, 60)}</p></article>") for i in range(9)] + [page(9, f"<article><h1>Something else</h1><p>{prose(r, 60)}</p></article>")]
    w = wrapper_of(rows)
    assert all("weekly" not in X.extract(p, w) for p in rows[:9]) and X.extract(rows[9], w).startswith("Something else\n\n")


def test_article_without_text():
    r = random.Random(8)
    rows = [page(i, f"<div class=k1>We are closed on Sundays</div><article><h1>{prose(r, 4)}</h1><p>{prose(r, 50)}</p></article><div class=k2>Constant tail</div>") for i in range(20)]
    bare = page(20, "<div class=k1>We are closed on Sundays</div><article></article><div class=k2>Constant tail</div>")
    w = wrapper_of(rows + [bare])
    assert X.extract(bare, w) == "" and X.extract(rows[3], w).count("\n\n") == 1
    open_ = [page(i, f"<div class=k1>We are closed on Sundays</div><div class=t><p>{prose(r, 50)}</p></div>") for i in range(20)]
    none = page(20, "<div class=k1>We are closed on Sundays</div><div class=t></div>")
    assert X.extract(none, wrapper_of(open_ + [none])) == ""


def test_deep_pages():
    """Boilerplate is left out and blocks stay apart however deep they lie."""
    for n in (20, 205, 900):
        assert X.extract("<div>" * n + "<nav>MENU<p>more</p></nav><p>text</p><div class=comments><div><p>me too</p></div></div><p>end</p>" + "</div>" * n, None) == "text\n\nend"
    assert X.extract("<nav>" + "<div>" * 300 + "menu" + "</div>" * 300 + "</nav><p>text</p>", None) == "text"


def test_classes_that_prose_can_carry():
    r = random.Random(9)
    text = prose(r, 40)
    for name in ("related-work", "search-results", "notice", "tags", "banner"):
        got = X.extract(page(1, f"<article><h1>Head</h1><div class='{name}'><p>{text}</p></div><div class='{name}'><a href=/x>one</a> <a href=/y>two</a></div></article>"), None)
        assert got == f"Head\n\n{text}"
    assert X.extract(page(1, f"<article><h1>Head</h1><div class='comments'><p>{text}</p></div></article>"), None) == "Head"


def test_constant_heading_longer_than_the_body():
    """The longest slot may be the template itself."""
    r = random.Random(10)
    long = "Terms and conditions apply to all that is written here " * 3
    rows = [page(i, f"<article><div class=k1>{long}</div><p>{prose(r, 12)}</p></article>") for i in range(12)]
    w = wrapper_of(rows)
    assert all("Terms" not in X.extract(p, w) and X.extract(p, w) for p in rows)


def test_texts_that_most_pages_hold_are_found_late():
    """A text that many later pages hold gets a place among those that a node counts."""
    r = random.Random(11)
    early = [page(i, f"<article><div class=k1>early {i // 2}</div><p>{prose(r, 40)}</p></article>") for i in range(40)]
    late = [page(i, f"<article><div class=k1>Read it to the end</div><p>{prose(r, 40)}</p></article>") for i in range(160)]
    w = wrapper_of(early + late)
    assert all("Read it" not in X.extract(p, w) for p in late) and all("early" in X.extract(p, w) for p in early)


def test_long_labels_stay_apart():
    a, b = (X.parse(f"<div class='{'x' * 90}{c}'><p>t</p></div>").kids[0].label for c in "ab")
    assert a != b and len(a) < 100


def test_sketches_count_articles():
    r = random.Random(12)
    keys = [r.getrandbits(32) for _ in range(3000)]
    s: tuple = ()
    for k in keys[:10]:
        s = X.both(s, (k,))
    assert X.counted(s) == 10 and X.both(s, s) == s
    for k in keys:
        s = X.both(s, (k,))
    assert len(s) == X.KEYS and 1500 < X.counted(s) < 6000
    assert s == X.both(tuple(sorted(keys[::2])[: X.KEYS]), tuple(sorted(keys[1::2])[: X.KEYS]))

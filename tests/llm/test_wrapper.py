import re
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st

from seqledger.llm import wrapper as w
from seqledger.llm.wrapper import Node, align, extract, extract_pages, induce, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="cookie-notice">We use</div>
<article class="post"><h1>A &amp; B</h1><p><b>First<br>  line &eacute;<p>Second &lt;p&gt;<ul><li>x<li>y</ul>
<aside>also read</aside><form><input><p>mail</form><div class="ad">buy</div><!-- hidden <p>z</p> --></article>
<section id="comments"><p>nice!</section><footer>(c)</footer>"""


def test_article_without_its_surroundings():
    assert extract(PAGE, None) == "A & B\nFirst line é\nSecond <p>\nx\ny"


def test_empty_cut_and_odd_pages():
    assert extract(None, None) == extract("", None) == extract("<", None)[1:] == extract("<!-- open <p>x", None) == ""
    assert extract("plain\n\ttext &am", None) == "plain text &am"
    assert extract("<p>a</div></p></p><p>b<table><tr><td>c<td>d", None) == "a\nb\nc\nd"
    assert extract("<p>a < b & c</p><style>p{}", None) == "a < b & c"
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    assert extract(deep, None) == extract(deep, induce([deep, deep.replace("in", "out")])) == "in"
    long = "<article>" + "<p>word &amp; word</p>" * 30_000 + "</article>"
    assert extract(long, induce([long, long + "<i>x</i>"])).count("\n") == 29_999


def test_host_template_goes_when_no_element_is_marked():
    page = "<body><div>Fixed head of the site</div><div><p>{}</p><p>{}</p></div><div>All rights</div></body>".format
    texts = [(f"one text number {i} " * 5, f"and a second {i} " * 9) for i in range(4)]
    wrapper = induce([page(*t) for t in texts])
    fixed = [w._numbered(wrapper.tree)[i] for i in wrapper.template]
    assert {w._own(n) for n in fixed} == {"Fixed head of the site", "All rights"}
    for t in texts:
        assert extract(page(*t), w._unpack(w._pack(induce([page(*x) for x in texts])))) == "\n".join(x.strip() for x in t)


def test_pages_that_share_an_article_keep_it():
    page = "<body><nav>m</nav><article><p>same text</p></article><footer>{}</footer>".format
    assert extract(page(1), induce([page(1), page(2), page(3)])) == "same text"


TREE = st.recursive(st.sampled_from("ab").map(lambda t: (t, ())), lambda c: st.tuples(st.sampled_from("ab"), st.lists(c, max_size=3).map(tuple)), max_leaves=8)


def node(t):
    return Node(t[0], children=[node(c) for c in t[1]])


@cache
def size(a, b):
    """Greatest matching of two trees, by its recursion over forests."""
    if a[0] != b[0]:
        return 0

    @cache
    def forest(i, j):
        return 0 if not i or not j else max(forest(i - 1, j), forest(i, j - 1), forest(i - 1, j - 1) + size(a[1][i - 1], b[1][j - 1]))

    return 1 + forest(len(a[1]), len(b[1]))


@settings(max_examples=150, deadline=None)
@given(TREE, TREE)
def test_alignment_is_a_greatest_matching(a, b):
    x, y = node(a), node(b)
    w._measure(x)
    w._measure(y)
    pairs = align(x, y)
    assert len(pairs) == size(a, b)
    assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)
    up = {id(c): id(n) for t in (x, y) for n in w._numbered(t) for c in n.children}
    both = {(id(p), id(q)) for p, q in pairs}
    assert all(p.tag == q.tag and ((up.get(id(p)), up.get(id(q))) in both or p is x) for p, q in pairs)


@settings(max_examples=150, deadline=None)
@given(TREE, TREE)
def test_alignment_does_not_depend_on_the_size_of_its_tables(a, b):
    pairs = []
    for most in (250_000, 0):
        x, y = node(a), node(b)
        w._measure(x)
        w._measure(y)
        first, second = ({id(n): i for i, n in enumerate(w._numbered(t))} for t in (x, y))
        old, w.TABLE = w.TABLE, most
        try:
            pairs.append([(first[id(p)], second[id(q)]) for p, q in align(x, y)])
        finally:
            w.TABLE = old
    assert pairs[0] == pairs[1]


def test_many_children_are_matched_for_the_greatest_sum():
    # One pass over both lists takes the next free child of a tag, which is the wrong one here.
    big = ("b", tuple(("i", ()) for _ in range(5)))
    a, b = ("a", (big,) * 600), ("a", (("b", ()),) * 30 + (big,) * 600 + (("b", ()),))
    x, y = node(a), node(b)
    w._measure(x)
    w._measure(y)
    assert len(align(x, y)) == 1 + 600 * 6 == 1 + 6 * len(x.children)


def test_parse_keeps_all_text_outside_raw_elements():
    seen = []

    def walk(n):
        seen.append(n.text)
        for c in n.children:
            walk(c)

    walk(parse("a<b>c</i>d<p>e<p>f</b>g"))
    assert "".join(seen) == "acdefg"


def test_query_gives_a_row_for_every_page(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org:80/x?u=//y", PAGE.replace("First", f"First {i}"), "x") for i in range(30)]
    rows += [(None, None, PAGE, "x"), (40, "nonsense", PAGE, "x"), (41, "http://h1.org/", None, "x"), (42, None, "", "x"), (3, rows[3][1], rows[3][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    want = sorted(((i, u, extract(h, None), len(extract(h, None))) for i, u, h, _ in rows), key=repr)
    assert sorted((tuple(r) for r in extract_pages(pages).collect()), key=repr) == want
    monkeypatch.setattr(w, "BROADCAST_HOSTS", 0)
    assert sorted((tuple(r) for r in extract_pages(pages).collect()), key=repr) == want
    assert extract_pages(pages.limit(0)).collect() == []
    assert {r[0] for r in pages.select(w.host("url")).collect()} == {"h0.org", "h1.org", "h2.org", ""}


def test_all_pages_of_a_host_make_its_template(spark):
    """A line that a few pages share by chance is no template, and one odd page does not undo it (F22)."""
    page = "<body><div>Fixed head of the site</div><div><p>{}</p><p>{}</p></div><div>All rights</div></body>".format
    pages = [page("same start of a text" if i < 30 else f"start {i} of a text", f"and a text of its own {i} " * 9) for i in range(40)]
    odd = "<body><b>gone</b></body>"
    want = {p: "\n".join(x.strip() for x in re.findall("<p>(.*?)</p>", p)) for p in pages} | {odd: "gone"}
    assert all(extract(p, induce([*pages, odd])) == want[p] for p in pages)
    rows = [(i, f"http://h{k}.org/{i}", p) for k in range(4) for i, p in enumerate([*pages, odd, pages[0], *pages[:30]])]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    assert {(r["page_id"], r["url"], r["text"]) for r in out} >= {(i, u, want[p]) for i, u, p in rows if p != odd}

"""URL filter and HTML extraction."""

import re
import time
from collections import defaultdict

from codelattice.llm import html_extract, url_filter
from codelattice.llm.html_extract import Page

SCHEMA = "page_id long, url string, html string, host int, text int"


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no-scheme/path": ("", "", None, "allow"),
        "http://A.Com": ("a.com", "", None, "allow"),
        "http://x.com/en/1?a=://b": ("x.com", "/en/1", "com/en/", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://example.com/en/75#top": ("example.com", "/en/75", "example.com/en/7", "allow"),
        "https://m.example.com/EN/7": ("m.example.com", "/EN/7", None, "allow"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://spam.net/de/1": ("spam.net", "/de/1", "net/de/", "allow"),
        "http://a.example.net/de/81": ("a.example.net", "/de/81", "example.net/de/8", "block"),
        "http://h.org?x/es/": ("h.org", "", None, "allow"),
        "http://h.org/es/2": ("h.org", "/es/2", "org/es/", "block"),
        "http://spam-farm.org/x": ("spam-farm.org", "/x", None, "block"),
        "http://cheap-farm.org/x": ("cheap-farm.org", "/x", None, "block"),
        "http://cheap.org/cheap?cheap": ("cheap.org", "/cheap", None, "allow"),
        "http://x.org/écasino": ("x.org", "/écasino", None, "block"),
        "http://É.Org/xcasino": ("É.org", "/xcasino", None, "allow"),
        f"http://x.org/{'a-' * 200_000}warez": ("x.org", f"/{'a-' * 200_000}warez", None, "block"),
        "http://spammer.org/freedom/Winter": ("spammer.org", "/freedom/Winter", None, "allow"),
    }
    rows = list(cases.items())
    table = spark.createDataFrame([(i, u, None, 1, 2) for i, (u, _) in enumerate(rows)] * 2, SCHEMA)
    out = url_filter.judge(table).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == rows[r.page_id][1], rows[r.page_id][0]
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_come_from_a_file(tmp_path):
    (tmp_path / "terms").write_text("# remark\nfoo\tstrict\nbar\tsoft\nbaz qux\tsoft\n")
    assert url_filter.read_terms(tmp_path / "terms") == (("foo",), ("bar", "baz qux"))
    assert len(url_filter.STRICT) > 20 and len(url_filter.SOFT) > 50 and not set(url_filter.STRICT) & set(url_filter.SOFT)


def text(source):
    return Page(source).main_text(set())


def test_blocks_and_references():
    assert text("<article><h1>A&amp;B</h1><p>x  <b>y</b>\n z&nbsp;&eacute;&#233; a<br>b</p></article>") == "A&B\nx y z éé a b"
    assert text("<p>one<p>two<div>three</div>four") == "one\ntwo\nthree\nfour"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert text("plain &lt;text&gt;") == "plain <text>"
    assert text("") == "" and text("<p></p>") == ""


def test_what_is_no_article_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="home"><nav>menu</nav><div class="cookie-notice">we use</div>
    <header>top</header><article><h1>H</h1><script>var a="</p>";</script><p>Body</p><!-- <p>not</p> --><div class="ad">buy</div><form>ask</form>
    <section id="comments"><p>First!</p></section></article><aside>side</aside><article class="comment"><p>nice</p></article><footer>foot</footer></body></html>"""
    assert text(page) == "H\nBody"
    assert text("<body><nav>m</nav><main><p>a</p></main><p>outside</p></body>") == "a"
    assert text("<body><div class='header'>m</div><p class='adapted loads'>a</p></body>") == "a"
    assert text("<article><p title='a>b'>x</p></article>") == "x"
    assert text("<article><p title=\"open>x</p></article>") == "x"


def test_rejected_inline_elements_end():
    assert text('<body><a class="skip" href="#main">Skip</a><article><p>one</p></article></body>') == "one"
    assert text('<article><span class="ad">x</span><p>one</p><p>two</p></article>') == "one\ntwo"
    assert text('<article><p>one <span class="ad">buy <b>it</b> <span>now</span> or never</span> two</p><p>three</p></article>') == "one\ntwo\nthree"
    assert text('<article><p>one <a class="promo">x</p><p>two</a> three</p></article>') == "one\ntwo three"
    assert text('<article><a class="ad"><p>x</a><p>one</p></article>') == "one"
    with_advert, plain = (Page(f"<div><p>{x}a</p><p>b</p></div>") for x in ('<span class="ad">x</span>', ""))
    assert with_advert.subtrees() & plain.subtrees()


def test_attributes_are_told_by_name():
    for mark in ('title="a hidden gem"', 'data-id="ad-1"', "title='id=ad'", "data-role=banner", 'class="has-sidebar"', 'class="content-sidebar-wrap"', "data-hidden"):
        assert text(f"<article><p>one</p><section {mark}><p>two</p></section></article>") == "one\ntwo", mark
    assert text('<article><p>to <a href="/hidden-falls">the falls</a> and <a href="/p?id=ad">on</a></p><p>two</p></article>') == "to the falls and on\ntwo"
    for mark in ("hidden", 'HIDDEN=""', 'class="x cookie-notice"', "id=ad-1", 'class="site-header"', "role='banner'", 'style="display: none"', 'aria-hidden="true"'):
        assert text(f"<article><p>one</p><section {mark}><p>two</p></section></article>") == "one", mark


def test_wrappers_of_the_article_stay():
    assert text('<body><div class="sidebar"><article><p>one</p></article></div></body>') == "one"
    assert text('<body><div id="page-header"><main><p>one</p></main></div><p>two</p></body>') == "one"
    assert text('<body><article><p>one</p></article><div class="sidebar"><article><p>teaser</p></article></div></body>') == "one"
    assert text('<body><form id="all"><div hidden><main><p>one</p></main></div><form>ask</form></form></body>') == "one"
    assert text('<body><p>one</p><div class="comments"><article><p>nice</p></article></div></body>') == "one"
    assert text('<body><main><p>one</p><div class="related"><article><p>teaser</p></article></div></main></body>') == "one"


def test_ends_of_scripts_where_lower_case_is_longer():
    assert text("<TITLE>İstanbul</TITLE><SCRIPT>var a</SCRIPT><p>İ one</p><style>p{}</STYLE><p>two</p>") == "İ one\ntwo"


def test_templates_of_a_host_go(spark):
    def page(i, host):
        return (i, f"http://{host}/p{i}", f"<div><p>Welcome to our site</p><span>every page</span></div><div><p>Story {i} of its own</p></div><p>Tail {i % 3}</p>")

    rows = [page(i, "a.org") for i in range(30)] + [page(100 + i, "b.org") for i in range(3)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(900, None, None, 1, 2), (901, "http://a.org/", "", 1, 2), (0, rows[0][1], rows[0][2], 1, 2)], SCHEMA)
    for most in (html_extract.BROADCAST_ROWS, -1):
        out = html_extract.extract(table, broadcast_rows=most).collect()
        by = {r.page_id: r.text for r in out}
        assert len(out) == 36 and by[900] == by[901] == ""
        assert by[5] == "Story 5 of its own\nTail 2" and by[101] == "Story 101 of its own\nTail 2"
        assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    """Neither repeated rows nor pages with one content, and two pages tell nothing."""
    same = "<div><h1>Title</h1><p>Only story here</p></div>"
    rows = [(1, "http://a.org/1", same)] * 12 + [(i, f"http://b.org/{i}", same) for i in range(2, 14)] + [(20 + i, f"http://c.org/{i}", f"<div><p>Both</p></div><p>{i}</p>") for i in range(2)]
    out = html_extract.extract(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()
    assert len(out) == 26 and {r.text for r in out if r.page_id < 20} == {"Title\nOnly story here"}
    assert {r.text for r in out if r.page_id >= 20} == {"Both\n0", "Both\n1"}


def test_an_article_is_its_own(spark):
    """What recurs in articles stays; attributes that only contain a telling word reject nothing."""
    rows = [(i, f"http://a.org/{i}", f'<div>All pages</div><article><h1 class="header">{i}</h1><p>Stock phrase</p><div class="share-price">7</div><p id="ad-hoc">x</p></article>') for i in range(12)]
    for r in html_extract.extract(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect():
        assert r.text == f"{r.page_id}\nStock phrase\n7\nx"


def bare(html):
    """The page without telling markup: menus, articles, footers and adverts are plain divs."""
    return re.sub(r"<(/?)(?:nav|article|footer)\b[^>]*>", r"<\1div>", html).replace(' class="ad"', "")


def test_counts_decide_on_given_pages_without_telling_markup(spark, sf):
    """Against a brute-force count of subtrees; without counts the footers would stay."""
    larger = sf.replace("sf0.001", "sf0.01")
    pages = [(r.page_id, r.url, bare(r.html)) for r in spark.read.parquet(f"{larger}/pages.parquet").collect()]
    hosts, kinds = defaultdict(set), defaultdict(set)
    for _, url, html in pages:
        host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        hosts[host].add(html)
    for host, every in hosts.items():
        for html in every:
            for d in Page(html).subtrees():
                kinds[host, d].add(html)
    out = html_extract.extract(spark.createDataFrame([(*p, 1, 2) for p in pages], SCHEMA)).collect()
    source, went = {p[0]: p for p in pages}, 0
    for r in out:
        host = r.url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        gone = {d for (h, d), those in kinds.items() if h == host and len(those) >= 3 and len(those) >= html_extract.SHARE * len(hosts[host])}
        assert r.text == Page(source[r.page_id][2]).main_text(gone)
        went += r.text != Page(source[r.page_id][2]).main_text(set())
    assert went > 0


def test_hostile_pages_take_linear_time():
    for source in ("<a '" * 50_000, "<a '>'" * 40_000 + "'", "<div>t" * 40_000, "<div>" * 30_000 + "</x>" * 30_000, "<!" * 100_000, "<a '>\"" * 40_000 + ">", "<title>" * 30_000):
        began = time.process_time()
        Page(source).main_text(set())
        assert time.process_time() - began < 10
    assert text("<p>1 < 2 <a 'x>y</p><p>z</p>") == "1 < 2 y\nz"


def test_very_long_page():
    source = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    assert text(source).count("\n") == 49_999
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == "x"

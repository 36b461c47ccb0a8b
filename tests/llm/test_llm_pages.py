import html
import re

import pytest

from overhaul.llm import html_text, urls
from overhaul.llm.queries import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href="/x">menu</a></nav>
<div class="wrap"><div class="left-sidebar">side</div><main><article class="post"><h2>T &amp; &lt;U&gt;</h2>
<p><b>One<br>two <b>b</b>old<p>three&nbsp; four<ul><li>a<li>b</ul><!-- no --><div class="ad-box">buy</div>
<aside>more</aside><form><input>q<button>go</button></form><section class="comments"><p>hey</p></section></article></main></div>
<span hidden>no</span><footer>&copy; f</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_one_page_alone():
    assert html_text.main_text(PAGE, None) == "T & <U>\nOne two bold\nthree four\na\nb"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<nav>x</nav>", ""), ("<", "<"), ("<article>a", "a"),
    ("</p></div>x", "x"), ("<script>never closed", ""), ("a &amp;amp; b", "a &amp; b"), ("<p>x<!-- open", "x"),
    ("<div>" * 3000 + "deep", "deep"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page, None) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>a</p><svg-icon name=x></svg-icon><p>rest</p></article>", "a\nrest"),
    ("<main><title-block>t</title-block><p>x</p><button-group><p>y</p></button-group><object-view></object-view>z", "t\nx\ny\nz"),
    ("<main><p>a</p><button>go<p>b</p><svg><p>c</p>", "a\ngo\nb\nc"), ("a<select>b<svg/>c</select>d", "a d"),
    ("<main><p>a</p><svg title='x>y'>no</svg><p>b</p><title>never closed<p>c", "a\nb"), ("a<SCRIPT>x</script >b<script/>c", "a b c"),
])
def test_custom_and_unclosed_raw_elements(page, text):
    assert html_text.main_text(page, None) == text


def article(page):
    inner = re.sub(r"</?(b|br)>", " ", page[page.index("<article>") + 9:page.index("</article>")])
    parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_all_test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == expected


def test_host_template_decides(spark):
    """The host's pages agree that the main column holds the text; one page's long teaser does not change it."""
    body = "<html><body><div class=top>{}</div><div class=col><p>{}</p><p>{}</p></div></body></html>"
    rows = [(k, f"http://h.org/{k}", body.format("x", f"story {k} " * 20, f"end {k}")) for k in range(8)]
    rows.append((9, "http://h.org/9", body.format("teaser " * 30, "short", "tale")))
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "short\ntale" and out[3] == ("story 3 " * 20).strip() + "\nend 3"


def texts(spark, rows):
    frame = spark.createDataFrame([(k, u, p) for k, (u, p) in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(frame).collect()}


def test_no_block_outside_the_longest_container_is_lost(spark):
    page = "<body><h1>Title {0}</h1><div class=content><h2>Part {0}</h2><p>{1}</p></div><div class=end><p>End {0}</p></div></body>"
    out = texts(spark, [("http://h.org/", page.format(k, f"long {k} " * 50)) for k in range(5)] + [
        ("http://one.org/", page.format(7, "long " * 50)),
        ("http://h.org/", "<body><h1>Other</h1><div class=x><p>most</p></div><div class=content><p>in</p></div></body>")])
    for k in range(5):
        assert out[k] == f"Title {k}\nPart {k}\n" + (f"long {k} " * 50).strip() + f"\nEnd {k}"
    assert out[5] == "Title 7\nPart 7\n" + ("long " * 50).strip() + "\nEnd 7" and out[6] == "Other\nmost\nin"


@pytest.mark.parametrize("page, text", [
    ('<div class="content-sidebar-wrap"><article><p>a</p></article><div class="sidebar">s</div></div>', "a"),
    ('<div class="layout has-sidebar"><p>the text of the page</p><div class="sidebar">s</div></div>', "the text of the page"),
    ('<body><form id="f"><div class="no-sidebar"><h1>h</h1><main>b</main></div></form><div class="share">s</div>', "h\nb"),
    ('<p>hello <span class="share">no</span> world<div hidden><div class="page-header-fixed">x</div></div>', "hello world"),
])
def test_wrappers_with_marked_names(page, text):
    assert html_text.main_text(page, None) == text


def test_hosts_decide_on_marked_names(spark):
    page = "<body><div class='has-sidebar'><p>{0} a long text of the host</p></div><div class='comments'><p>{1}</p></div></body>"
    out = texts(spark, [("http://h.org/", page.format(k, "hey " * (30 if k == 4 else 1))) for k in range(9)])
    assert all(out[k] == f"{k} a long text of the host" for k in range(9))


def test_repeated_words_inside_the_slot_are_dropped(spark):
    page = ("<body><article><h1>T {0}</h1><div class=x7>Call us now</div><ul class=m3><li>Start<li>Shop</ul>"
            "<p>story {0}</p><p>All rights by us</p><p>more {0}</p></article></body>")
    out = texts(spark, [("http://h.org/", page.format(k)) for k in range(6)] + [("http://two.org/", page.format(k)) for k in (6, 7)])
    assert all(out[k] == f"T {k}\nstory {k}\nmore {k}" for k in range(6))
    assert "Call us now" in out[6]  # two pages are no template


def test_copies_are_no_template(spark):
    page = "<body><h1>Title</h1><p>{}</p></body>"
    out = texts(spark, [("http://h.org/", page.format("same"))] * 10 + [("http://h.org/", page.format(k)) for k in "ab"])
    assert [out[k] for k in (0, 9, 10, 11)] == ["same", "same", "a", "b"]


def test_page_edges(spark):
    rows = [(None, None, None), (1, None, PAGE), (2, "no scheme", ""), (3, "http://h", PAGE), (3, "http://h", PAGE)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, slot string")
    out = html_text.extract(frame).collect()
    assert sorted((str(r.page_id), len(r.text) > 0) for r in out) == [
        ("1", True), ("2", False), ("3", True), ("3", True), ("None", False)]
    assert html_text.extract(frame.limit(0)).count() == 0


RULES = [("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("com", "/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judge(url):
    """Host, path, rule and its verdict by the definition."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["http://a.example.com/en/1", "https://www.example.com/en/", "http://x.www.EXAMPLE.com/en/a?b=/c#d", "http://example.com", "http://com/",
        "http://notcom/x", "http://s.net/es/1", "http://s.net/de/", "http://s.net", "http://t.org/", "http://T.org/?q=http://a.com/", None, "",
        "mailto:x", "://x.com/y", "a://b://c.com/", "http://\n.com/x", "http://Éa.com/É", "http://s.net/fr/2", "http://example.com/en"]


def test_urls(spark):
    rows = [(k, u, "<a href=//t.org/x>") for k, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], "")]
    frame = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, rule string, host string")
    out = urls.filter_pages(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        url = URLS[r.page_id or 0]
        host, path, rule, verdict = judge(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or r.verdict) in ("allow", "block")
    assert urls.filter_pages(frame.limit(0)).count() == 0


def test_query_rules_on_test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    known = {r.page_id: judge(r.url) for r in pages.collect()}
    for r in urls.filter_pages(pages).collect():
        host, path, rule, verdict = known[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)


def test_propagation_equals_a_plain_walk(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3), ("e", "d", 1)]
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.5), "e": (0.25, 0.0)}

    def walk(start, arrows):
        out, now = {}, {k: v * (1 - urls.DAMPING) for k, v in start.items() if v}
        total = {a: sum(n for x, _, n in arrows if x == a) for a, _, _ in arrows}
        for _ in range(urls.ROUNDS + 1):
            for k, v in now.items():
                out[k] = out.get(k, 0) + v
            step = {}
            for a, b, n in arrows:
                step[b] = step.get(b, 0) + urls.DAMPING * now.get(a, 0) * n / total[a]
            now = step
        return out

    trust = walk({k: v[0] for k, v in seeds.items()}, edges)
    distrust = walk({k: v[1] for k, v in seeds.items()}, [(b, a, n) for a, b, n in edges])
    got = urls.propagate(spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"),
                         spark.createDataFrame(edges, "a string, b string, n long"))
    for r in got.collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))


def test_links_carry_distrust_against_their_direction(spark):
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://friend.org/1", "<a href='http://bad.net/es/1'>"),
            (3, "http://good.com/1", "<a href='https://nice.org/'>"), (4, "http://nice.org/2", ""), (5, "http://alone.org/", None)]
    out = {r.page_id: r.verdict for r in urls.filter_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_propagation_solves_the_linear_system(spark):
    import numpy as np

    names = [f"h{k:02}" for k in range(22)]
    edges = [(names[k], names[k + 1], 1) for k in range(19)] + [("h20", "h21", 2), ("h21", "h20", 1), ("h20", "h03", 1)]
    seeds = {"h19": (0.0, 1.0), "h20": (1.0, 0.0), "h00": (0.0, 0.0)}
    at, share = {n: k for k, n in enumerate(names)}, np.zeros((22, 22))
    for a, b, n in edges:
        share[at[a], at[b]] = n
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(
        spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame(edges, "a string, b string, n long")).collect()}
    for kind, m in enumerate((share, share.T)):
        start = np.array([seeds.get(n, (0.0, 0.0))[kind] for n in names]) * (1 - urls.DAMPING)
        total = m.sum(axis=1, keepdims=True)
        exact = np.linalg.solve(np.eye(22) - urls.DAMPING * np.divide(m, total, where=total > 0, out=np.zeros_like(m)).T, start)
        assert [got.get(n, (0, 0))[kind] for n in names] == pytest.approx(list(exact), rel=1e-5, abs=0)
    assert got["h00"][1] > 0 and got["h00"][0] == 0  # 19 links before the blocked host

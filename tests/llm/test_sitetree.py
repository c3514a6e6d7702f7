"""Page text: articles of the test pages, whole sites without telling markup,
broken markup, and the importances of a small tree by hand."""

import html
import os
import random
import re

import pytest

from llm_data import SF
from promolift.llm import sitetree as H

PAGE = "page_id long, url string, html string"


def pages(spark, sources, host="site.example.org"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", s) for i, s in enumerate(sources)], PAGE).repartition(3)


def text(source):
    return " ".join(t for _, t in H.Page(source).blocks)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def prose(i, n=40):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def test_articles_of_the_test_pages(spark):
    if not os.path.exists(SF):
        pytest.skip("test tables not present")
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        plain = " ".join(html.unescape(plain).split())
        assert got[r.page_id] == (r.url, plain, len(plain))


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain  text\n here", "plain text here"), ("a<b>b</b>c<br>d", "abc d"),
    ("<p>one<p>two</div><p>three", "one two three"),
    ("<p>1 < 2 &amp; 3 &gt; 2 &copy; &#233;&#x41;&nbsp;x &am</p>", "1 < 2 & 3 > 2 © éA x &am"),
    ("<style>p{}</style><script>var t='</p><p>no';</script><title>no</title><p>yes", "yes"),
    ("<script>never closed <p>no", ""), ("<p>yes<!-- no <p>no -->!", "yes!"), ("<p>yes<!-- never closed", "yes"),
    ("<p title='a > b' class=\"x\">yes</p><a href=\"cut", "yes"), ("<P>Up</P><Nav>no</NAV>", "Up"),
    ("<header>no</header><main><h1>Head</h1><p>yes</p></main><div>no</div>", "Head yes"),
    ("<div class='sidebar wide'>no</div><div id=cookie-notice>no</div><div class=textual>yes</div>", "yes"),
    ("<div class='page has-sidebar'><article><header><h1>Head</h1></header>yes</article><aside>no</aside></div>", "Head yes"),
    ("<article>yes<section id=comments><article class=comment>no</article></section></article>", "yes"),
    ("<form><label>no</label><input value=no><textarea>no</textarea></form><p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ("<ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><ol><li>One<li>Two</ol>", "One Two"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"), ("<article>one</article><div>no</div><article>two</article>", "one two"),
    ("<div role=navigation>no</div><body class=with-sidebar>yes <span class=ad>no</span>too", "yes too"),
    ("<p>yes<footer>no</footer><p>too</bogus></3>", "yes too"), ("<![CDATA[raw]]><?php no ?><!doctype html>", "raw"),
])
def test_markup(source, want):
    assert text(source) == want


def test_deep_and_long_markup_is_linear():
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<b>" * 50_000 + "<p>x" * 50_000).count("x") == 50_000
    assert text("<p>y</q>" * 50_000).count("y") == 50_000
    assert text("<div class=ad>" * 20_000 + "<article>z</article>" * 3) == "z z z"
    assert len(text("word " * 400_000)) == 400_000 * 5 - 1


SHELL = ("<div class=top><span>Example Site</span></div><div class=c2><p>{0}</p><p>Join our mailing list today</p></div>"
         "<div class=c3>All about us and our partners in a long closing line</div>")


def test_template_of_a_site_without_telling_markup(spark):
    got = texts(H.extract(pages(spark, [SHELL.format(prose(i)) for i in range(30)])))
    assert got == {i: prose(i) for i in range(30)}


def test_few_pages_are_no_evidence(spark):
    got = texts(H.extract(pages(spark, [SHELL.format(prose(i)) for i in range(H.MIN_PAGES - 1)])))
    assert all("mailing list" in t for t in got.values())


def test_copies_are_no_template(spark):
    copy = "".join(f"<p>{prose(900 + k)}</p>" for k in range(6))
    sources = [f"<div class=x>{copy}</div>" for _ in range(40)] + [f"<div class=x><p>{prose(i)}</p></div>" for i in range(20)]
    changed = [f"<div class=x>{copy.replace(f'w{k}', 'new', 1)}</div>" for k in range(40)]
    got = texts(H.extract(pages(spark, sources + changed)))
    assert got == {i: text(s) for i, s in enumerate(sources + changed)}


def test_sites_are_apart(spark):
    one = pages(spark, [f"<p>Shared line</p><p>{prose(i)}</p>" for i in range(12)], "a.example.org")
    other = pages(spark, [f"<p>{'Shared line' if i < 3 else prose(50 + i)}</p><p>{prose(i)}</p>" for i in range(12)], "b.example.org")
    assert all("Shared" not in t for t in texts(H.extract(one)).values())
    both = H.extract(one.union(other.selectExpr("page_id + 100 AS page_id", "url", "html")))
    assert sum("Shared" in t for t in texts(both).values()) == 3


def test_importance_by_hand(spark):
    """Ten pages: a line on five of them, one on all, the rest once each."""
    sources = [f"<p>always here</p><p>{'half the time' if i % 2 else prose(i, 400)}</p><p>{prose(100 + i, 400)}</p>" for i in range(10)]
    tree = H.style_tree(pages(spark, sources))
    assert {r.n for r in tree.collect()} == {1}
    kept = H.template_nodes(tree, threshold=0.49).collect()
    assert len(kept) == 1 and kept[0].feature is not None
    assert H.template_nodes(tree, threshold=0.51).count() == 2
    # p: ten styles alike (l = 1, entropy 0), so composite = 0.9 C
    line, half = len("always here"), len("half the time")
    mass = 10 * line + 5 * half + sum(len(prose(i, 400)) for i in range(0, 10, 2)) + sum(len(prose(100 + i, 400)) for i in range(10))
    c = (mass - 10 * line - 5 * half) * 0.9 / mass + 5 * half * 0.5 / mass
    for cut, found in ((0.9 * c + 1e-6, True), (0.9 * c - 1e-6, False)):
        nodes = [r for r in H.template_nodes(tree, threshold=cut).collect() if r.feature is None]
        assert (len(nodes) == 1) == found


def test_join_instead_of_broadcast(spark, monkeypatch):
    table = pages(spark, [SHELL.format(prose(i)) for i in range(30)])
    monkeypatch.setattr(H, "NOISE_KEYS", 0)
    assert texts(H.extract(table)) == {i: prose(i) for i in range(30)}


def test_edge_cases(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (2, "", ""), (3, "no url", "<p>b"), (3, "no url", "<p>b"),
            (4, "http://u@H.example.org:80/x", "<p>c"), (5, "//h.example.org", "x" * 300_000)]
    df = spark.createDataFrame(rows, PAGE)
    from pyspark.sql import functions as F

    df = df.withColumns({c: F.lit("z") for c in ("text", "n_chars", "site", "node", "_site", "_noise", "feature", "page")})
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [(i, u, text(h), len(text(h))) for i, u, h in rows]
    assert got == sorted(want, key=repr)
    assert H.extract(df.limit(0)).count() == 0

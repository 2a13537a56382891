"""Main text by template deduction."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from raretide.llm import templates
from raretide.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><a href="/">Home</a></header><nav><ul><li>menu {i}</li></ul></nav>
<p>Subscribe today, {i} readers did</p>{body}<aside>side</aside><form><input value=x><label>Mail</label></form>
<div class="comments"><p>nice {i}</p></div><footer>&copy; me</footer></body></html>"""


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("text", "host", "template")})
    return {(r.page_id, r.url): r for r in templates.extract_pages(df).collect()}


def test_article_blocks(spark):
    body = "<article><h1>Ti&amp;tle</h1><p>one <b>bo</b>ld&nbsp; \n two<br>three<p>a &lt; b &#233;<!-- no --><div class='ad'>buy</div></article>"
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, body=body)) for i in range(5)]
    for r in extract(spark, rows).values():  # equal articles on every page are still articles
        assert r.text == "Ti&tle\n\none bold two three\n\na < b é" and r.n_chars == len(r.text)


def test_template_text_goes_where_no_article_is_marked(spark):
    rows = [(i, f"http://b.example/{i}", PAGE.format(i=i, body=f"<div class=x><p>Shared words here.</p><p>Own text {'abcdef'[i]}</p></div>")) for i in range(6)]
    rows += [(9, "http://lonely.example/", "<p>only page</p>")]
    got = extract(spark, rows)
    assert got[9, "http://lonely.example/"].text == "only page"
    assert got[2, "http://b.example/2"].text == "Own text c"  # digits are no difference between template texts


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://c.example", ""), (2, "http://c.example", ""), (None, "x", "<p>a"), (4, "y", "a < b <p"), (5, "z", "<article>" + "<p>w</p>" * 5000),
            (6, "u", "<script>never closed <p>x"), (7, "v", "</p></div>text</article>"), (8, "w", "<table><tr><td>a<td>b<tr><td>c</table>")]
    got = extract(spark, rows)
    assert got[1, None].text == "" and got[1, None].n_chars == 0 and got[2, "http://c.example"].text == ""
    assert got[None, "x"].text == "a" and got[4, "y"].text == "a < b <p"
    assert got[5, "z"].text.count("w") == 5000 and got[6, "u"].text == "" and got[7, "v"].text == "text"
    assert got[8, "w"].text == "a\n\nb\n\nc"
    assert templates.extract_pages(table(spark, SMALL, "pages").where("false")).collect() == []


def test_given_pages(spark):
    """On the given pages the article element holds the article: a cut by string search gives the same blocks."""
    import html
    import re

    for r in templates.extract_pages(table(spark, SMALL, "pages")).join(table(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("pages, expected", [(2, 0), (3, 1)])
def test_support(spark, pages, expected):
    rows = [(i, f"http://d.example/{i}", "<html><body><p>same</p></body></html>" + " " * i) for i in range(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert templates.host_templates(df).count() == expected


def test_nested_classes(spark):
    """Items repeat alike on all pages and lie between the page's own tags: their class is nested in the page's."""
    rows = [(i, f"http://e.example/{i}", "<html><body><ul>" + f"<li><i>k</i>{i}</li>" * 2 + "</ul></body></html>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    members = templates.host_templates(df).first().template
    depth = {m["class"]: m["depth"] for m in members}
    assert sorted(depth.values()) == [0, 1]

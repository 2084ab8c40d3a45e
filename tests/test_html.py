"""Main content of pages at which patterns fail, by the standard's rules."""

from __future__ import annotations

import pytest

from marlstone.functions.html import main_content, page_content
from marlstone.plans import texts


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><p>b</p>", "ab"),
        ("<body>a <nav>x<nav>y</nav>z</nav> b</body>", "a b"),
        ("<div>a<nav>x<p>y</div>b", "ab"),  # what holds an unclosed element ends it
        ("a<footer>x", "a"),
        ("a<script>if (1 < 2) document.write('<p>x</p><!--')</script>b", "ab"),
        ("a<!-- <script> -->b<!-- </script> -->c", "abc"),
        ("a<style>p > b { }</style>b<noscript><p>x</p></noscript>c<iframe><nav>x</iframe>d", "abcd"),
        ("<head><title>t</title><meta charset=x>", ""),
        ("<head><title>t</title><p>a", "a"),  # a head without an end
        ("<html><head><title>t</title></head><body>a</body></html> b", "a b"),
        ("<b><nav>x</b>y</nav>z", "z"),
        ("<span><nav>x</span>y</nav>z", "z"),
        ("<ul><li>a<li><nav>x</ul>b", "ab"),
        ("<table><tr><td><nav>x</td><td>a</td></table>b", "ab"),
        ("a</nav>b</p>c", "abc"),
        ("a<img alt='<p>x</p>' src=y>b<br/>c<nav/>x</nav>d", "abcd"),
        ("a &lt;b&gt; &amp;amp; &copy; &nbsp; c\n\t d é e", "a <b> &amp;  c d  e"),
        ("<NAV>x</NAV>A<Script>x</SCRIPT>", "A"),
        ("plain", "plain"), ("", ""), ("a < b <", "a < b <"),
    ],
)
def test_goldens(page, want):
    assert main_content(page) == want


def test_column(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (3, "<nav>" * 3000 + "x" + "</nav>" * 3000 + "b")], "k int, html string")
    assert {r["k"]: r["c"] for r in df.select("k", page_content(df["html"]).alias("c")).collect()} == {1: "a", 2: None, 3: "b"}


def test_references_without_a_semicolon():
    """By the standard some references need none; page_text, like its SQL, takes only closed ones."""
    page = "<h1>a &amp;&amp</h1><p>b &lt;i&gt; &ampc; &#38; &#38 &nope; &copy 1</p>"
    assert main_content(page) == "a &&b <i> &c; & & &nope;  1"
    assert main_content(page, closed_only=True) == "a &&ampb <i> &ampc; & &#38 &nope; &copy 1"


def test_page_text_of_references_that_are_cut_off(spark, tmp_path, duck):
    spark.sql("SELECT 1L AS page_id, 'u' AS url, '<h1>the&amp;&amp</h1><p>of&am</p>' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    sql = texts.ORACLE_SQL["page_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in texts.page_text(spark, str(tmp_path)).collect()] == duck.sql(sql).fetchall() == [(1, "the&&ampof&am")]

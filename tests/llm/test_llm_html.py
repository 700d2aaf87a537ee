"""Visible text of small pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeria.llm.html_text import extract, visible_text

CASES = {
    "blocks": ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    "headings": ("<h1>A</h1>text<h2>B</h2><p>c", "A\n\ntext\n\nB\n\nc"),
    "spaces": ("<p>  a \n b <b> c</b> d<b>e </b> f", "a b c de f"),
    "break": ("a<br>b<br/>c", "a\nb\nc"),
    "entities": ("&lt;a&gt; &amp; &eacute;&#233;&nbsp;x", "<a> & éé x"),
    "head and scripts": ("<html><head><title>T</title><style>p{x:y}</style></head><body><script>if (a<b) '</p>'</script>x<!-- c --><noscript>n</noscript><template>t</template></body>", "x"),
    "head left open": ("<head><title>T</title><p>x", "x"),
    "hidden": ("<p hidden>a</p><p style='display: none'>b</p><p style=\"visibility:hidden\">c</p><input type=hidden value=d><p>e", "e"),
    "hidden by rule": ("<style>.ad, #x{display:none} p.no{visibility:hidden}</style><div class='big ad'>a</div><i id=x>b</i><p class=no>c<p class=yes>d", "d"),
    "details": ("<details><summary>s</summary>inside</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    "list": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  * c\n- d"),
    "numbers": ("<ol start=9><li>a</li><li>b<p>c</p></li></ol>x", "9. a\n10. b\n\n    c\n\nx"),
    "empty item": ("<ul><li></li><li>b</ul>", "-\n- b"),
    "table": ("<table><tr><td>a<td>bbb<tr><th>cccc</th><td>d</table>", "a     bbb\ncccc  d"),
    "spans": ("<table><tr><td colspan=2>wide cell here</td><td>x</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>", "wide cell here  x\na  b            c"),
    "lines in cells": ("<table><td>a<br>b</td><td>c</td></table>", "a  c\nb"),
    "cell without row": ("<table><tbody><td>a</td><td>b</td></table>z", "a  b\n\nz"),
    "nested table": ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "a  b  c"),
    "pre": ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    "unclosed tag": ("a<b>c<i title='x", "ac"),
    "stray": ("a < b > c </i></p><//x>d", "a < b > c\n\nd"),
    "attributes": ("<p title='a>b' x=\"</p>\">ok</p>", "ok"),
    "misnested": ("<p><b>x<br></article><p>y</b>z", "x\n\nyz"),
    "select": ("<select><option>a<option selected>b<option>c</select><textarea>t</textarea><button>go</button>", "btgo"),
    "definition": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    "comment": ("a<!-->b<!-- x -- > y -->c<!-- open", "abc"),
    "case": ("<P>a</P><SCRIPT>x</ScRipt><UL><LI>b</UL>", "a\n\n- b"),
    "text ends an open head": ("<head><title>T</title>Hello <b>world</b><p>x", "Hello world\n\nx"),
    "inline element ends an open head": ("<head> <meta charset=utf-8>\n<a href=u>link</a> y<style>p{}</style>z", "link yz"),
    "head goes on": ("<head><title>T</title> <script>s</script><link rel=x><noscript><p>n</p></noscript><template>t<b>u</b></template></head>x", "x"),
    "rules for other media": ("<style>@import 'x'; @media print{.a{display:none}} @media (max-width:600px){.b{display:none}} @media screen and (min-width:30em){.c{display:none}} @media not print{.d{display:none}} /* .e{display:none} */ @keyframes k{from{visibility:hidden}}</style><style media=print>.e{display:none}</style><p class=a>a<p class=b>b<p class=c>c<p class=d>d<p class=e>e", "a\n\nb\n\ne"),
    "later rules": ("<style>.a{display:none}.a{display:block}p{display:none}.b{display:block}.c{display:none!important}#c{display:block}.d{display:none}</style><p class=a>a<p class=b>b<p class=c id=c>c<p class=d style='display:block'>d<p>e<div hidden class=a>f</div>", "a\n\nb\n\nd\n\nf"),
    "visible inside": ("<style>.v{visibility:hidden}.w{visibility:visible}</style><div class=v>a <b class=w>b <i>c</i></b> d<p>e</div><ul style='visibility:hidden'><li>f<li style='visibility:visible'>g</ul>", "b c\n\n- g"),
    "empty": ("", ""),
    "nothing shown": ("<script>x</script>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, text = CASES[name]
    assert visible_text(html) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<ul><li>" * 300 + "x").endswith("x")
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"
    assert len(visible_text("<p>word " * 50_000)) == 6 * 50_000 - 2
    for odd in ("<" * 100_000, "<a " * 50_000, "<a b='" * 30_000, "<!--" * 50_000, "</" * 50_000):
        assert isinstance(visible_text(odd), str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> <b> </b> <table> <tr> <td> </table> <li> <ul> </ul> <ol> <pre> </pre> x y\n &amp; <br> <select> <option> </td> <dl> <dd> <details> <a".split(" ") + ["'", '"', ">", "<"]), max_size=25).map("".join))
def test_any_markup_gives_text(html):
    text = visible_text(html)
    assert isinstance(text, str) and not text.startswith("\n") and not text.endswith("\n")


def test_pages_keep_their_columns(spark):
    rows = [(1, "<p>a", "old"), (2, None, "old"), (3, "", "old"), (1, "<p>a", "old")]
    made = extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert sorted(((r.page_id, r.text) for r in made.collect()), key=str) == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert extract(made.limit(0)).collect() == []

import pytest
from candlemill.llm.html_text import extract_text, render


@pytest.mark.parametrize("html,text", [
    ("<p>a<p>b <b>c</b>\n d", "a\n\nb c d"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n\n  - in\n- three"),
    ("<ol start=3><li>x<li value=7>y<li>z</ol>", "3. x\n7. y\n8. z"),
    ("<table><tr><td>a<td>bbbb<tr><td>cccc<td>d</table>", "a     bbbb\ncccc  d"),
    ("<table><thead><tr><th>k<th>v<tbody><tr><td>x<td><p>1<p>2</table>after", "k  v\nx  1\n\n   2\n\nafter"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("a<script>if (x < y) { '</p>' }</script>b<style>p{}</style><!-- c --><noscript>n</noscript>", "ab"),
    ("<p hidden>x</p><p style='Display : NONE'>x</p><p style=\"visibility:hidden\">x</p><input type=hidden value=x>y", "y"),
    ("<pre>\n a\n   b &lt;\n</pre>c", " a\n   b <\n\nc"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("&amp &copy; &lt;b&gt; &#233; a&nbsp;b", "& © <b> é a b"),
    ("<a href='x>y'>link</a> <a title=\"q\"unfinished", "link"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    ("</p>x</div></span>y", "xy"),
    ("1 < 2 and 3 > 2 <", "1 < 2 and 3 > 2 <"),
    ("<h1>t<h2>u</h2>v", "t\n\nu\n\nv"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<hr>a<hr>", "---\n\na\n\n---"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<![CDATA[raw <b>]]> x", "raw <b> x"),
    ("", ""),
])
def test_layout(html, text):
    assert render(html) == text


def test_depth_and_length_lose_no_text():
    deep = "".join(f"<div>w{i} " for i in range(5000))
    assert render(deep).split() == [f"w{i}" for i in range(5000)]
    assert len(render("<p>" + "long " * 200_000)) == 5 * 200_000 - 1
    assert render("<table>" + "<tr><td>a<td>b" * 2000 + "</table>").count("\n") == 1999


@pytest.mark.parametrize("outer", ["<div>", "<span>", "<a name=x>", "<font>"])
@pytest.mark.parametrize("depth", [130, 20_000])
def test_depth_keeps_visibility_and_layout(outer, depth):
    deep = outer * depth
    for inner in ("<div hidden>x<div>x</div>x</div>", "<p style='display:none'>x</p>", "<svg><text>x</text></svg>", "<template><b>x</b></template>"):
        assert render(deep + inner + "y") == "y"
    assert render("<div hidden>" + deep + "<div>x</div>x</div>z") == ("" if outer == "<div>" else "z")
    assert render(deep + "<ul><li>a<li>b</ul>") == "- a\n- b"
    assert render(deep + "<table><tr><td>a<td>bbbb<tr><td>cccc<td>d</table>") == "a     bbbb\ncccc  d"
    assert render(deep + "<pre> a\n  b</pre>") == " a\n  b"


def test_pages(spark):
    rows = [(1, "u", "<p>é"), (2, None, None), (None, "u", ""), (1, "u", "<p>é")]
    out = extract_text(spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "é", "é"]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

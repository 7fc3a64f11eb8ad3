"""Markdown: stated places of words, cases of the public format, places that hold their words, linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import markdown as M


def plain(source):
    """The rendered page without the words' spans."""
    return re.sub(r'<span data-orig-start="\d+" data-orig-end="\d+">([^<]*)</span>', r"\1", M.render(source))


def test_places_are_code_points_of_the_source():
    assert '<span data-orig-start="2" data-orig-end="5">мир</span>' in M.render("🌍 мир")
    twice = M.render("🌍 мир\n\nмир")
    assert '<span data-orig-start="2" data-orig-end="5">мир</span>' in twice and '<span data-orig-start="7" data-orig-end="10">мир</span>' in twice
    assert '<span data-orig-start="11" data-orig-end="14">мир</span>' in M.render("```\n🌍\n```\n\nмир")


CASES = {
    "": "",
    "# Head #\n\nTwo\n===\nThree\n---": "<h1>Head</h1>\n<h1>Two</h1>\n<h2>Three</h2>\n",
    "*em* **strong** ***both*** ~~del~~ `co*de`": "<p><em>em</em> <strong>strong</strong> <em><strong>both</strong></em> <s>del</s> <code>co*de</code></p>\n",
    "**foo*bar** _a_b_ __c__ a * b *": "<p><strong>foo*bar</strong> <em>a_b</em> <strong>c</strong> a * b *</p>\n",
    "*foo**bar*": "<p><em>foo**bar</em></p>\n",
    "a\nb  \nc\\\nd": "<p>a<br>\nb<br>\nc<br>\nd</p>\n",
    "- one\n- two\n  - three\n\n    more\n- four": "<ul>\n<li>one</li>\n<li>two<ul>\n<li><p>three</p>\n<p>more</p>\n</li>\n</ul>\n</li>\n<li>four</li>\n</ul>\n",
    "3) x\n4) y\n\n\n- z": '<ol start="3">\n<li>x</li>\n<li>y</li>\n</ol>\n<ul>\n<li>z</li>\n</ul>\n',
    "- a\n\n- b": "<ul>\n<li><p>a</p>\n</li>\n<li><p>b</p>\n</li>\n</ul>\n",
    "> quote\nlazy\n\n> - l\n>   m": "<blockquote>\n<p>quote<br>\nlazy</p>\n</blockquote>\n<blockquote>\n<ul>\n<li>l<br>\nm</li>\n</ul>\n</blockquote>\n",
    '[t *e*](http://e.com "ti") ![al *t*](x.png) [ref] [r][REF]\n\n[ref]: /url \'T\'': '<p><a href="http://e.com" title="ti">t <em>e</em></a> <img src="x.png" alt="al t"> <a href="/url" title="T">ref</a> <a href="/url" title="T">r</a></p>\n',
    "[a](javascript:x) [b](<u v>) [c [d](e) f](g)": '<p>[a](javascript:x) <a href="u v">b</a> [c <a href="e">d</a> f](g)</p>\n',
    "a\\*b &amp; &copy; <b>no</b> <http://auto.it> <me@x.org>": '<p>a*b &amp; © &lt;b&gt;no&lt;/b&gt; <a href="http://auto.it">http://auto.it</a> <a href="mailto:me@x.org">me@x.org</a></p>\n',
    "see http://x.com/a_b. (www.y.org)": '<p>see <a href="http://x.com/a_b">http://x.com/a_b</a>. (<a href="http://www.y.org">www.y.org</a>)</p>\n',
    "| a | b |\n|:--|--:|\n| 1 | *2* \\| |\n| 3 |": '<table>\n<thead>\n<tr>\n<th style="text-align:left">a</th>\n<th style="text-align:right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align:left">1</td>\n<td style="text-align:right"><em>2</em> |</td>\n</tr>\n<tr>\n<td style="text-align:left">3</td>\n<td style="text-align:right"></td>\n</tr>\n</tbody>\n</table>\n',
    "    code <\n\n    more\ntext": "<pre><code>code &lt;\n\nmore\n</code></pre>\n<p>text</p>\n",
    "```js\nlet a;\n": '<pre><code class="language-js">let a;\n</code></pre>\n',
    "~~~ mermaid\na --> b\n~~~": '<div class="mermaid">a --&gt; b\n</div>\n',
    "x\n***\n`` ` `` ```y": "<p>x</p>\n<hr>\n<p><code>`</code> ```y</p>\n",
    "ab\tc\n\n\tcode": "<p>ab\tc</p>\n<pre><code>code\n</code></pre>\n",
    "a\r\nb": "<p>a<br>\nb</p>\n",
    "[x]: /y\n# h\n[x]": '<h1>h</h1>\n<p><a href="/y">x</a></p>\n',
}


@pytest.mark.parametrize("source", CASES)
def test_stated_pages(source):
    assert plain(source) == CASES[source]


PARTS = ["word ", "два ", "\n", "\n\n", "*", "**", "_", "`", "``", "[", "](u)", "]", "![", "- ", "1. ", "> ", "# ", "    ", "\t", "|", "|-|-|\n", "```\n", "~~", "\\", "&amp;", "<", "http://a.b/c", "🌍", "---\n", "[r]: /x\n", "[r]", "===\n", ")"]


def pages(n=600):
    rng = random.Random(11)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]


def test_places_hold_their_texts():
    for page in pages():
        for text, place in M.text_tokens(page):
            assert place is None or page[place : place + len(text)] == text
        unescape = lambda x: x.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
        at = 0
        for start, end, word in re.findall(r'<span data-orig-start="(\d+)" data-orig-end="(\d+)">([^<]*)</span>', M.render(page)):
            assert page[int(start) : int(end)] == unescape(word) and int(start) >= at
            at = int(end)


def test_tags_are_closed_in_order():
    for page in pages():
        stack = []
        for closing, tag in re.findall(r"<(/?)([a-z0-9]+)[^>]*>", M.render(page)):
            if tag in ("br", "hr", "img"):
                continue
            assert not closing or stack and stack.pop() == tag, page
            if not closing:
                stack.append(tag)
        assert not stack


@pytest.mark.parametrize("part", ["*a ", "**a* ", "[", "[a](", "]", "`" + "a", "> ", "- ", "![", "<a", "_a*b_", "| a ", "[a](b) [", "&x", "\\", "www.", "~~a "])
def test_time_is_linear(part):
    took = []
    for n in (3_000, 12_000):
        began = time.process_time()
        M.render(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.3


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a *b* &lt; c\\*")], "id int, x string")
    got = df.select("id", M.rendered_markdown(F.col("x")).alias("page"), M.markdown_tokens(F.col("x")).alias("tokens"), M.markdown_words(F.col("x")).alias("words")).orderBy("id").collect()
    assert got[0].page is None and got[0].tokens is None and got[1].page == "" and got[1].tokens == []
    assert [tuple(t) for t in got[2].tokens] == [("a ", 0), ("b", 3), (" < c*", None)]
    assert [tuple(w) for w in got[2].words] == [("a", 0, 1), ("b", 3, 4)]


def test_query(spark):
    from lectern.plans.text_queries import markdown_words

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = markdown_words(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 10_000 and all(texts[r.doc_id][r.start : r.end_pos] == r.word for r in rows)


def test_words_come_as_rows_from_arrow(spark):
    from lectern.plans.text_queries import markdown_words

    plan = markdown_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Repartition" in plan  # no arrays of structs, and small tables are spread
    source = "# One *two*\n\ntwo  &amp; three"
    assert [source[a:z] for _, a, z in M.word_spans(source)] == [w for w, _, _ in M.place_tokens(source, [t for t, _ in M.text_tokens(source)])]
    assert [i for i, _, _ in M.word_spans(source)] == list(range(len(M.word_spans(source)))) and M.word_spans("") == []

"""Sanitised pages: nothing forbidden, nothing changed the second time, places that lead back to the source."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lectern.operators import markup as M
from lectern.operators.extraction import read_html
from lectern.plans.text_queries import sanitized_html

FRAGMENTS = [
    "<p>", "</p>", "<p onclick='x()'>", "<b>", "</b>", "<script>alert('<p>1</p>')</script>", "<script>", "</script>", "<style>p{}</style>", "<a href='javascript:alert(1)'>", "<a href=\"https://e.com/?a=1&amp;b=2\">", "</a>",
    "<a href='jAva\tscript:x'>", "<img src=x onerror=alert(1)>", "<img src='data:image/png;base64,AA'>", "<a href='data:text/html,x'>", "<iframe src=x>in</iframe>", "<object data=x>o</object>", "<embed src=x>", "<form action=/x>", "</form>", "<input name=q>",
    "text &lt;script&gt; & é 日本 ", "\n", "<!-- c -->", "<!doctype html>", "<ul><li>one<li>two", "</ul>", "<table><tr><td>1<td>2", "</table>", "<div style='x' data-k='v' aria-label=\"a&quot;b\">", "</div>", "<unknown>", "</unknown>", "<svg><script>x</script></svg>",
    "<textarea><b>x</b>&amp;</textarea>", "<title>t</title>", "<br>", "<hr/>", "&nbsp;", "<", ">", "\"", "<noscript><p>n</p></noscript>", "<math><mi>x</mi></math>", "<p title='</p><script>x</script>'>", "<template><p>t</p></template>",
    "<img srcset='a.png 1x, javascript:x 2x'>", "<video controls src=v.mp4>", "</video>", "<button>go</button>", "<a href='/rel'>", "<x", "</", "<b",
]


class Seen(HTMLParser):
    def __init__(self):
        super().__init__()
        self.bad = []

    def handle_starttag(self, tag, attrs):
        if tag not in M.ELEMENTS:
            self.bad.append(tag)
        for k, v in attrs:
            if k.startswith("on") or k == "style" or k in M.URLS and not M.safe_url(tag, v):
                self.bad.append((tag, k, v))
        if tag == "textarea":
            self.set_cdata_mode(tag)


def pages(n=400):
    rng = random.Random(4)
    return ["".join(rng.choices(FRAGMENTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_nothing_forbidden_is_left_and_the_second_time_changes_nothing():
    for page in pages():
        clean, seen = M.sanitize(page), Seen()
        seen.feed(clean), seen.close()
        assert not seen.bad and M.sanitize(clean) == clean
        assert read_html(M.wrap_words(clean))[0] == read_html(clean)[0]


def test_stated_cases():
    stripped = lambda x: re.sub("<[^>]+>", "", x)
    assert M.sanitize("<p>ok</p><script>alert(1)</script>") == "<p>ok</p>"
    assert M.sanitize('<p>ok</p><iframe src="https://evil.example"></iframe><object data="evil.swf"></object><embed src="evil.swf">') == "<p>ok</p>"
    assert M.sanitize('<p onclick="alert(1)">x</p><img src="https://example.com/a.png" onerror="alert(2)">') == '<p>x</p><img src="https://example.com/a.png">'
    assert M.sanitize('<a href="javascript:alert(1)">link</a>') == "<a>link</a>"
    assert M.sanitize("<p><b>bold</b></p><pre><code>const x = 1;</code></pre>") == "<p><b>bold</b></p><pre><code>const x = 1;</code></pre>"
    assert M.sanitize('<a href="https://example.com">link</a>') == '<a href="https://example.com">link</a>'
    assert stripped(M.sanitize('<pre><code class="language-rust">fn main() {}</code></pre>')) == "fn main() {}"
    assert M.sanitize("<form><p>kept</p><input></form>") == "<p>kept</p>"
    assert M.sanitize("<p>a<p>b<ul><li>c<li>d") == "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>"
    assert M.sanitize("") == ""


def test_words_are_wrapped_where_the_text_has_them():
    out = M.wrap_words(M.sanitize("<p>Вызови <code>API</code></p>"))
    assert out == '<p><span data-orig-start="0" data-orig-end="6">Вызови</span> <code><span data-orig-start="7" data-orig-end="10">API</span></code></p>'
    out = M.wrap_words(M.sanitize("<div><button>Купить</button><p>Текст &amp; 🌍</p></div>"))
    assert "<button>Купить</button>" in out and '<span data-orig-start="6" data-orig-end="7">&amp;</span>' in out
    for page in pages(100):
        clean = M.sanitize(page)
        text = read_html(clean)[0]
        for start, end, word in re.findall(r'<span data-orig-start="(\d+)" data-orig-end="(\d+)">([^<]*)</span>', M.wrap_words(clean)):
            assert text[int(start) : int(end)] == word.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def test_inert_content():
    assert M.sanitize("<button>go</button><select><option>a</option></select><textarea>t</textarea><input type=text><fieldset>f</fieldset>", inert=True) == (
        '<button disabled="" tabindex="-1">go</button><select disabled="" tabindex="-1"><option disabled="" tabindex="-1">a</option></select>'
        '<textarea disabled="" tabindex="-1">t</textarea><fieldset disabled="" tabindex="-1">f</fieldset>'
    )
    assert M.sanitize('<video controls src="v.mp4"></video><audio controls src="a.mp3"></audio>', inert=True) == '<video src="v.mp4"></video><audio src="a.mp3"></audio>'
    assert M.sanitize('<a href="/ru/users/maybe_elf/">l</a>', inert=True) == '<a href="/ru/users/maybe_elf/" title="/ru/users/maybe_elf/">l</a>'


def test_places_lead_back_to_the_source():
    page = "<div onclick=x>\n<p>one &amp; two<script>no</script> three</p></div>"
    found = M.Sanitizer().read(page)
    clean = "".join(found.out)
    assert page[slice(*M.source_place(found.places, clean.index("two")))] == "one &amp; two"
    assert page[slice(*M.source_place(found.places, clean.index("three")))] == " three"
    assert page[slice(*M.source_place(found.places, 0))] == "<div onclick=x>" and M.source_place([], 3) is None
    for page in pages(100):
        places = M.Sanitizer().read(page).places
        assert all(a <= z for a, z, _, _ in places) and all(0 <= a <= z <= len(page) for _, _, a, z in places)
        assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(places, places[1:]))


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p onclick=x>a</p>")], "id int, page string")
    at = M.sanitized_with_places(F.col("page"))
    got = df.select("id", M.sanitized(F.col("page")).alias("clean"), at.alias("at"), M.words_wrapped(M.sanitized(F.col("page"))).alias("wrapped")).orderBy("id").collect()
    assert [r.clean for r in got] == [None, "", "<p>a</p>"] and got[0].wrapped is None and got[2].wrapped == '<p><span data-orig-start="0" data-orig-end="1">a</span></p>'
    assert [tuple(x) for x in got[2]["at"].places] == [(0, 3, 0, 13), (3, 4, 13, 14), (4, 8, 14, 18)]


def test_query(spark):
    rows = sanitized_html(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    for r in rows:
        assert r.clean is None or M.sanitize(r.clean) == r.clean


def test_time_is_linear():
    import time

    page, took = "<div><p>text &amp; <b>more</b> <unknown>x</unknown><script>y</script>", []
    for n in (2_000, 8_000):
        began = time.process_time()
        M.sanitize(page * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5

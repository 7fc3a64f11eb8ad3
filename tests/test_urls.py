from pyspark.sql import functions as F

from lectern.functions import urls as U


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1).select(f(F.col("t"))).collect()]


def test_percent_signs(spark):
    texts = ["a%20b", "%D0%BE%D1%82", "%D0%zz%", "100%", "%ff%FE", "a+b", None, ""]
    assert one(spark, U.percent_decode, *texts) == ["a b", "от", "%d0%zz%", "100%", "%ff%fe", "a+b", None, ""]
    assert one(spark, lambda c: U.percent_decode(c, True), "a+b%2B") == ["a b+"]


def test_urls(spark):
    texts = ["https://s3.example.com:8080/a-b/v1.2/?q=1+2&x&y=#top", "ftp://x", "no url", "https://github.com/%F0%9F%98%80/x"]
    assert one(spark, U.url_reading, *texts) == [
        "эйч ти ти пи эс двоеточие слэш слэш с три точка экзампл точка ком двоеточие восемь тысяч восемьдесят слэш а б слэш в один точка два вопросительный знак к равно один два и равно  решётка топ",
        "эф ти пи двоеточие слэш слэш кс", "no url", "эйч ти ти пи эс двоеточие слэш слэш гитхаб точка ком слэш кс",
    ]


def test_addresses_and_paths(spark):
    assert one(spark, U.email_reading, "a.b_c-d+e1@mail.ru", "x") == ["а точка б андерскор к дефис д плюс е один собака мэйл точка ру", "x"]
    paths = ["/home/.config/a-b.tar.gz", "~/x/..", "C:\\dir\\f.txt", "/.hidden.txt", "//a"]
    assert one(spark, U.path_reading, *paths) == [
        "слэш хоум слэш точка конфиг слэш а дефис б точка тар точка гз", "тильда слэш кс слэш точка точка", "си двоеточие бэкслэш дир бэкслэш ф точка тэкст",
        "слэш точка хидден точка тэкст", "слэш слэш а",
    ]


RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_are_resolved(spark):
    rows = [(x, "http://a/b/c/d;p?q") for x in RFC] + [("x", None), ("x", "no scheme"), (None, "http://a/"), ("x", "http://a"), ("?q", "http://a")]
    got = spark.createDataFrame(rows, "url string, base string").select("url", "base", U.resolve_url(F.col("url"), F.col("base")).alias("found")).collect()
    assert {r.url: r.found for r in got[: len(RFC)]} == RFC
    assert [r.found for r in got[len(RFC) :]] == ["x", "x", None, "http://a/x", "http://a?q"]
    rows = [("//cdn.example.org/x.png", "https://site.com/"), ("/img/x.png", "https://site.com/post/"), ("https://example.com/a", "https://site.com/"), ("//HOST.org", "HTTPS://site.com/"), ("", "http://a")]
    got = spark.createDataFrame(rows, "url string, base string").select(U.resolve_url(F.col("url"), F.col("base"), browser=True).alias("x")).collect()
    assert [r.x for r in got] == ["https://cdn.example.org/x.png", "https://site.com/img/x.png", "https://example.com/a", "https://host.org/", "http://a/"]


def test_links_of_pages(spark):
    from urllib.parse import urljoin

    from lectern.plans.text_queries import resolved_links

    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()}
    rows = resolved_links(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.resolved == (urljoin(urls[r.page_id], r.target) if urls[r.page_id] and "://" in urls[r.page_id] else r.resolved) for r in rows)

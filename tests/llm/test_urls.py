import random
import re

from lectern.llm import urls


def brute(rows, rules, default="allow"):
    out = []
    for k, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((k, host, path, best[2], best[3]))
    return sorted(out, key=repr)


def run(spark, rows, rules):
    pages = spark.createDataFrame([(k, u, "h", "r", "k") for k, u in rows], "page_id long, url string, host string, rule string, key string")
    return sorted(((r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()), key=repr)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("b.net", "/", "allow"), ("a.b.net", "/x", "block"), ("b.net", "/xyz", "allow"), ("com", "/", "block"), (None, "/", "block")]


def test_like_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, r.choice(["http", "HTTPS", ""]) + r.choice(["://", "://", ":/"]) + ".".join(r.choices(["www", "example", "Com", "com", "a", "b", "net", "É", ""], k=r.randint(0, 5))) + r.choice(["", "/", "?q=/en/", "#/", "/en/", "/EN/", "/fr/x", "/xyz", "/x?y", ":80/en/", "/en"])) for i in range(400)]
    rows += [(1, None), (None, "http://www.example.com/en/"), (2, ""), (3, "x://a://b.com/"), (3, "x://a://b.com/"), (4, "http://" + "a." * 3000 + "com/" + "p" * 5000), (5, "a\n://x.com/")]
    assert run(spark, rows, RULES) == brute(rows, RULES)
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert run(spark, rows[:50], RULES) == brute(rows[:50], RULES)


def test_empty(spark):
    assert run(spark, [], RULES) == []
    assert run(spark, [(1, "http://a.com/")], []) == [(1, "a.com", "/", None, "allow")]

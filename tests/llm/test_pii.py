import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from lectern.llm import pii
from lectern.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(digits[::-1])]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def found(text):
    return [f"{k}:{a}:{z}" for k, a, z, _ in pii.scored(text) if k in pii.BASE]


def test_base_spans_like_the_patterns():
    r = random.Random(3)
    for alphabet in ("ab.@-1+ ", "0123456789. -+()", "a1@b.c@d_é ", "4 1-", "12.3.255.0"):
        for _ in range(4000):
            text = "".join(r.choices(alphabet, k=r.randint(0, 40)))
            assert found(text) == brute(text), text
    for text in ("4111 1111 1111 1111 and 4111-1111-1111-1112", "é😀 x@y.zz +1 (532) 555-7857.", "00000000300.1.1.1 0000000000010.1.1.1"):
        assert found(text) == brute(text)


def test_iban_by_checksum():
    assert "iban" in [x[0] for x in pii.scored("Konto DE89 3704 0044 0532 0130 00, danke")]
    assert "iban" not in [x[0] for x in pii.scored("DE88370400440532013000")]


def test_context_raises_the_score():
    plain, near = pii.scored("zzz 10.0.0.1 zzz")[0], pii.scored("server 10.0.0.1 zzz")[0]
    assert near[3] > plain[3]


def test_context_decides_for_kinds_below_the_threshold():
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    kinds = lambda text: [x[0] for x in pii.scored(text)]
    assert kinds(f'token = "{key}" x') == ["secret"] and kinds(f"commit {key} x") == []
    assert kinds("my ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 666-45-6789, 123-00-6789") == []
    assert kinds("token " + "a" * 60) == [] and kinds("token " + "1" * 60) == [] and kinds("password " + "ab1" * 20) == []
    assert all(pii.THRESHOLD <= x[3] <= 1 for x in pii.scored(f"secret {key} key"))


def test_context_words_are_whole():
    digest = "3f5e8a1b9c7d2e4f6a8b0c1d3e5f7a9b1c3d5e7f"
    kinds = lambda text: [x[0] for x in pii.scored(text)]
    for word in ("author", "monkey", "script", "keyboard", "donkey_ride"):
        assert kinds(f"{word} {digest}") == []
    for text in (f"api_key={digest}", f"KEY: {digest}", f"{digest} is the token", f"auth{' ' * 30}{digest}", f"mot de passe, clé: {digest}"):
        assert kinds(text) == ["secret"]
    assert kinds(f"mon{'key'}{' ' * 37}{digest}") == [] and kinds(f"key{' ' * 41}{digest}") == []  # the edge of the context does not cut a word
    assert kinds(f"key{' ' * 39}{digest}") == ["secret"] and kinds(f"{digest}{' ' * 38}keyboard") == [] and kinds(f"{digest}{' ' * 38}key") == ["secret"]


def test_masking():
    text = "a x@y.zz b 4111111111111111"
    assert pii.masked(text, pii.scored(text)) == "a [EMAIL] b [CARD]"


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("aB1/" * 25 * 10**4, "123-45-6789-" * 10**5, "a" * 10**6, "1" * 10**6, "1." * 5 * 10**5, "a@" * 5 * 10**5, "+1" + " " * 10**6, "A1" * 5 * 10**5, "AB12 " * 2 * 10**5):
        pii.scored(text)
    assert time.time() - began < 20


def test_query(spark, tmp_path):
    rows = [(1, "a@b.cc 10.0.0.1"), (1, "a@b.cc 10.0.0.1"), (2, None), (None, ""), (3, "+1 (532) 555-7857 DE89370400440532013000")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in op6_pii(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(",".join(brute(t or "")).encode()).hexdigest()
    assert got == {(1, 1, 1, 0, 0, sha(rows[0][1])), (2, 0, 0, 0, 0, sha("")), (None, 0, 0, 0, 0, sha("")), (3, 0, 0, 0, 1, sha(rows[4][1]))}
    assert op6_pii(spark, str(tmp_path)).count() == 5

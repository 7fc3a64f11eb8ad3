import random

from pyspark.sql import functions as F

from lectern.functions import strings as S
from lectern.operators import extraction as X

# Pages and what is read of them; chunks with their starts; what is left of line breaks; what a voice gets.
PAGES = [
    ("<p>Вызови <code>getUserData()</code> через <b>API</b></p>", "Вызови getUserData() через API"),
    ("<nav>Меню</nav><button>Купить</button><script>var x = 1;</script><p>Текст</p>", "Текст"), ("<p>Раз</p><p>Два</p>", "Раз\nДва"),
    ("<div>строка<br>ещё</div>", "строка\nещё"), ("<ul><li>первый</li><li>второй</li></ul>", "первый\nвторой"),
    ("<table><tr><td>a1</td><td>b1</td></tr><tr><td>a2</td><td>b2</td></tr></table>", "a1\nb1\na2\nb2"), ("<p>a  b   c</p>", "a b c"),
    ("<p>a\n\t b</p>", "a b"), ("<p>a &amp; b &lt;c&gt;</p>", "a & b <c>"), ("<p>   </p><div></div>", ""), ("<p>Вызови<code>API</code></p>", "ВызовиAPI"),
    ("<head><title>t</title></head><body><p>x</p></body>", "x"), ("<select><option>a<option>b</select>c", "c"), ("", ""),
]
CHUNKS = [
    ("Привет мир", [("Привет мир", 0)]),
    ("Это предложение. " * 60, [(("Это предложение. " * 52).strip(), 0), ("Это предложение. " * 8, 884)]),
    ("Слово слово слово. " * 60, [(("Слово слово слово. " * 47).strip(), 0), ("Слово слово слово. " * 13, 893)]),
    ("А" * 2000, [("А" * 900, 0), ("А" * 900, 900), ("А" * 200, 1800)]),
    ("a. " + "b" * 1500, [("a. " + "b" * 897, 0), ("b" * 603, 900)]),
    ("x" * 600 + ", " + "y" * 600, [("x" * 600 + ",", 0), ("y" * 600, 602)]),
]
LINES = [
    ("один\nдва", "один два"), ("один   два", "один два"), ("  текст  ", "текст"), ("абзац один.\n\n  абзац два", "абзац один. абзац два"),
    ("строки\nновая", "строки новая"), ("а \n \n\t б", "а б"), ("\n\nтекст\n", "текст"), ("без переносов", "без переносов"),
    ("много\n\n\nпереносов\n\nподряд", "много переносов подряд"), ("табы\tи  пробелы \n вперемешку\n", "табы\tи пробелы вперемешку"),
]
VOICE = [("Привет, World! 123", "привет, !", "привет ", True), ("раз—два\u2011три–четыре", "раз–два-три–четыре", "раздва-тричетыре", True), ("12345 !!!", "!!!", "", False)]
CARETS = [("слово^", "слово"), ("^^сло^^во^ ^", "^сло ^во"), ("а  ^  б", "а ^б"), ("^", "")]
# End of fixed values


def test_pages(spark):
    df = spark.createDataFrame([(a,) for a, _ in PAGES] + [(None,)], "html string")
    rows = df.select(X.html_to_text(F.col("html")).alias("t"), X.html_words(F.col("html")).alias("w")).collect()
    assert [r.t for r in rows] == [b for _, b in PAGES] + [None]
    for r in rows[:-1]:
        assert all(r.t[w.start : w.end] == w.word for w in r.w) and "".join(w.word for w in r.w) == "".join(r.t.split())


def test_chunks(spark):
    for text, wanted in CHUNKS:
        assert X.split_chunks(text) == wanted
    df = spark.createDataFrame([("ab cd " * 400,), (None,), ("",)], "t string")
    rows = df.select(X.chunks(F.col("t"), 900, 200).alias("c")).collect()
    assert all(len(c.text) <= 200 for c in rows[0].c) and rows[1].c == [] and [(c.text, c.start) for c in rows[2].c] == [("", 0)]
    whole = "ab cd " * 400
    assert all(whole[c.start :].lstrip().startswith(c.text.strip()) for c in rows[0].c)
    assert sum(len(c.text.split()) for c in rows[0].c) == 800


def test_lines_carets_and_voices(spark):
    one = lambda c: [r[0] for r in c.collect()]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string").coalesce(1)
    assert one(df([a for a, _ in LINES]).select(S.sanitize(F.col("t")))) == [b for _, b in LINES]
    assert one(df([a for a, _ in CARETS]).select(S.clean_carets(F.col("t")))) == [b for _, b in CARETS]
    got = df([a for a, *_ in VOICE]).select(S.voice_input(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [tuple(x[1:]) for x in VOICE]
    found = spark.range(1).select(S.symbol_table("абв", 100, 101, F.lit("вxа")).alias("x")).first().x
    assert (found.ids, found.chars) == ([100, 3, 1, 101], ["~", "в", "а", "|"])
    marks = spark.range(1).select(S.directives(F.lit("a <!-- x-code: brief --> b <!--y-code:full-->")).alias("d")).first().d
    assert [tuple(x) for x in marks] == [(2, "brief"), (27, "full")]


def test_words_in_a_stream_of_symbols(spark):
    stream = lambda text, frames=8: [(c, frames) for c in text]
    words = X.align_words("Привет usb мир", stream("^прив+ет  +мир|"), 1.0, 100.0, 10)
    assert words == [("Привет", 1.1, 1.8, 10, 16), ("usb", 2.0, 2.0, 17, 20), ("мир", 2.0, 2.4, 21, 24)]
    assert X.align_words("ёж 12", stream("еж"), 0, 0.1) == [("ёж", 0.0, 0.1, 0, 2), ("12", 0.1, 0.1, 3, 5)]
    assert X.align_words("", [], 0, 0) == [] and X.align_words("а", [], 0, 0) == [("а", 0.0, 0.0, 0, 1)]
    assert X.align_words("а + б", stream("а + б"), 0, 9)[1][1:3] == (0.4, 0.5)
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choices("абв x1+ ", k=30))
        spoken = "".join(c for c in text if c in "абв +")
        times = X.align_words(text, stream(spoken, r.randint(0, 9)), 0, 1e9)
        flat = [t for w in times for t in w[1:3]]
        assert flat == sorted(flat)
    df = spark.createDataFrame([("аб", [("а", 8), ("б", 8)]), (None, [])], "t string, s array<struct<ch:string,frames:int>>")
    rows = df.select(X.aligned_words(F.col("t"), F.col("s"), F.lit(0.0), F.lit(9.0), F.lit(0)).alias("w")).collect()
    assert [[tuple(w) for w in r.w] for r in rows] == [[("аб", 0.0, 0.2, 0, 2)], []]


def test_word_pieces(spark):
    vocabulary = ["[UNK]", "[CLS]", "[SEP]", "the", "##ing", "s", "##s", "."]
    df = spark.createDataFrame([("The sing. thes theing",), (None,), ("s" * 101,)], "t string")
    assert [r[0] for r in df.select(X.wordpiece_ids(F.lower("t"), vocabulary)).collect()] == [[1, 3, 5, 4, 7, 3, 6, 3, 4, 2], [1, 2], [1, 0, 2]]

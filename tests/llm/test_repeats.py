import random

from lectern.llm import repeats


def brute(rows, length=200):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    cover = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                cover[i][s : s + length] = b"\x01" * length
    out = []
    for (k, _), b, c in zip(rows, data, cover):
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and c[j] == c[i]:
                j += 1
            if c[i]:
                spans.append((i, j))
            i = j
        out.append((k, len(b), tuple(spans), bytes(x for x, y in zip(b, c) if not y)))
    return sorted(out, key=repr)


def run(spark, rows, **extra):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, first long, r1 long").repartition(3)
    return sorted(((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs, **extra).collect()), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(r.randint(0, 200))) for i in range(40)]
    passages = [text(r.choice([20, 38, 45, 60, 100])) for _ in range(6)]
    for i in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : r.randint(a, len(p))] if r.random() < 0.6 else p, text(r.randint(0, 30))]
        rows.append((100 + i, "".join(parts)))
    for i in range(20):
        w = rows[r.randrange(100)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((300 + i, " ".join(w)))
    line = text(9)
    rows += [(400, f"{line}\n" * 40), (401, "a" * 900), (402, "a" * 199), (403, "a" * 200), (404, "ab" * 300), (405, None), (406, ""), (None, passages[0]), (407, rows[3][1]), (3, rows[3][1]), (408, "b" * 450)]
    return rows


def test_like_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_blocks_of_a_long_text(spark, monkeypatch):
    r = random.Random(3)
    passage = "".join(r.choices("abcdefgh ", k=700))
    rows = [(1, "".join(r.choices("abcdefgh ", k=1500)) + passage + "".join(r.choices("abcdefgh ", k=900))), (2, passage[100:] + "x" * 30)]
    whole = repeats.segments(rows[0][1].encode())
    monkeypatch.setattr(repeats, "BLOCK", 512)
    parts = repeats.segments(rows[0][1].encode())
    assert len(parts[0]) >= len(whole[0]) and parts[0][0] == 0 and parts[1][-1] == whole[1][-1]
    assert run(spark, rows) == brute(rows)


#: Texts of 200 bytes that polynomials modulo 2**64 with odd bases don't tell apart.
ALIKE = (
    "6625417b3f783f232748232f4e3a6b7a696d3a2d276d28674a3d4948666f3450535a6046533968643556447e70497570315d"
    "5f414d4431544e5e6d364861397d583f587d4a6b3b737d4c28585e2f48736a6827567b7d6e6c403a754243666933473a5d2d"
    "663e4524585c4b4e334c4d496a735a3c51343266215a5b2f2761742b336674375f3b61254d245c394a764075457d296e4565"
    "732f7b7b727e6d755f2c7c75572f766f626e323d61577d506e2e41573b6365246a5b47646a5d2e646573356b5d40535c223c",
    "67243e7e42743f26214c2e2246496a6f716c363524672b6e512f3269784b336446626a245b5664452d785f515a7276712b44"
    "6f6d2a28386d6f2a3e6f7033366d6b6d3055787e2b704f7461292a50617a4e45536662776f6d6924485d655e4a2f64423b37"
    "6e315923346e6c372553544c64706238503c276530524e3a2b5b772b2f6977345e3c61254d245c394a764075457d296e4565"
    "732f7b7b727e6d755f2c7c75572f766f626e323d61577d506e2e41573b6365246a5b47646a5d2e646573356b5d40535c223c",
)


def test_texts_that_polynomials_confuse_are_no_repeats(spark):
    x, y = (bytes.fromhex(h).decode() for h in ALIKE)
    rows = [(1, x), (2, y), (3, "before " + x + " after"), (4, y + "!")]
    assert run(spark, rows[:2]) == brute(rows[:2]) and all(not spans for _, _, spans, _ in brute(rows[:2]))
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.tracked import Tracked


def test_parts_are_rewritten_once():
    t = Tracked("aXbXc 12")
    t.replace("X", "yy")
    t.replace("", "z")
    assert t.text == "ayybyyc 12" and t.parts() == [(1, 2, "yy"), (3, 4, "yy")]
    t.sub(re.compile("y"), lambda m: "z")
    assert t.text == "ayybyyc 12"
    t.sub(re.compile("b"), lambda m: "")
    t.sub(re.compile("yy"), lambda m: "q")
    t.sub(re.compile(r"c \d"), lambda m: ("WORD", "note"))
    assert t.text == "ayyyyWORD2" and t.parts()[-1] == (4, 7, "note")
    assert t.char_map() == [(0, 1), (1, 2), (1, 2), (3, 4), (3, 4), (4, 7), (4, 7), (4, 7), (4, 7), (7, 8)]


def test_a_deleted_part_inside_blocks_but_not_beside():
    t = Tracked("ab[cd")
    t.replace("[", "")
    t.sub(re.compile("bc"), lambda m: "x")
    assert t.text == "abcd"
    t.sub(re.compile("ab"), lambda m: "x")
    t.sub(re.compile("cd"), lambda m: "y")
    assert t.text == "xy" and t.parts() == [(0, 2, "x"), (2, 3, ""), (3, 5, "y")]


def test_a_match_replaced_by_itself_stays_free():
    t = Tracked("a1")
    t.sub(re.compile("a"), lambda m: "a")
    t.sub(re.compile("a1"), lambda m: "b")
    assert t.text == "b"
    assert Tracked("").parts() == [] and Tracked("").char_map() == []


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.lists(st.tuples(st.text("abc ", min_size=1, max_size=2), st.text("xyab", max_size=3)), max_size=6))
def test_free_characters_keep_their_place(source, steps):
    t = Tracked(source)
    for old, new in steps:
        t.replace(old, new)
    places, at, done = t.char_map(), 0, 0
    assert len(places) == len(t.text)
    rebuilt = []
    for start, stop, note in t.parts():
        assert done <= start <= stop
        rebuilt.append(source[done:start] + note)
        done = stop
    assert "".join(rebuilt) + source[done:] == t.text
    for c, (a, z) in zip(t.text, places):
        assert at <= a and z <= len(source)
        at = a
        if not any(s <= a < e for s, e, _ in t.parts()):
            assert source[a:z] == c


@settings(max_examples=200, deadline=None)
@given(st.text("ab -", max_size=40), st.lists(st.sampled_from(["a ", " b", "-", "bb"]), max_size=3))
def test_matches_at_once_are_matches_one_by_one(source, steps):
    one, all_ = Tracked(source), Tracked(source)
    for t in (one, all_):
        for old in steps:
            t.replace(old, "b")
    one.sub(re.compile(r"\b[ab]+\b"), lambda m: ("жж", ("word", m[0])))
    all_.sub_texts(re.compile(r"(\b[ab]+\b)"), "жж", lambda x: ("word", x))
    assert one.text == all_.text and one.parts() == all_.parts() and one.char_map() == all_.char_map()

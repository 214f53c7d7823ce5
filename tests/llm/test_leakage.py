import random

import pytest

from quirefold.llm import leakage
from quirefold.llm.leakage import SIZES, build_index, compared, find_leaks, stretch, terms_of

_LETTERS = random.Random(9)
WORDS = ["".join(_LETTERS.choice("abcdefghiklmnoprstuvwz") for _ in range(_LETTERS.randrange(3, 10))) for _ in range(500)]


def passage(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_forms_and_terms():
    assert compared("Ａ-b ｃ! É") == "abcé" and compared("…") == ""
    assert all(len(x) == 0 for x in terms_of(["abc", "", " !", "短い"]))
    row, pos, term, short = terms_of(["", "ABC def ghi-jkl, mno pqr", "abcdefghijklmnopqr", "学习约定被忽略的例外"])
    a, b = ({(int(p), int(t)) for r, p, t in zip(row, pos, term, strict=True) if r == k} for k in (1, 2))
    assert a & b and short.tolist() == [r == 3 for r in row.tolist()]


@pytest.mark.parametrize("alphabet, wide", [("abcdefgh", False), ("学习约定被忽略的例外", True), ("aが", True)])
def test_shared_runs_share_a_term(alphabet, wide):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    size = SIZES[wide and alphabet != "aが"][0] + SIZES[wide and alphabet != "aが"][1] - 1
    for _ in range(200):
        run = some(size)
        row, pos, term, _ = terms_of([some(rng.randrange(30)) + run + some(rng.randrange(30)), some(rng.randrange(30)) + run + some(rng.randrange(30))])
        assert set(term[row == 0].tolist()) & set(term[row == 1].tolist())
    row, pos, term, _ = terms_of([some(4000)])
    assert len(set(pos.tolist())) == len(pos) < 0.6 * 4000


def test_stretch():
    p = compared("the quick brown fox jumps over the lazy dog and runs away from all of it")
    assert stretch(p, p, False) == len(p)
    assert stretch(p, "xx" + p[: len(p) // 2] + "yy" * 60, False) >= len(p) // 2
    assert stretch(p, compared("the quick brown fox [12] jumps over the sleepy dog and runs away from all of it"), False) == len(p)
    assert stretch(p, compared("nothing of the kind"), False) == 0


def test_stretch_over_many_repeats():
    # 46 places of one phrase lie between a long block and the one that carries it on
    head, phrase, tail = "themountainroadtothelakehouseisclosed", "abcdefghijkl", "becausethesnowlieshighuntilearlyspring"
    p = head + tail + "".join(f"{phrase}{chr(0x3B1 + k % 20)}{chr(0x430 + k)}" for k in range(46))
    text = head + phrase + tail
    assert stretch(p, text, False) == len(head + tail)


def cases(rng):
    items = [(f"i{k}", passage(rng)) for k in range(12)]
    docs, want = [], set()
    for k, (item, p) in enumerate(items):
        words = p.split()
        whole = passage(rng, 20) + " " + p.upper() + " " + passage(rng, 20)
        part = passage(rng, 20) + " " + " ".join(words[: int(len(words) * 0.7)]) + " " + passage(rng, 20)
        changed = " ".join(words[:9] + ["[3]"] + words[9:18] + ["other"] + words[19:])
        less = passage(rng, 30) + " " + " ".join(words[:9]) + " " + passage(rng, 30)
        for j, (text, hit) in enumerate(((whole, 1), (part, 1), (changed, 1), (less, 0), (p.replace(" ", "  "), 1), (p.replace("a", "а"), 1))):
            docs.append((k * 10 + j, text, "lang"))
            if hit:
                want.add((k * 10 + j, item))
    return items, docs, want


def test_found(spark):
    rng = random.Random(4)
    items, docs, want = cases(rng)
    docs += [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (0, docs[0][1], "x"), (902, passage(rng, 20_000), "x")]
    tests = spark.createDataFrame([*items, ("null", None), (None, "x"), ("blank", " !")], "item string, passage string")
    df = spark.createDataFrame(docs, "id bigint, text string, item string")
    got = [(r["key"], r["item"]) for r in find_leaks(df, "id", "text", tests, "item", "passage").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    brute = {(d, i) for d, t, _ in docs if t and d is not None for i, p in items if stretch(compared(p), compared(t), False) >= 0.5 * len(compared(p))}
    assert set(got) == brute
    index = build_index(df, "id", "text")
    more = spark.createDataFrame([("again", items[3][1]), ("other", passage(rng))], "item string, passage string")
    assert {(r["key"], r["item"]) for r in find_leaks(df, "id", "text", more, "item", "passage", index=index).collect()} == {(d, "again") for d, i in want if i == items[3][0]}
    assert find_leaks(df.limit(0), "id", "text", tests, "item", "passage").count() == 0
    assert find_leaks(df, "id", "text", tests.limit(0), "item", "passage").count() == 0


def test_densely_changed_and_noted(spark):
    # a word changed, or a note put in, after every fourth word; short passages
    rng = random.Random(14)
    items = [(k, passage(rng, 24)) for k in range(60)] + [(100 + k, passage(rng, n)) for k, n in enumerate((1, 2, 3, 5))]
    docs, want = [], set()
    for k, p in items:
        words = p.split()
        changed = [w if i % 5 != 4 else "it" for i, w in enumerate(words)] if len(words) > 9 else words
        noted = [x for i, w in enumerate(words) for x in ([w] if i % 4 else [f"[{rng.randrange(9)}]", w])]
        for j, v in enumerate((changed, noted)):
            docs.append((k * 2 + j, " ".join([passage(rng, 40), *v, passage(rng, 40)])))
    tests = spark.createDataFrame(items, "item int, passage string")
    df = spark.createDataFrame(docs, "id int, text string")
    brute = {(d, i) for d, t in docs for i, p in items if stretch(compared(p), compared(t), False) >= 0.5 * len(compared(p))}
    assert len(brute) >= 120
    assert {(r["key"], r["item"]) for r in find_leaks(df, "id", "text", tests, "item", "passage").collect()} == brute


def test_without_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    items, docs, want = cases(rng)
    monkeypatch.setattr(leakage, "HELD", 0)
    monkeypatch.setattr(leakage, "SHORT_ROWS", 1)
    tests = spark.createDataFrame([*items, ("s1", "tiny"), ("s2", "wee one")], "item string, passage string")
    df = spark.createDataFrame([*docs, (990, "a tiny one", "x"), (991, "such wee, one", "x")], "id bigint, text string, lang string")
    assert {(r["key"], r["item"]) for r in find_leaks(df, "id", "text", tests, "item", "passage").collect()} == want | {(990, "s1"), (991, "s2")}

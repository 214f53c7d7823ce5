import random
import unicodedata

import pytest
import xxhash

from quirefold.llm.lookalike import LOOKALIKES, clusters_of, combining, compose, compositions, decompositions, form, look_classes, mapping, one_form, one_script, rebuild, same_look, unmixed


def key(text):
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def plain(text):
    table = dict(zip(decompositions()["code"].tolist(), decompositions()["target"].tolist(), strict=True))
    return unmixed(unicodedata.normalize("NFC", text.translate(table)))


def check(spark, texts, **how):
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, form int")
    got = one_form(df, "t", ["t"], **how).collect()
    assert sorted(r["t"] for r in got) == sorted(texts)
    for r in got:
        t = r["t"]
        assert r["text_key"] == key(t) and r["look_key"] == key(form(t)), ascii(t)
        assert r["form"] == plain(t) and r["blank"] == (not form(t).strip()), ascii(t)


@pytest.mark.parametrize("held", [10**6, 0])  # both ways give the same
def test_operator_equals_brute_force(spark, held):
    rng = random.Random(11)
    pool = "abcéüñßÜ.,“”'   　​﻿­︀⁠АВЕеорсухіјνοΤК" + "゙̧̣́̈" + "ｆｕｌｌ１２！，ﬁ…①가각ᄀ" + "ᅡᆨ" + "ｶﾞハﾟのタ人⼈更กำ้่ิЁёйЙ\n\t"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += list(LOOKALIKES) + ["é", "ệ", "ệ", "각", "x" * 100_000 + "е", "", " ", "​"]
    check(spark, sorted(set(texts)), held=held)


def test_every_mapped_character(spark):
    chars = [chr(c) for c in mapping() if c]
    check(spark, ["x" + c for c in chars[::23]])


def test_compose_and_clusters():
    rng = random.Random(2)
    classes = {chr(c): n for c, n in zip(combining()["code"], combining()["ccc"], strict=True)}
    pool = "aeoAıﬁéệ가각각" + "".join(chr(c) for c in (0x301, 0x323, 0x308, 0x327, 0x345, 0x5B0, 0x3099, 0x1D165, 0x338))
    for _ in range(3000):
        t = unicodedata.normalize("NFD", "".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))))
        assert compose(t, classes) == unicodedata.normalize("NFC", t), ascii(t)
    assert 900 < len(compositions()) < 1_100
    assert clusters_of(["plain", "e\u0301x", "а"]) >= {"e\u0301", "а"} and not clusters_of(["only ASCII\n"])
    assert rebuild("e\u0301 а", {"а": "a"}, {"e\u0301": "é"}) == "é a"


def test_words_of_one_script():
    assert one_script("москва") == "москва" and one_script("ре") == "ре"  # all in one script stays
    assert not set("".join(mapping().values())) & set(map(chr, mapping()))  # so the order of replacing doesn't matter
    assert one_script("pаypаl") == "paypal" and one_script("Сoбака") == "Собака" and unmixed("pаypаl и Сoбака") == "paypal и Собака"


def test_visible_differences_stay():
    same = [("Ａ１", "A1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("раураl", "paypal"), ("ﾃﾞ", "デ"), ("⼈", "人"), ("ﬁn", "fin")]
    other = [("e", "é"), ("A", "a"), ("1", "2"), ("“a”", '"a"'), ("a  b", "a b"), ("a\nb", "a b"), ("1", "l")]
    assert all(form(a) == form(b) for a, b in same)
    assert all(form(a) != form(b) for a, b in other)
    assert len(decompositions()) < 30_000 and len(combining()) < 2_000
    assert unicodedata.is_normalized("NFC", form("ệ"))


def test_pairs(spark):
    rows = [(1, "text", "a"), (2, "tеxt", "b"), (3, "text", "c"), (4, " ", "d"), (5, " ", "e"), (6, None, "f"), (None, "ｔext", "g"), (7, "Text", "h"), (2, "tеxt", "b")]
    df = spark.createDataFrame(rows, "id int, t string, key string")
    assert sorted(map(tuple, same_look(df, "id", "t").collect())) == [(1, 2), (2, 3)]
    assert same_look(df.limit(0), "id", "t").count() == 0
    classes = look_classes(df, "id", "t").collect()
    assert sorted(r["key"] for r in classes) == [1, 2, 3] and len({r["look_key"] for r in classes}) == 1


def test_pairs_of_a_large_class(spark):
    rows = [(k, ["text", "tеxt", "ｔext"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, t string")
    want = {(a, b) for a, t in rows for b, u in rows if a < b and t != u}
    got = [tuple(r) for r in same_look(df, "id", "t", class_rows=7).collect()]
    assert len(got) == len(want) and set(got) == want

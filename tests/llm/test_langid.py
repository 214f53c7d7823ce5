import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.langid import LANGUAGES, Parser, SuffixAutomaton, best, identify, plain_tag, segments, train


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abcd", max_size=20))
def test_phrases_are_longest_matches(text, query):
    n, i = 0, 0
    while i < len(query):
        k = 0
        while i + k < len(query) and query[i : i + k + 1] in text:
            k += 1
        i += max(1, k)
        n += 1
    assert SuffixAutomaton(text).phrases(query) == max(n, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é", max_size=30), min_size=1, max_size=3), st.lists(st.text(alphabet="abcdé😀", max_size=25), max_size=120))
def test_parsing_at_once(texts, queries):
    models = {str(k): SuffixAutomaton(t) for k, t in enumerate(texts)}
    for few in (0, 1, 50):
        parser = Parser(models)
        parser.FEW = few
        assert parser.phrases(queries).tolist() == [[m.phrases(q) for m in models.values()] for q in queries]


def test_best():
    assert best([4, 2, 8]) == (1, 0.5) and best([2, 2, 3], 1) == (1, 0.0) and best([2, 2, 3], 2) == (0, 0.0) and best([3]) == (0, 1.0)
    assert best([1, 10])[1] == 0.9  # not cut off


def test_tags():
    assert [plain_tag(x) for x in ("ZH-cn", "zho", "en_gb", "ger", "nl", "und", " ", "", None)] == ["zh-CN", "zh-CN", "en", "de", "nl", None, None, None, None]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/blocks.parquet").where("original_text is not null").select("language", "original_text").collect()
    return [(r[0], r[1]) for r in rows]


def test_held_out_accuracy(labelled):
    random.Random(1).shuffle(labelled)
    half = len(labelled) // 2
    sample = {}
    for tag, text in labelled[:half]:
        if plain_tag(tag) in LANGUAGES and len(text) > 40:
            sample.setdefault(plain_tag(tag), []).append(text)
    models = {k: SuffixAutomaton(t) for k, t in train({k: v[:200] for k, v in sample.items()}).items()}
    parser = Parser(models)
    assert set(models) >= {"zh-CN", "ja", "en", "de", "es", "ru", "ko"}
    right = n = 0
    for (tag, _), found in zip(labelled[half:], segments([t for _, t in labelled[half:]], parser, list(models)), strict=True):
        if plain_tag(tag) in models and len(found) == 1:
            n += 1
            right += found[0][2] == plain_tag(tag)
    assert n > 300 and right / n > 0.9  # a part of the labels is wrong


def test_mixed_segments(spark, labelled):
    rows = [("a", tag, text) for tag, text in labelled] + [("m", None, "The reviewer measured the evidence ladder in plain language. 为什么审读者当着全组的面排练了相互矛盾的观察？"), ("n", "en", None), ("e", "en", ""), ("d", "en", "12 34")]
    df = spark.createDataFrame(rows, "id string, label string, text string")
    got = {r["id"]: r for r in identify(df, "text", "label", ["id"]).where("id <> 'a'").collect()}
    assert [s["lang"] for s in got["m"]["segments"]] == ["en", "zh-CN"]
    assert all(0 <= s["confidence"] <= 1 for s in got["m"]["segments"])
    assert not got["n"]["has_letters"] and not got["e"]["has_letters"] and not got["d"]["has_letters"]


def test_without_labels(spark):
    df = spark.createDataFrame([("a", None, "Some text that is long enough to be told apart by models.")], "id string, label string, text string")
    assert identify(df, "text", "label", ["id"]).first()["segments"] == []
    assert identify(df.limit(0), "text", "label", ["id"]).count() == 0

from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.splitting import cut, split_oversized, stretch_at_cuts, unbroken


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc 。，.! \n人́", max_size=120), st.integers(1, 30), st.integers(0, 12))
def test_pieces(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert bool(pieces) == bool(text)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        assert b - c <= min(overlap, limit - 1) and (b - c == min(overlap, limit - 1) or c == b or c == a + 1)
    assert all(b - a <= limit for a, b, _ in pieces)


def test_natural_boundaries():
    text = "One short sentence. Another one here. And a third."
    assert [text[a:b] for a, b, _ in cut(text, 38, 0)] == ["One short sentence. Another one here.", " And a third."]
    assert [k for _, _, k in cut("a" * 25, 10, 2)] == ["hard", "hard", "end"]
    assert [k for _, _, k in cut("aaaa bbbb cccc dddd", 10, 0)][0] == "blank"


def test_measure():
    words = lambda ts: [1 if t.strip() else 0 for t in ts]
    text = "one two three four five six seven"
    assert [text[a:b].split() for a, b, _ in cut(text, 3, 0, words)] == [["one", "two", "three"], ["four", "five", "six"], ["seven"]]


def test_unbroken():
    assert unbroken("") == 0 and unbroken("ab cde,f") == 3 and unbroken("人、人人") == 2 and unbroken("+$x") == 3


def test_operator(spark):
    rows = [("a", "x" * 30, 10, 2, 1), ("a", "x" * 30, 10, 2, 1), ("b", "short", 10, 2, 2), ("c", None, 10, 2, 3), ("d", "y " * 30, None, 2, 4), ("e", "z " * 30, 20, None, 5)]
    df = spark.createDataFrame(rows, "id string, t string, size_limit int, o int, n_chars int")
    got = split_oversized(df, "t", "size_limit", "o", ["id"]).collect()
    assert sorted(r["id"] for r in got) == ["a", "a", "e"]
    assert {(r["n_chars"], r["cut_stretch"], r["size_limit"], r["overlap"]) for r in got} == {(30, 30, 10, 2), (60, 0, 20, 0)}
    assert split_oversized(df.limit(0), "t", "size_limit", "o", ["id"]).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc 。，.! \n人-“$", max_size=120), st.integers(1, 30), st.integers(0, 12))
def test_stretches_beyond_the_limit_are_cut(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert (stretch_at_cuts(text, pieces) > limit) == (unbroken(text) > limit)

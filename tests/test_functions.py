"""Known results of text and time functions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import timeline as G


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("中文段落", "zh-CN"), ("日本語の文章", "ja"), ("English paragraph", "en"), ("123?!", "und")])
def test_script_language(spark, text, want):
    assert one(spark, T.detect_script_language("t"), t=text) == want


def grade(spark, statement, excerpt):
    mismatch = T.numbers_missing("s", "e") | T.negation_differs("s", "e")
    return one(spark, T.grade(T.coverage(T.features("s"), T.features("e")), mismatch), s=statement, e=excerpt)


def test_support_grades(spark):
    s = "灯塔值班表显示，每晚有17.5%的灯由学徒点亮。"
    assert grade(spark, s, "按灯塔的值班表，学徒每晚点亮的灯占17.5%，其余由师傅负责。") == "strong"
    assert grade(spark, s, "港口的渡船在涨潮以后才能靠岸。") == "unsupported"
    assert grade(spark, s, s.replace("17.5%", "18%")) == "unsupported"
    assert grade(spark, "学徒会点灯。", "学徒不会点灯。") == "unsupported"
    assert grade(spark, "", "x") == "unsupported"


def test_exact_normal_form(spark):
    for text, want in (("Ａ ﬁx①！…", "afix1"), ("ｶﾞ㍻", "ガ平成"), ("e\u0301 É", "éé"), ("กำ", "ก\u0e4d\u0e32"), ("学，习", "学习"), ("№ ²", "no2")):
        assert one(spark, T.normalize("t"), t=text) == want
    assert one(spark, T.words_and_numbers("t"), t="Ｔｈｅ ab 3.5% abc9") == ["the", "3.5%", "abc", "9"]
    assert sorted(one(spark, T.features("t"), t="abc")) == ["ab", "abc", "bc"] and one(spark, T.features("t"), t="a") == []


def test_lower_grade(spark):
    assert one(spark, T.lower_grade(F.lit("strong"), F.lit("weak"))) == "weak"
    assert one(spark, T.lower_grade(F.lit("other"), F.lit("strong"))) == "unsupported"


def test_causal_relation(spark):
    r = one(spark, T.causal_relation("t"), t="夜间大雾导致渡船停航。")
    assert (r["cause"], r["effect"]) == ("夜间大雾", "渡船停航。")
    r = one(spark, T.causal_relation("t"), t="渡船停航源于夜间大雾。")
    assert (r["cause"], r["effect"]) == ("夜间大雾。", "渡船停航")
    assert one(spark, T.causal_relation("t"), t="无关") is None


def test_repetition(spark):
    old = "这份记录只涉及北岸灯塔的冬季值班，样本也只来自学徒，不能用于南岸或夏季。"
    for new in ("范围：只涉及北岸灯塔的冬季值班", "限制：不能用于南岸或夏季"):
        a, b = T.bigrams(T.normalize("a")), T.bigrams(T.normalize("b"))
        assert one(spark, (T.dice(a, b) >= 0.55) | (T.containment(a, b) >= 0.5), a=old, b=new)


@pytest.mark.parametrize(("text", "want"), [("一", 1), ("十", 10), ("二十四", 24), ("一百零三", 103), ("12", 12), ("三万", None), ("0", None), ("", None)])
def test_chinese_numbers(spark, text, want):
    assert one(spark, T.chinese_number("t"), t=text) == want


def test_chapter_prefix(spark):
    r = one(spark, T.chapter_prefix("t"), t="第三十七章北岸灯塔的冬季值班")
    assert (r["number"], r["suffix"]) == (37, "北岸灯塔的冬季值班")
    assert one(spark, T.chapter_prefix("t"), t="第九节") is None


def test_captions(spark):
    assert one(spark, T.readable_count("t"), t="先点灯，再记录潮位！") == 8
    assert one(spark, T.two_lines("t"), t="先点灯，再记录潮位和风向") == ["先点灯，", "再记录潮位和风向"]
    assert one(spark, T.two_lines("t"), t="短") == ["短"]
    assert one(spark, T.two_lines("t"), t="字" * 21) is None
    parts = one(spark, T.caption_segments("t"), t="按时点灯，记录潮位，再安排换班和巡视。")
    assert "".join(parts) == "按时点灯，记录潮位，再安排换班和巡视。" and len(parts) > 1
    assert one(spark, T.caption_segments("t"), t="") == []


def test_small_functions(spark):
    assert one(spark, T.spoken("t"), t="因此，先点灯。\n此外，再记录。  ") == "所以，先点灯。另外，再记录。"
    assert one(spark, T.numeric_tokens("t"), t="增长１２.5%和3") == ["12.5%", "3"]
    assert one(spark, T.slug("t"), t="..My Book_v2!.pdf") == "my-book-v2-pdf"
    assert one(spark, T.page_list(F.array(*[F.lit(i) for i in (3, 1, 2, 3, 9, 8)]))) == "1—9（共5页）"
    assert one(spark, T.bigrams("t"), t="a") == []
    assert one(spark, T.nfkc("t"), t="ﬁ①") == "fi1"
    assert [m["decimals"] for m in one(spark, T.metrics("t"), t="从 3.25% 到 8 万元，再到 1 与 2")] == [2, 0, 0]
    assert one(spark, T.half_up(F.lit(2.5)))== 3


def test_times(spark):
    assert one(spark, G.frames(F.lit(3000))) == 90 and one(spark, G.frames(F.lit(300))) == 9
    assert tuple(one(spark, G.trim_window(F.lit(100), F.lit(2220), F.lit(2800)))) == (40, 2310)
    assert tuple(one(spark, G.trim_window(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(2800)))) == (0, 2800)
    assert one(spark, G.font_fit(F.lit(2), 720, 220)) == 220 and one(spark, G.font_fit(F.lit(4), 720, 220)) == 180
    assert one(spark, G.ticks_to_ms(F.lit(15_000))) == 2


def test_hooks_lists_and_emphasis(spark):
    assert one(spark, T.short_hook("t"), t="灯灭了，不一定是没有油。") == ["灯灭了，", "不一定是没有油。"]
    assert one(spark, T.short_hook("t"), t="没有任何标点的一句长话") == ["没有任何标点的一", "句长话"]
    assert one(spark, T.spoken_list("t"), t="1. 按时点灯\n2. 记录潮位\n3. 轮流巡视") == "按时点灯。接着，记录潮位。最后，轮流巡视。"
    assert one(spark, T.spoken_list("t"), t="不是列表") == "不是列表"
    words = F.array(F.lit("核对"), F.lit("回忆"), F.lit("忆再"))
    got = one(spark, T.emphasis_tokens("t", words), t="先回忆再核对")
    assert [(r["text"], r["strong"]) for r in got] == [("先", False), ("回忆", True), ("再", False), ("核对", True)]


def test_boxes_beats_and_fades(spark):
    box = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(30.0).alias("w"), F.lit(40.0).alias("h"))
    assert tuple(one(spark, G.flip_scaled(box, 100.0, 200.0, 50.0, 100.0))) == (5.0, 70.0, 15.0, 20.0)
    m = G.matrix_product((0.0, 1.0, -1.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, 2.0, 1.0, 1.0))
    assert tuple(one(spark, G.transform_bounds(m, box))) == (-121.0, 21.0, 80.0, 60.0)
    assert one(spark, G.is_visual(box, 600.0, 800.0)) and not one(spark, G.is_visual(box, 35.0, 40.0))
    assert one(spark, G.beat_frames(F.lit(300), 30, F.lit(3))) == [11, 144, 276] and one(spark, G.beat_frames(F.lit(1), 30, F.lit(1))) == [0]
    assert tuple(one(spark, G.fade(F.lit(4), F.lit(100)))) == (0.5, 12.0)
    assert one(spark, T.metric_text(F.lit(3.25), F.lit(1), F.lit("%"))) in ("3.3%", "3.2%") and one(spark, T.facts("t"), t="¥1,200.5万元 与 3%") == ["¥1,200.5万元", "3%"]


@pytest.mark.parametrize(("text", "ok"), [("chapter-01.json", True), ("../x", False), ("a/b", False), ("a\\b", False), ("/etc", False), ("C:x", False), ("..", False), (" ", False), ("a..b", False), ("书.pdf", True)])
def test_safe_ids(spark, text, ok):
    assert (one(spark, T.safe_id("t"), t=text) is not None) == ok

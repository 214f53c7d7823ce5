import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.segmentation import breaks, sentences, split_sentences

CASES = {
    "en_abbreviations": ["Capt. Tadrin Jr. and Ms. Oskeld met on Tue. the 17th.", "Version 7.7.22 rose from 30.7% to 73.9%.", "See ch. 29, pp. 31–94, for it."],
    "en_quotes": ["“Who did it?” asked the editor.", "One participant answered: “The club restated it.”", "Why had she gone?"],
    "en_stop": ['"Stop! Read it again," the host whispered.', "The U.S. edition ended at 7 p.m.", "By 11 a.m. all had gone.", "J. R. Ystrad left (cf. sec. 7.1) early."],
    "en_ellipsis": ["It double-checked the list... and then narrowed it.", "Was it so?!", "(Each group measured it.)", "No. 35 on the list, e.g. the contract, was cut."],
    "de": ["Am 39. März kam sie, z. B. mit Dr. Corvane, d. h. spät.", "„Wer verwarf es?“, fragte der Redakteur.", "Vgl. Kap. 2, S. 89 ff., zu den Regeln usw.", "Er ging."],
    "fr": ["« Qui a fait ça ? » demanda un auditeur.", "Cf. chap. 16, p. 64, pour la liste etc.", "Quelle surprise qu'il ait gardé ça !", "M. Dorvik est parti vers 7.9 h."],
    "es": ["—¿Quién comparó la entrada? —preguntó la moderadora.", "La Dra. Ystrad pasó de 15,8 % a 59,2 %.", "¿Por qué?", "«A. B», dijo él."],
    "ru": ["«Кто это сделал?» — спросил рассказчик.", "См. гл. 31, стр. 66, про это и т. д.", "Почему он ушёл?"],
    "zh": ["“是谁排练了附录？”一位听众跨越所有章节问道。", "《为什么反驳了窗口？》这一章被提到。", "他比较了它；然后归档了它。", "（搭档复核了它。）", "“甲说了！”“乙也说了。”两位编辑说道。", "读者简化了它……然后压缩了顺序。", "主持人回答：“他走了。”", "难道是吗？！"],
    "ja": ["「だれが比べたのか？」と編集者はたずねた。", "『なぜ訳したのか？』という章を読んだ。", "割合は4.1%から48.5%に上がった。"],
    "ko": ["“검토자는 갔다. 독자도 갔다.” 하고 편집자가 말했다.", "왜 갔을까?", "독자는 미루었다… 그리고 강조했다."],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_known_sentences(name):
    glue = "" if name in ("zh", "ja") else " "
    text = glue.join(CASES[name])
    assert [text[a:b] for a, b in sentences(text)] == CASES[name]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. The first one\n2. The second one", 2),
        ("(1) 第一项\n(2) 第二项\n(3) 第三项", 3),
        ("• Ein Punkt\n• Noch ein Punkt", 2),
        ("为什么不\n没想到他竟然走了\n因为他累了", 3),
        ("他走了 因为他累了 没想到他竟然回来了", 3),
        ("A misleading headline\nmattered less than\nthe comparison table.", 1),
        ("One line without a mark\nAnother line without one", 2),
        ("กลุ่มเรียนรู้ใช้เวลา 21 นาทีเขียนใหม่ ผู้ตรวจทานย่อข้ออ้างแรก", 2),
        ("Seite?Warum ging er?Er kam.", 3),
        ("See draft.v9.txt now.", 1),
        ("First part.\n\nSecond part", 2),
        (None, 0), ("", 0), (" \n　", 0), ("!!! ...", 0),
    ],
)
def test_counts(text, want):
    assert len(sentences(text)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A.!?。！？“”「」（）() \n1,;…人说", max_size=60))
def test_spans_are_ordered_and_lose_no_letter(text):
    spans = sentences(text)
    end = 0
    for a, b in spans:
        assert end <= a < b and text[a:b] == text[a:b].strip()
        assert not any(c.isalnum() for c in text[end:a])
        end = b
    assert not any(c.isalnum() for c in text[end:])


def test_long_text_is_read_whole():
    text = "这是一句话。" * 50_000
    assert len(sentences(text)) == 50_000


def test_operator(spark):
    rows = [("a", "One. Two two two.", "x"), ("a", "One. Two two two.", "x"), ("b", None, "y"), ("c", "", None), (None, "他走了。", "z")]
    df = spark.createDataFrame(rows, "id string, text string, start_pos string")
    got = sorted(map(tuple, split_sentences(df, "text", ["id"]).collect()), key=str)
    assert got == sorted([("a", 0, 4), ("a", 5, 17)] * 2 + [(None, 0, 4)], key=str)
    assert split_sentences(df.limit(0), "text", ["id"]).count() == 0


def test_shortcuts_change_nothing(spark):
    blocks = spark.read.parquet("/root/testdata/sf0.01/blocks.parquet").where("original_text is not null").select("original_text")
    scenes = spark.read.parquet("/root/testdata/sf0.01/scenes.parquet").where("voice_text is not null").select("voice_text")
    texts = [r[0] for r in blocks.unionAll(scenes).distinct().collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abZé .!?。\n学ไก가나(«»“”1x)—,") for _ in range(rng.randrange(80))) for _ in range(4000)]
    for t in texts:
        assert breaks(t) == breaks(t, shortcuts=False), repr(t)

import random

from pyspark.sql import functions as F

from quirefold.llm.scanned import Editor, difference, find_damage, furniture, number_of, paragraphs, parts, running, train_editor

NOUNS = "reviewer listener archive keeper storyboard schedule appendix checklist glossary narration moderator hypothesis".split()
VERBS = "measured recorded shortened translated compared defended archived questioned".split()
NOISE = [("d", "cl"), ("m", "rn"), ("o", "0"), ("e", "c"), ("s", "5"), ("h", "b")]


def sentence(rng):
    return f"the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} {rng.choice(VERBS)} it"


def test_numbers_and_furniture():
    assert [number_of(x) for x in ("12", "xiv", "iv", "q")] == [12, 14, 4, None]
    lines = ["The Evidence Ladder · a missing footnote   7", "body text goes", "7", "- 7 -", "p. 7", "vii", "8", "第7页", "Tbe evidencc ladder: a missing footnote", ""]
    kinds = furniture(lines, 7, ["The evidence ladder: a missing footnote", None])
    assert kinds == ["header", None, "page_no", "page_no", "page_no", "page_no", None, "page_no", "header", None]
    assert furniture(["7"], None, None) == [None]


def test_header_without_title(spark):
    lone = "A Ladder of Evidence"
    rows = [(f"b{k}", "c1", k, f"{head}\nThe reviewer measured\nthe archive.") for k, head in enumerate((lone, lone.upper(), f"2   {lone}", "A Ladder of Evidcnce"))]
    rows += [(f"s{k}", "c2", k, "What a surprise that\nthe keeper came.\n" + "x " * k) for k in range(4)]  # read on: a sentence
    rows += [(f"r{k}", "c3", 5, f"{lone}\nThe keeper {k} came.") for k in range(3)]  # one page only
    rows += [("n0", None, 7, f"{lone}\nhe came."), ("n1", None, 8, f"{lone}   8\nhe came.")]
    df = spark.createDataFrame([(*r, None) for r in rows], "id string, chapter string, page int, text string, titles array<string>")
    clean = spark.createDataFrame([], "text string")
    heads = running(df, "text", "page", ["chapter"]).groupBy("chapter").agg(F.collect_list("head").alias("heads"))
    got = {(r["id"], r["line_no"]) for r in find_damage(df.join(heads, "chapter", "left"), "text", "page", "heads", ["id"], clean, "text").collect() if r["defect"] == "header"}
    assert got == {("b0", 0), ("b1", 0), ("b2", 0), ("b3", 0), ("n1", 0)}


def test_parts_across_furniture():
    got = parts("he was pa-\n7\ntient. A follow-\nup ended", 7, [], {"he", "was", "a", "ended", "up"})
    assert (0, "hyphen", "patient", "pa-tient") in got and (1, "page_no", "", "") in got and (2, "hyphen", "followup", "follow-up") in got


def test_difference_and_edits():
    assert difference("accorcling", "according") == (5, "cl", "d")
    assert difference("abc", "abc") is None and difference("abcd", "wxyz") is None
    assert Editor.put("Tbe", [(1, "h", 1)]) == "The" and Editor.put("5keptic", [(0, "s", 1)]) == "skeptic" and Editor.put("Cl", [(0, "d", 2)]) == "D"


def test_editor_learns(spark):
    rng = random.Random(3)
    known = {w: 50 for w in NOUNS + VERBS}
    noisy = {}
    for w in known:
        for a, b in NOISE:
            if a in w:
                noisy[w.replace(a, b, 1)] = w
    keys = sorted(noisy)
    rng.shuffle(keys)
    editor = train_editor(keys[: len(keys) * 2 // 3], known)
    held = keys[len(keys) * 2 // 3 :]
    right = sum(noisy[k] in dict(editor.candidates(k)) for k in held)
    assert right / len(held) > 0.9


def test_found(spark):
    rng = random.Random(8)
    clean = spark.createDataFrame([(". ".join(sentence(rng) for _ in range(8)),) for _ in range(200)] + [(None,), ("",)], "text string")
    pages, want = [], set()
    for k in range(120):
        lines = [sentence(rng) for _ in range(4)]
        at = rng.randrange(4)
        words = lines[at].split()
        i = rng.randrange(1, 3)
        ops = [(a, b) for a, b in NOISE if a in words[i]]
        if ops:
            right = words[i]
            words[i] = words[i].replace(*rng.choice(ops), 1)
            lines[at] = " ".join(words)
            want.add((k, at, "char", right))
        lines.insert(0, f"- {k + 1} -")
        want = {(a, b + 1 if a == k and c == "char" else b, c, d) for a, b, c, d in want}
        want.add((k, 0, "page_no", ""))
        pages.append((k, "\n".join(lines), k + 1, ["Title of it"], "x"))
    pages += [(500, None, 1, None, "x"), (501, "", 1, None, "x"), (502, "\n\n", None, None, "x")]
    df = spark.createDataFrame(pages, "id int, text string, page int, titles array<string>, seen string")
    got = {(r["id"], r["line_no"], r["defect"], r["repaired"]) for r in find_damage(df, "text", "page", "titles", ["id"], clean, "text").collect()}
    hits = len(got & want)
    assert hits / len(want) > 0.95 and hits / len(got) > 0.95
    assert find_damage(df.limit(0), "text", "page", "titles", ["id"], clean, "text").count() == 0
    only = find_damage(df, "text", "page", "titles", ["id"], clean.limit(0), "text")
    assert {r["defect"] for r in only.collect()} == {"page_no"}


def test_paragraphs():
    text = "The evidence\n- 7 -\nladder was accorcling to the ex¬\ntended plan.\nIt ended."
    damage = [(1, "page_no", "", ""), (2, "char", "accorcling", "according"), (2, "hyphen", "extended", "extended")]
    assert paragraphs(text, damage) == "The evidence ladder was according to the extended plan. It ended."
    assert paragraphs("第一行旳\n第二行。", [(0, "char", "旳", "的")]) == "第一行的第二行。"


def test_joins_without_hyphen(spark):
    rng = random.Random(5)
    clean = spark.createDataFrame([(". ".join(sentence(rng) for _ in range(8)),) for _ in range(100)] + [("inthe",)] * 3, "text string")
    pages, want = [], set()
    for k in range(60):
        noun = rng.choice(NOUNS)
        cut = rng.randrange(2, len(noun) - 1)
        if k % 3 == 0:  # parted without a hyphen
            pages.append((k, f"before the {noun[:cut]}\n{noun[cut:]} archived it"))
        elif k % 3 == 1:
            pages.append((k, f"before the {noun[:cut]}-\n{noun[cut:]} archived it"))
        else:  # two words
            pages.append((k, f"before the\n{noun} archived it"))
        if k % 3 < 2:
            want.add((k, 0, "hyphen", noun))
    df = spark.createDataFrame(pages, "id int, text string").selectExpr("*", "cast(null as int) as page", "cast(null as array<string>) as titles")
    got = {(r["id"], r["line_no"], r["defect"], r["repaired"]) for r in find_damage(df, "text", "page", "titles", ["id"], clean, "text").collect()}
    assert got == want
    assert Editor().joins("pa-\ntient", dict.fromkeys(("plain", "own", "left", "right"), 0)) and not Editor().joins("in\nthe", dict.fromkeys(("plain", "own", "left", "right"), 5))
    assert paragraphs("before the feed\nback, archived it", [(0, "hyphen", "feedback", "feedback")]) == "before the feedback, archived it"


def test_every_candidate():
    editor = Editor()
    editor.edits = {c: [f"1:{c}>{x}" for x in "qxzwv"] for c in "abcdefghijklmnop"}
    editor.weights = {("=" + c, f"1:{c}>q"): 1.0 for c in "abcdefgh"}
    word = "abcdefghijklmnop"
    got = dict(editor.candidates(word))
    assert len(got) == 16 * 5 + 16 * 15 // 2 * 25 and "abcdefghijklmvov" in got and "abcdefghijklmnov" in got
    assert set(dict(editor.candidates(word.upper(), among={"abcdefghijklmvov"}))) == {"ABCDEFGHIJKLMVOV"}
    assert dict(editor.candidates("a1b", among={"q1q", "q1b"})).keys() == {"q1b"}

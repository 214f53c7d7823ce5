"""Text functions as column expressions; all stay in the JVM but ``nfkc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Lexicons and patterns. All are parameters of the functions.
NEGATION = "(不(?:可|能|会|是|应|得)?|没有|未曾|未|无(?:法|关)?|并非|否认)"
CAUSAL = "(导致|造成|决定|必然|因此产生|主要原因|使得|引发|促使|推动|带来|致使|源于|归因于|因为|由于|所以|因而|从而)"
CAUSES = "导致|造成|决定|使得|因此产生|引发|促使|推动|带来|致使"
CAUSED_BY = "源于|归因于"
BECAUSE = "因为|由于"
THEREFORE = "所以|因而|从而|，|,"
HEDGES = "(作者认为|可能|一定程度|在.{1,40}(?:范围|条件|情境|时期|群体|社会|地区)|与.{1,30}(?:相关|有关)|仅|部分|截至|根据)"
UNIVERSAL = "(所有|全部|任何|一切|各国|全世界|普遍适用|不限(?:国家|时期|群体|地区))"
BOUNDARY = "(其他|非|之外|未|没有|不包括|不适用|条件不明|不同)"
FRAGMENT_START = "^(?:而|但|可能发生的|出特点是|该数值|问题是|所以|因此|从而|其(?:中|后)?)[，,\\s]"
FRAGMENT_END = "[，,、；;：:]\\z"
GRADES = ("unsupported", "weak", "partial", "strong")
GRADE_AT = (0.07, 0.16, 0.28)
CHAPTER_HEADING = "(?i)^(?:chapter\\s+(?:\\d+|[ivxlcdm]+)\\b|第[一二三四五六七八九十百千万零〇0-9]+章)"
LIST_PREFIX = "^(?:[-*•]|\\d+[.)])\\s+"
CAPTION_KINDS = {
    "table": "(?i)^(?:table\\b|表(?:格|\\s|\\d)|表格)",
    "chart": "(?i)^(?:chart\\b|graph\\b|图表|グラフ)",
    "diagram": "(?i)^(?:diagram\\b|流程图|示意图|ダイアグラム)",
}
SPOKEN = {"因此": "所以", "此外": "另外", "然而": "但"}
GENERIC_SCOPE = "^(?:贫富差距|社会分层|相关问题|相关情境|一般情况|本章内容)$"
LEAD_WORDS = "^(?:作者|书中|我们|这一|例如|此外|但是|但|然而)"
# ---------------------------------------------------------------------------

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; Spark has no function for it."""
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def half_width(c) -> Column:
    """Full-width ASCII and the ideographic space in their usual width, the
    ellipsis as three points, the Thai vowel am as its two signs."""
    out = F.translate(F.col(c) if isinstance(c, str) else c, _FULL, _HALF)
    return F.replace(F.replace(out, F.lit("…"), F.lit("...")), F.lit("\u0e33"), F.lit("\u0e4d\u0e32"))


#: Texts of these characters only are changed by NFKC as half_width does; a
#: shortcut, all others go through the Unicode tables of Python.
_PLAIN_NFKC = (
    "(?s)^(?!.*[\\u0e48-\\u0e4b][\\u0e38-\\u0e3a])[\\x00-\\x7f\\u00a1-\\u00a7\\u00a9\\u00ab-\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e"
    "\\u0400-\\u0481\\u0e01-\\u0e3a\\u0e3f-\\u0e5b\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u2026\\u2027\\u3000-\\u3035\\u3041-\\u3096\\u309d\\u309e\\u30a1-\\u30fe\\u4e00-\\u9fff\\uac00-\\ud7a3\\uff01-\\uff5e]*$"
)


def compatible(c) -> Column:
    """NFKC: in the JVM for texts of common characters, in Python for others,
    which alone are sent there."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(nfkc(F.when(~c.rlike(_PLAIN_NFKC), c)), half_width(c))


def normalize(c) -> Column:
    """NFKC in lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(compatible(c)), "(?U)[\\s\\p{P}\\p{S}]", "")


def numeric_tokens(c) -> Column:
    """The numbers of a text in order, with decimals and percent signs."""
    return F.regexp_extract_all(compatible(c), F.lit("([0-9]+(?:\\.[0-9]+)?%?)"), F.lit(1))


def words_and_numbers(c) -> Column:
    """Latin words of three letters or more, and numbers, in lower case."""
    return F.regexp_extract_all(F.lower(compatible(c)), F.lit("([a-z]{3,}|[0-9]+(?:\\.[0-9]+)?%?)"), F.lit(1))


def features(c) -> Column:
    """What a statement and its evidence are compared by: the pairs of
    characters of the normal form, and words and numbers."""
    return F.array_union(bigrams(normalize(c)), words_and_numbers(c))


def bigrams(normal) -> Column:
    """The set of neighbouring pairs of an already normalised text."""
    c = F.col(normal) if isinstance(normal, str) else normal
    letters = F.split(c, "")
    # zipped with itself one further; reaching into the array by index inside
    # a lambda would split the text anew for every element
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.char_length(c), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def coverage(a, b) -> Column:
    """Share of set ``a`` that is in set ``b``; 0 if ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def dice(a, b) -> Column:
    """Twice the common part over both sizes; 0 if either is empty."""
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def containment(a, b) -> Column:
    """The common part over the smaller size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def numbers_missing(statement, excerpt) -> Column:
    """A number of the statement doesn't stand in the excerpt."""
    return F.size(F.array_except(numeric_tokens(statement), numeric_tokens(excerpt))) > 0


def negation_differs(statement, excerpt, words: str = NEGATION) -> Column:
    return F.col(statement).rlike(words) != F.col(excerpt).rlike(words)


def grade(score, mismatch, at: tuple = GRADE_AT) -> Column:
    """unsupported, weak, partial or strong, by a coverage score."""
    out = F.when(mismatch, GRADES[0])
    for name, least in sorted(zip(GRADES[1:], at, strict=True), key=lambda x: -x[1]):
        out = out.when(score >= least, name)
    return out.otherwise(GRADES[0])


def lower_grade(a, b) -> Column:
    """The lesser of two grades; an unknown grade counts as the least."""
    rank = lambda c: F.greatest(F.array_position(F.array(*map(F.lit, GRADES)), c), F.lit(1))
    return F.element_at(F.array(*map(F.lit, GRADES)), F.least(rank(a), rank(b)).cast("int"))


def causal_relation(c) -> Column:
    """struct(cause, effect) of a causal sentence, null if none is found."""
    c = F.col(c) if isinstance(c, str) else c
    direct, reverse, because = f"^(.{{2,120}}?)(?:{CAUSES})(.{{2,120}})$", f"^(.{{2,120}}?)(?:{CAUSED_BY})(.{{2,120}})$", f"(?:{BECAUSE})(.{{2,120}}?)(?:{THEREFORE})(.{{2,120}})$"
    pair = lambda p, a, b: F.struct(F.regexp_extract(c, p, a).alias("cause"), F.regexp_extract(c, p, b).alias("effect"))
    return F.when(c.rlike(direct), pair(direct, 1, 2)).when(c.rlike(reverse), pair(reverse, 2, 1)).when(c.rlike(because), pair(because, 1, 2))


def is_fragment(c) -> Column:
    """Shorter than 8 characters, or with a dangling begin or end."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return (F.char_length(t) < 8) | t.rlike(FRAGMENT_START) | t.rlike(FRAGMENT_END)


def detect_script_language(c) -> Column:
    """ja if there is kana, else zh-CN for Han, en for Latin, und."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("[\\u3040-\\u30ff]"), "ja").when(c.rlike("\\p{IsHan}"), "zh-CN").when(c.rlike("\\p{IsLatin}"), "en").otherwise("und")


def block_kind(c) -> Column:
    """heading, list or paragraph, by the text's begin."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(CHAPTER_HEADING), "heading").when(c.rlike(LIST_PREFIX), "list").otherwise("paragraph")


def caption_kind(c) -> Column:
    """table, chart or diagram by a caption's begin, else null."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in CAPTION_KINDS.items():
        out = out.when(c.rlike(pattern), name)
    return out


def readable_count(c) -> Column:
    """Letters and digits."""
    return F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit("[\\p{L}\\p{N}]"))


def invalid_count(c) -> Column:
    """Control characters but tab and line ends, and replacement characters."""
    return F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit("[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\u007f\\ufffd]"))


def is_reliable(c) -> Column:
    """At least 4 letters or digits, and at most a tenth of invalid characters."""
    c = F.col(c) if isinstance(c, str) else c
    return (readable_count(c) >= 4) & (invalid_count(c) / F.greatest(F.char_length(c), F.lit(1)) <= 0.1)


def collapse(c) -> Column:
    """White space runs as one space, without outer ones."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(?U)\\s+", " "))


def chinese_number(c) -> Column:
    """The value of a numeral in digits or 一..九 with 十百千; null if it has
    other signs (such as 万) or isn't positive."""
    c = F.col(c) if isinstance(c, str) else c
    digits = {d: i for i, d in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
    units = {"十": 10, "百": 100, "千": 1000}

    def step(acc, ch):
        value = F.lit(None).cast("int")
        unit = F.lit(None).cast("int")
        for d, v in digits.items():
            value = F.when(ch == d, v).otherwise(value)
        for u, v in units.items():
            unit = F.when(ch == u, v).otherwise(unit)
        total = F.when(unit.isNotNull(), acc["total"] + F.when(acc["digit"] == 0, 1).otherwise(acc["digit"]) * unit).otherwise(acc["total"])
        digit = F.when(value.isNotNull(), value).otherwise(F.lit(0))
        return F.struct(total.cast("int").alias("total"), digit.cast("int").alias("digit"), (acc["ok"] & (value.isNotNull() | unit.isNotNull())).alias("ok"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(True).alias("ok"))
    folded = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda a: F.when(a["ok"] & (a["total"] + a["digit"] > 0), a["total"] + a["digit"]))
    plain = F.when(c.rlike("^[0-9]{1,9}$"), F.nullif(c.try_cast("int"), F.lit(0)))
    return F.when(c.rlike("^[0-9]+$"), plain).otherwise(folded)


def chapter_prefix(c) -> Column:
    """struct(marker, number, suffix) of a title that begins 第…章."""
    t = collapse(c)
    p = "^(第([一二三四五六七八九十百千万零〇0-9]+)章)(.*)$"
    number = chinese_number(F.regexp_extract(t, p, 2))
    return F.when(t.rlike(p) & number.isNotNull(), F.struct(F.regexp_extract(t, p, 1).alias("marker"), number.alias("number"), F.trim(F.regexp_extract(t, p, 3)).alias("suffix")))


def metrics(c, most: int = 3) -> Column:
    """The first numbers of a text: array of (value, decimals, suffix)."""
    c = F.col(c) if isinstance(c, str) else c
    p = "([0-9]+(?:\\.[0-9]+)?)\\s*(万元|万|%|元)?"
    found = F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(0)), 1, most)
    raw = lambda x: F.regexp_extract(x, p, 1)
    decimals = lambda x: F.least(F.lit(2), F.char_length(F.regexp_extract(raw(x), "\\.([0-9]+)", 1)))
    return F.transform(found, lambda x: F.struct(raw(x).cast("double").alias("value"), decimals(x).alias("decimals"), F.regexp_extract(x, p, 2).alias("suffix")))


def safe_id(c) -> Column:
    """The id if it can be a name of one file below a folder: not empty, no
    separators, no drive, no step upwards; else null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when((c != "") & ~c.rlike("[/\\\\\\x00-\\x1f]|^\\.\\.?$|\\.\\.|^[A-Za-z]:"), c)


def metric_text(value, decimals, suffix) -> Column:
    """A number as it is shown: whole, or with one or two decimals, and unit."""
    shown = F.when(decimals == 0, F.floor(value + 0.5).cast("long").cast("string")).when(decimals == 1, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return F.concat(shown, suffix)


def facts(c) -> Column:
    """Numbers with their separators, percent signs and currencies, in order."""
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit("([¥￥$€]?[0-9]+(?:[.,][0-9]+)*(?:%|万元|亿元|元|万|亿)?)"), F.lit(1))


def connectives(c) -> Column:
    """Written connectives as they are spoken."""
    out = F.col(c) if isinstance(c, str) else c
    for a, b in SPOKEN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def visual_terms(c, count: int, width: int = 14) -> Column:
    """``count`` distinct short terms between punctuation marks, without lead
    words; the last is repeated if there are fewer."""
    c = F.col(c) if isinstance(c, str) else c
    marks = "[，。！？；：、]"
    terms = F.array_distinct(F.transform(F.filter(F.transform(F.split(c, marks), lambda x: F.regexp_replace(F.regexp_replace(x, LEAD_WORDS, ""), "(?U)^\\s+|\\s+$", "")), lambda x: F.char_length(x) >= 2), lambda x: F.substring(x, 1, width)))
    spare = F.substring(F.regexp_replace(c, marks, ""), 1, width)
    filled = F.when(F.size(terms) == 0, F.array_repeat(spare, count)).otherwise(F.concat(terms, F.array_repeat(F.element_at(terms, -1), count)))
    return F.slice(filled, 1, count)


def page_list(pages) -> Column:
    """A short note of sorted page numbers: one, up to four in a list, else
    the first and last with their number."""
    p = F.array_sort(F.array_distinct(pages))
    text = F.transform(p, lambda x: x.cast("string"))
    return F.when(F.size(p) == 0, F.lit(None).cast("string")).when(F.size(p) <= 4, F.array_join(text, "、")).otherwise(F.concat(F.element_at(text, 1), F.lit("—"), F.element_at(text, -1), F.lit("（共"), F.size(p).cast("string"), F.lit("页）")))


def fold_pieces(c, breaks_at, most: int, raw_most: int | None = None, least: int = 0) -> Column:
    """Cuts a text into pieces, character by character: after a mark of the
    pattern ``breaks_at`` once ``least`` letters and digits are in the piece,
    at ``most`` of them, or at ``raw_most`` characters."""
    c = F.col(c) if isinstance(c, str) else c

    def step(acc, ch):
        cur = F.concat(acc["cur"], ch)
        n = acc["n"] + F.when(ch.rlike("[\\p{L}\\p{N}]"), 1).otherwise(0)
        full = (ch.rlike(breaks_at) & (n >= least)) | (n >= most)
        if raw_most:
            full = full | (F.char_length(cur) >= raw_most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(cur).alias("cur"),
            F.when(full, F.lit(0)).otherwise(n).cast("int").alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda a: F.struct(a["done"].alias("done"), a["cur"].alias("rest"), a["n"].alias("n")))


def caption_segments(c, least: int = 8, most: int = 16, raw_most: int = 20) -> Column:
    """Caption pieces; a short rest joins the last piece if that stays within
    ``raw_most`` characters."""

    def joined(f: Column) -> Column:
        last = F.element_at(f["done"], -1)
        joins = (F.size(f["done"]) > 0) & (f["n"] < least) & (F.char_length(F.concat(last, f["rest"])) <= raw_most)
        head = F.slice(f["done"], 1, F.greatest(F.size(f["done"]) - 1, F.lit(0)))
        return F.when(f["rest"] == "", f["done"]).when(joins, F.concat(head, F.array(F.concat(last, f["rest"])))).otherwise(F.concat(f["done"], F.array(f["rest"])))

    return let(fold_pieces(F.trim(F.col(c) if isinstance(c, str) else c), "[，。！？；：、]", most, raw_most, least), joined)


def two_lines(c, width: int = 10) -> Column:
    """A caption as one or two lines, broken behind the mark nearest the
    middle; null above twice the width."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    n = F.char_length(t)
    at = F.filter(
        F.sequence(F.lit(3), F.lit(width)),
        lambda i: (i <= n) & F.substring(t, i, 1).rlike("[，。！？；：、]") & (n - i <= width),
    )
    best = F.element_at(F.array_sort(F.transform(at, lambda i: F.struct(F.abs(i - n / 2).alias("d"), i.alias("i")))), 1)["i"]
    cut = F.when(F.size(at) > 0, best).otherwise(F.lit(width))
    return F.when(n <= width, F.array(t)).when(n <= 2 * width, F.array(F.substring(t, F.lit(1), cut), F.substring(t, cut + 1, n)))


def spoken(c) -> Column:
    """Text as it is spoken: written connectives replaced, white space gone
    between CJK characters."""
    out = F.col(c) if isinstance(c, str) else c
    for a, b in SPOKEN.items():
        out = F.regexp_replace(out, a, b)
    return F.trim(F.regexp_replace(out, "(?<=[\\u3000-\\u9fff\\uff00-\\uffef])\\s+(?=[\\u3000-\\u9fff\\uff00-\\uffef])", ""))


def short_hook(c, width: int = 10, plain: int = 8) -> Column:
    """A text in two: behind the last mark among its first ``width``
    characters, else after ``plain``."""
    c = F.col(c) if isinstance(c, str) else c
    marks = F.regexp_extract(F.substring(c, 1, width), "(?s)^(.*[，。！？；：])", 1)
    at = F.when(F.char_length(marks) > 0, F.char_length(marks)).otherwise(F.least(F.lit(plain), F.char_length(c)))
    return F.array(F.substring(c, F.lit(1), at), F.substring(c, at + 1, F.char_length(c)))


def spoken_list(c) -> Column:
    """A marked list as sentences with connectives; other texts as they are."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.filter(F.transform(F.split(c, "\n+"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")
    mark = "^(?:\\d+[.、)]|[一二三四五六七八九十]+[、.]|[-•])\\s*(.+)$"

    def sentence(x, i):
        body = F.trim(F.regexp_extract(x, mark, 1))
        has = body.rlike("^(?:先|接着|然后|最后|此外|另外|因此|所以|但|然而)")
        word = F.when(i == F.size(lines) - 1, "最后，").otherwise("接着，")
        told = F.when((i > 0) & ~has, F.concat(word, body)).otherwise(body)
        return F.when(told.rlike("[。！？；]$"), told).otherwise(F.concat(told, F.lit("。")))

    return F.when((F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(mark)), F.array_join(F.transform(lines, sentence), "")).otherwise(c)


def emphasis_tokens(c, words) -> Column:
    """A text cut at the first places of emphasised words: array of (text,
    strong). A word that begins inside an earlier one is skipped."""
    c = F.col(c) if isinstance(c, str) else c
    places = F.array_sort(F.filter(F.transform(words, lambda x: F.struct(F.instr(c, x).alias("at"), x.alias("word"))), lambda p: p["at"] > 0))
    kind = "array<struct<text:string,strong:boolean>>"

    def step(acc, p):
        plain = F.when(p["at"] > acc["next"], F.array(F.struct(F.substring(c, acc["next"], p["at"] - acc["next"]).alias("text"), F.lit(False).alias("strong")))).otherwise(F.array().cast(kind))
        own = F.array(F.struct(p["word"].alias("text"), F.lit(True).alias("strong")))
        skip = p["at"] < acc["next"]
        return F.struct(F.when(skip, acc["next"]).otherwise(p["at"] + F.char_length(p["word"])).cast("int").alias("next"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], plain, own)).alias("out"))

    rest = lambda a: F.when(a["next"] <= F.char_length(c), F.concat(a["out"], F.array(F.struct(F.substring(c, a["next"], F.char_length(c)).alias("text"), F.lit(False).alias("strong"))))).otherwise(a["out"])
    return F.aggregate(places, F.struct(F.lit(1).alias("next"), F.array().cast(kind).alias("out")), step, rest)


def slug(c) -> Column:
    """A safe id from a name: lower case, dashes for all else."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def half_up(x, digits: int = 0) -> Column:
    """Rounding with halves up."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k if digits else F.floor(x + 0.5)

"""Sentence boundaries across languages and scripts.

Boundaries are decided by tables of ordered rules. A rule is a pair of regular
expressions, one for the text that ends at a position and one for the text
that starts there, and says break or no break; at each position the first rule
that matches decides. Tables are cascaded: the rules that hold everywhere come
first, then those of the language, then those of its script, then defaults.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Marks, abbreviations and words by language.

END = "。！？!?｡．…‥؟।"
CLOSE = "”’»›」』）)】〉》]〕｣\"'"
OPEN = "“‘«‹「『（(【〈《[〔｢„‚¿¡\"'"
MARKS = r"(?:[(（]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4}|[一二三四五六七八九十]{1,3})[.)）．、]|[•·▪◦‣●○■□*–—-]|[①-⑳])"

#: Abbreviations after which a sentence goes on, whatever follows.
TITLES = {
    "en": "Mr Mrs Ms Dr Prof Capt Col Gen Lt Maj Sgt Rev Hon St Messrs Sen Rep Gov Pres Insp Supt Mt Ft",
    "de": "Dr Prof Hr Hrn Fr Frl Dipl Ing St Hl Mag Nr Kap Abb Tab Bd Vgl vgl z d u i o s a v h B ggf evtl sog inkl exkl bzw ca vs Jh Mo Di Mi Do Sa So Std Min Sek Mio Mrd Abs Art Aufl Hrsg hrsg",
    "fr": "M MM Mme Mlle Dr Pr Me Mgr St Ste chap fig p pp vol art cf Cf av env no tab sect éd ex",
    "es": "Sr Sra Srta Sres Dr Dra Dres D Dña Da Prof Profa Ing Lic Gral Cap Ud Uds cap pág págs Pág fig Fig vol núm Núm n art p pp ej Vd tab sec aprox",
    "ru": "г гг гл стр рис табл им проф акад доц см См ср Ср т ул кв напр е ч разд",
    "ko": "",
}
#: Abbreviations after which a sentence goes on if a digit or a lower-case letter follows.
SHORT = {
    "en": "no nos vol vols ch chs pp p fig figs tab tabs sec secs cf eg ie eds ed approx vs etc est dept inc ltd jr sr jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun min max art par ca al viz resp incl excl",
    "de": "usw etc ff f z d h s kap nr abb tab bd vgl s ca ggf jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "etc chap fig p pp vol art cf no n tab sect janv févr avr juil sept oct nov déc",
    "es": "etc cap pág págs fig vol núm n art p pp aprox ene feb mar abr jun jul ago sept oct nov dic",
    "ru": "др пр т е д п гл стр рис табл г гг в вв тыс млн млрд руб коп см ср",
    "ko": "",
}
#: Words that tell the languages in Latin script apart.
WORDS = {
    "en": "the of and to in a is was that for on with as by it at from an had when were not than because although this",
    "de": "der die das und ein eine einen den dem des zu mit von im auf für ist war nicht dass nach vor weil zum zur sich ohne",
    "fr": "le la les un une des et est du de à en que qui dans pour sur pas au ait l d avec ce son a sans",
    "es": "el la los las un una de del y en que por con para no se al su como lo más sobre sin antes",
}
MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner"
#: Verbs of speech in Chinese; words that follow a quotation in Japanese and Korean.
SAY_ZH = "说|說|问|問|道|答|喊|叫|嚷|讲|講|表示|低语|嘀咕|补充|補充|感叹|感嘆|宣布|坚持|解释|指出|写|寫"
AFTER_QUOTE_JA = "と|って|など|は|が|を|に|で|の|も|へ|や|という"
AFTER_QUOTE_KO = "하고|라고|이라고|라는|이라는|하며|라며|이라며|고|는|은|이|가|을|를|의|에|와|과|도|로|으로"
SAY_EN = "said|asked|replied|answered|whispered|added|shouted|cried|wrote|noted|explained|remarked|called|told"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """break or no break, for text ending with ``before`` and going on with
    ``after``. ``ends`` and ``starts`` name all characters with which a match
    of ``before`` can end and one of ``after`` can start, if they are few,
    a line feed standing for blanks before one; they only save trying the rule elsewhere."""

    breaks: bool
    before: str
    after: str
    ends: str = ""
    starts: str = ""


@lru_cache(maxsize=None)
def _compiled(rule: Rule):
    before = regex.compile(rule.before, regex.REVERSE | regex.V1) if rule.before else None
    after = regex.compile(rule.after, regex.V1) if rule.after else None
    return rule.breaks, before, after


def _any(words: str) -> str:
    return "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w)))


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_STOP = "[.!?。！？｡．…‥]"
_CL = regex.escape(CLOSE, special_only=False)
_QUOTE_OR_BRACKET = (
    "「[^「」]*」|『[^『』]*』|《[^《》]*》|〈[^〈〉]*〉|【[^【】]*】|«[^«»]*»|„[^„“”]*[“”]|“[^“”„]*”|‘[^‘’\n]*’(?!\\w)|（[^（）]*）"
    r"|\((?!\d{1,3}\)|[a-z]\))[^()]*\)|(?<![\w.,!?])" + '"(?=\\S)[^"]*"'
)

EVERYWHERE = (
    # a blank line parts paragraphs; a list mark begins an item
    Rule(True, "", r"[^\S\n]*\n[^\S\n]*\n", starts="\n"),
    Rule(True, "", r"[^\S\n]*\n\s*" + MARKS + r"\s*\p{L}", starts="\n"),
    Rule(True, "", r"[^\S\n]*\n\s*" + MARKS + r"[^\S\n]+\S", starts="\n"),
    # a new line in another script
    Rule(True, r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]", r"[^\S\n]*\n\s*[\p{Lu}&&[\p{Latin}\p{Cyrillic}]]", starts="\n"),
    # the mark belongs to its item
    Rule(False, r"(?:^|\n|[.!?。！？…][" + _CL + r"]*\s)\s*" + MARKS, r"", ends=".)）．、•·▪◦‣●○■□*–—-①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"),
    # decimals, versions, names of files: no blank and no capital after the point
    Rule(False, r"\.", r"[\p{Ll}\p{N}_/@,;:-]", ends="."),
    # runs of end marks, and closing marks, stay together
    Rule(False, _STOP, "[" + _CL.replace('\\"', "").replace("\\'", "") + ".!?。！？…]", ends=".!?。！？｡．…‥"),
    # a quotation that was announced by a colon ends its sentence
    Rule(True, r"[:：]\s*(?:“[^“”]*|\"[^\"]*|«[^«»]*|„[^„“”]*|「[^「」]*|『[^『』]*)" + _STOP + r"\s*[”\"»“」』]", r"\s*(?![\p{Ll},，、;；:：)）\p{P}--[" + regex.escape("“‘«‹「『（(【《„¿¡\"", special_only=False) + r"]]|[—–])\S|\s*$", ends="”\"»“」』"),
    # a bracket opened within a sentence doesn't end it
    Rule(False, r"[^\s.!?。！？…" + _CL + r"]\s*(?:\([^()]*|（[^（）]*)" + _STOP + r"[)）]", "", ends=")）"),
    # something that goes on: comma, semicolon, dash before a small letter
    Rule(False, "", r"\s*[,，、;；:：]", starts=_BLANKS + ",，、;；:："),
    Rule(False, "[" + _CL + "]", r"\s*[—–-]", ends=CLOSE, starts=_BLANKS + "—–-"),
    Rule(False, "", r"\s*[—–-]+\s*\p{Ll}", starts=_BLANKS + "—–-"),
)

#: Quotations in a row, then what tells that the sentence goes on after them.
_MORE_QUOTES = r"\s*(?:“[^“”]*”\s*|「[^「」]*」\s*|『[^『』]*』\s*|«[^«»]*»\s*|„[^„“”]*[“”]\s*)*"

CJK = (
    Rule(False, "[」』”]", _MORE_QUOTES + r"(?:" + AFTER_QUOTE_JA + r")(?=[\p{Han}\p{Hiragana}\p{Katakana}])", ends="」』”"),
    Rule(False, "[」』”\"]", _MORE_QUOTES + r"[^。！？!?\n：:“「]{0,60}?(?:" + SAY_ZH + r")[着道了]?(?:[。！？!?，,：:…\n]|$)", ends="」』”\""),
    Rule(False, "[》】〉]", "", ends="》】〉"),
    Rule(False, "[…‥]{1,6}", r"[^\s" + _CL + r"]"),
    Rule(True, "[。！？!?｡．][" + _CL + r"]*", ""),
    Rule(True, r"[\p{Han}\p{Hiragana}\p{Katakana}]\.", r"(?!\p{N})", ends="."),
)

KOREAN = (
    Rule(False, "[”\"’」』»]", r"\s*(?:" + AFTER_QUOTE_KO + r")(?!\p{Hangul}{3})", ends="”\"’」』»"),
    Rule(False, r"\b\p{N}{1,2}\.", r"\s*\p{N}"),
    Rule(False, "[…‥]|\\.\\.\\.", r"\s*(?:그리고|그러나|그런데|하지만|그래서|또|및)"),
    Rule(True, r"[.!?…][" + _CL + r"]*", r"\s|$"),
    Rule(True, r"\p{Hangul}[.!?][" + _CL + r"]*", r"[\p{Hangul}“‘\"「『(]"),
)

THAI = (
    Rule(True, "[.!?…][" + _CL + "]*", r"\s|$"),
    Rule(True, r"[\p{Thai}" + _CL + r"]", r"[^\S\n]+[\p{Thai}“‘\"(]"),
)


def _latin(lang: str) -> tuple[Rule, ...]:
    """Abbreviations, initials and numbers of one language in Latin or
    Cyrillic script."""
    more: tuple[Rule, ...] = ()
    if lang == "de":
        more = (
            Rule(False, r"\b\p{N}{1,3}\.", r"\s*(?:" + MONTHS_DE + r")\b", ends="."),
            Rule(False, r"\b(?:[Aa]m|[Dd]e[rmns]|[Vv]om|[Zz]u[mr]|[Ii]m|[Dd]ie|[Dd]as|[Bb]eim|[Bb]is|[Ss]eit|[Ee]in|[Ee]ine[nmrs]?|[Jj]ede[nmrs]?)\s+\p{N}{1,3}\.", r"\s+\p{Lu}", ends="."),
        )
    if lang == "en":
        more = (
            Rule(True, r"\b(?:[ap]\.m|[AP]\.M)\.[" + _CL + r"]*", r"\s+[\p{Lu}\p{N}“‘\"(]"),
            Rule(False, "[”\"]", _MORE_QUOTES + r"\s*(?:\p{Lu}[\p{L}.'’-]+\s+){1,3}(?:" + SAY_EN + r")\b", ends="”\""),
        )
    small = _any(SHORT[lang])
    always = _any(TITLES[lang])
    return (
        *more,
        Rule(False, r"(?<![\p{L}\p{N}])(?:" + always + r")\.", r"\s*(?=[\p{L}\p{N}(])", ends=".") if always else Rule(False, r"(?!)", ""),
        Rule(False, r"(?<![\p{L}\p{N}])(?i:" + small + r")\.[" + _CL + r"]*", r"\s*[\p{Ll}\p{N}]") if small else Rule(False, r"(?!)", ""),
        # initials: a single capital, not closing a word group in capitals
        Rule(False, r"(?<![\p{L}\p{N}'’])\p{Lu}\.", r"\s*(?:\p{Lu}\.|\p{Lu}[\p{Ll}'’])", ends="."),
        Rule(False, r"(?:\p{Lu}\.){1,4}\p{Lu}\.", r"\s+\p{Ll}", ends="."),
        # a small letter after an end mark goes on, whatever the mark
        Rule(False, "", r"\s*[" + regex.escape("“‘«‹„(\"", special_only=False) + r"]?\p{Ll}"),
        Rule(False, "[”\"»“][" + _CL + "]*", _MORE_QUOTES + r"\s*\p{Ll}", ends=CLOSE),
        Rule(True, r"[.!?…‥][" + _CL + r"\s]*?", r"\s*$|\s+[\p{Lu}\p{Lt}\p{Lo}\p{N}" + regex.escape(OPEN + "—–-•*", special_only=False) + r"]"),
        # the blank is missing
        Rule(True, r"[\p{Ll}\p{N}%)]{2}[.!?…][" + _CL + r"]*", r"(?:[“‘«„(¿¡]*\p{Lu}[\p{Ll}'’]|[“‘«„(¿¡]*\p{Lu}\s|\p{Lo}|[¿¡«„])"),
        Rule(True, r"[\p{Ll}\p{N}%)][!?][" + _CL + r"]*", r"[“‘«„(¿¡]*\p{Lu}"),
        Rule(True, "[!?][" + _CL + "]*", r"\s"),
    )


CASCADE: dict[str, tuple[Rule, ...]] = {
    **{lang: (*EVERYWHERE, *_latin(lang)) for lang in ("en", "de", "fr", "es", "ru")},
    "cjk": (*EVERYWHERE, *CJK),
    "ko": (*EVERYWHERE, *KOREAN),
    "th": (*EVERYWHERE, *THAI),
}

_HELD = re.compile(_QUOTE_OR_BRACKET)
_OPENERS = re.compile("[「『《〈【«„“‘（(\"]")
#: Places where a rule could say break: after end marks with what closes them,
#: before line breaks, and between blanks in scripts that part sentences by them.
_PLACES = re.compile(r"[.!?。！？｡．…‥]+[" + re.escape(CLOSE) + r"]*(?:[^\S\n]+[»”])?|(?<=\S)(?=[^\S\n]*\n)|(?<=[฀-๿" + re.escape(CLOSE) + r"])(?=[^\S\n]+[฀-๿“‘\"(])")
#: Places at which only the last rule of the cascade can match, told by the
#: characters next to them; this saves trying the others.
_PLAIN = {
    "cjk": (re.compile(r"[。！？]\Z"), re.compile(r"[ぁ-ヺ一-鿿0-9]")),
    **dict.fromkeys(("en", "de", "fr", "es", "ru"), (re.compile(r"[^\W\d_A-ZÀ-ÞА-Я]{8}[.!?]\Z"), re.compile(r" (?:[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]|[¿¡])"))),
}
_LINE_END = re.compile(r"[^\S\n]*\n")
_PARTED = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}”」』）》%])[^\S\n]+(?=[\p{Han}\p{Hiragana}\p{Katakana}“「『（《\p{N}])", regex.V1)
_SPEECH = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}", regex.V1)
_LETTERS = regex.compile(r"(\p{Han}|\p{Hiragana}|\p{Katakana}|[。！？「」『』])|(\p{Hangul})|(\p{Thai})|(\p{Cyrillic})|(\p{Latin})", regex.V1)
_WORD = regex.compile(r"\p{Latin}+", regex.V1)
_VOTES = {w: [k for k in WORDS if w in WORDS[k].split()] for ws in WORDS.values() for w in ws.split()}
_SCRIPTS = ("cjk", "ko", "th", "ru", "latin")


@lru_cache(maxsize=100_000)
def _applicable(name: str, last: str, next_: str):
    """The rules of a cascade that can match between two characters."""
    return [_compiled(r) for r in CASCADE[name] if (not r.ends or last in r.ends) and (not r.starts or next_ in r.starts)]


def latin_language(text: str) -> str:
    """en, de, fr or es, by function words; en if there are none."""
    votes = dict.fromkeys(WORDS, 0.0)
    for w in _WORD.findall(text.lower()):
        for k in _VOTES.get(w, ()):
            votes[k] += 1 / len(_VOTES[w])
    if "ß" in text:
        votes["de"] += 1
    if "¿" in text or "¡" in text:
        votes["es"] += 1
    return max(votes, key=lambda k: votes[k])


@lru_cache(maxsize=None)
def _letter_script(c: str) -> str:
    """The script of a letter or CJK mark, empty for others."""
    m = _LETTERS.match(c) if c.isalpha() or c in "。！？「」『』" else None
    return _SCRIPTS[m.lastindex - 1] if m else ""


def _script(text: str, at: int, since: int, before: str) -> str:
    """The script of the last letter or CJK mark before ``at``: looked for back
    to ``since``, where it was ``before``; if there is none, of the next one."""
    for i in range(at - 1, since - 1, -1):
        found = _letter_script(text[i])
        if found:
            return found
    return before


#: A line break before a word that is no list mark: its first letter, a small
#: one as the first group, and no mark of a list behind its letters.
_WRAPPED = re.compile(r"[^\S\n]*\n[^\S\n]*(?:([a-zß-öø-ÿа-яё])|([A-ZÀ-ÖØ-ÞА-ЯЁ一-鿿ぁ-ヺ가-힣ก-ฮ]))[^\W\d_]*+(?![.)）．、])")


def _wrapped(text: str, at: int, script: str) -> bool | None:
    """Of a line break after a letter, where no rule but the one on small
    letters can match: whether that one does (so there is no break). None: the
    rules have to be asked. This saves trying them."""
    own = text[at - 1].isalpha() and _letter_script(text[at - 1])
    m = _WRAPPED.match(text, at) if own else None
    if m is None:
        return None
    if own in ("latin", "ru"):
        return m.group(1) is not None
    return False if m.group(2) and _letter_script(m.group(2)) == own else None


def breaks(text: str, shortcuts: bool = True) -> list[int]:
    """The positions at which sentences end, in order. ``shortcuts`` skips
    rules where only one can match; the result is the same without."""
    held = [m.span() for m in _HELD.finditer(text)] if _OPENERS.search(text) else []
    language = ""
    found: list[int] = []
    loose: list[int] = []  # line breaks that no rule decided
    marks = False
    h, n_held = 0, len(held)
    since, seen = 0, ""
    for m in _PLACES.finditer(text):
        at = m.end()
        seen, since = _script(text, at, since, seen), at
        # a position inside a quotation or bracket is none, but a blank line ends it
        while h < n_held and held[h][1] <= at - 1 and held[h][1] < at:
            h += 1
        inside = False
        for a, b in held[h : h + 4]:
            if a < at < b:
                inside = True
                break
        if inside and not text.startswith("\n\n", at):
            continue
        script = seen
        if not script:
            ahead = _LETTERS.search(text, at)
            script = _SCRIPTS[ahead.lastindex - 1] if ahead else "latin"
        if script == "latin":
            language = language or latin_language(text)
            script = language
        if shortcuts and m.group() == "" and at:
            wrapped = _wrapped(text, at, script)
            if wrapped is not None:
                if not wrapped:
                    loose.append(at)
                continue
        plain = _PLAIN.get(script) if shortcuts else None
        if plain and plain[1].match(text, at) and plain[0].search(text, max(0, at - 9), at):
            found.append(at)
            marks = True
            continue
        decided = None
        first = text[at : at + 1]
        if first.isspace() and first != "\n" and _LINE_END.match(text, at):
            first = "\n"
        for does, before, after in _applicable(script, text[at - 1 : at], first):
            if (after is None or after.match(text, at)) and (before is None or before.match(text, 0, at)):
                decided = does
                break
        if decided:
            found.append(at)
        line = decided is None and _LINE_END.match(text, at)
        if decided is None and line and m.group() == "":
            loose.append(at)
        elif decided and m.group() and script != "th":
            marks = True
    if not loose and marks:
        return found
    return sorted({*found, *_unmarked(text, found, loose)})


def _ends_marked(text: str, start: int, end: int) -> bool:
    """An end mark stands last, but for blanks and closing marks."""
    while end > start and (text[end - 1].isspace() or text[end - 1] in CLOSE):
        end -= 1
    return end > start and text[end - 1] in ".!?。！？｡．…‥"


def _unmarked(text: str, found: list[int], loose: list[int]) -> list[int]:
    """Breaks of the paragraphs without end marks: there each line is a
    sentence, and in Chinese and Japanese each part between blanks. In a
    paragraph with end marks, line breaks only wrap its lines."""
    out: list[int] = []
    start = 0
    for m in [*regex.finditer(r"\n[^\S\n]*\n", text), None]:
        end = m.start() if m else len(text)
        part = text[start:end]
        inner = [p for p in found if start < p <= end and text[p - 1 : p] not in ("\n",)]
        ended = any(_ends_marked(text, start, p) for p in (end, *inner))
        if part.strip() and not ended:
            out += [p for p in loose if start < p < end]
            if _SPEECH.search(part):
                out += [start + x.start() for x in _PARTED.finditer(part)]
        start = m.end() if m else end
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """The sentences of a text as half-open spans without outer white space.

    Null, empty and blank texts have none, nor have texts without any letter
    or digit. A piece without letters and digits joins the sentence before it.
    """
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    start = 0
    for end in [*breaks(text), len(text)]:
        piece = text[start:end]
        body = piece.strip()
        if body:
            a = start + len(piece) - len(piece.lstrip())
            b = a + len(body)
            if any(c.isalnum() for c in body):
                out.append((a, b))
            elif out and "\n" not in text[out[-1][1] : a]:
                out[-1] = (out[-1][0], b)
        start = end
    return out


_SPANS = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def split_sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per sentence: the columns of ``keep``, start_pos, end_pos.

    Positions count code points from 0, the end is exclusive. Rows whose text
    is null, empty or blank give none; repeated rows give repeated sentences;
    ``keep`` decides which other columns go along, so clashing names do no
    harm. Texts of any length are read whole.

    Plan: one narrow Arrow pass, then the spans are exploded in the JVM; no
    shuffle. The texts themselves don't come back from Python.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start_pos": a, "end_pos": b} for a, b in sentences(x)] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, type=_SPANS)], names=[*batch.schema.names[:-1], "__spans"])

    given = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    out = given.mapInArrow(work, schema + "__spans array<struct<start_pos:int,end_pos:int>>")
    return out.select(*keep, F.inline("__spans"))

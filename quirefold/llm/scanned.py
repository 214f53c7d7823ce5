"""Repair of text from scanned pages.

Page numbers are told by the page's own number. Running headers are told by
the title of their chapter, by the page's number in the same line, or by their
place: the same line on other pages of the chapter, next to a page number or in
several blocks, and not read on in small letters. Broken and
misread words are found as words that clean text doesn't know; an averaged
perceptron, trained here on such words and their nearest known ones, edits
them character by character and joins what line ends part. An edit counts if
the result is known and the perceptron scores it above keeping what is there.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

#: Unknown words and known words that the editor is trained on, at most.
TRAIN_UNKNOWN = 6_000
TRAIN_KNOWN = 60_000
#: Known words held by each task to save sending them; the rest is joined.
FREQUENT = 200_000
#: Unknown words that must show an operation before it is believed.
LEAST_SHOWN = 2
#: Likeness of a line to its chapter's title that makes it a header.
LIKE_TITLE = 0.8
#: Tokens whose check a task remembers before it starts anew.
REMEMBERED = 200_000
#: Letters of the begins and ends by which pairs of edits are ruled out.
AFFIX = 6

# Hyphens at line ends, and what stands around page numbers.
HYPHENS = "-‐‑¬­"
_PAGE_NO = re.compile(r"^[\W_]*(?:第|p\.|pp\.|page|seite|s\.|pág\.|стр\.|с\.|หน้า|쪽)?\s*(\d{1,5}|[ivxlc]+)\s*(?:页|頁|ページ|쪽)?[\W_]*$", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_CJK = re.compile(r"[々-〇぀-ヿ㐀-鿿\uf900-\ufaff]")
#: Scripts written without blanks: their line ends part no words.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: One in so many line ends between two known words teaches what is no join.
PLAIN_ENDS = 16
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_APART = re.compile(r"\s{2,}")


def _letters(text: str) -> str:
    """The letters of a text in lower case."""
    return "".join(filter(str.isalpha, text.lower()))


def number_of(text: str) -> int | None:
    """The value of a page number in digits or Roman numerals."""
    if text.isdigit():
        return int(text)
    total, text = 0, text.lower()
    for a, b in zip(text, text[1:] + " ", strict=True):
        if a not in _ROMAN:
            return None
        total += -_ROMAN[a] if _ROMAN.get(b, 0) > _ROMAN[a] else _ROMAN[a]
    return total


def _is_number(text: str, page: int | None) -> bool:
    """Nothing but the page's own number, with marks around it."""
    m = _PAGE_NO.match(text) if page is not None else None
    return bool(m) and number_of(m.group(1)) == page


def _bears_number(text: str, page: int | None) -> bool:
    """The page's own number begins or ends the line, parted by two blanks or
    more from other letters."""
    if " ".join(text.split()) == text:  # no two blanks in a row
        return False
    pieces = _APART.split(text)
    return len(pieces) > 1 and any(_is_number(x, page) and _letters("".join(y)) for x, y in ((pieces[0], pieces[1:]), (pieces[-1], pieces[:-1])))


def furniture(lines: list[str], page: int | None, titles: list[str]) -> list[str | None]:
    """``header``, ``page_no`` or None for each line of a block.

    A page number is a line with nothing but a number, and marks around it,
    that is the page's own. A header is a line that bears the page's number
    apart from its text, or that reads, misread characters and page number
    aside, like one of ``titles``: those of its chapter and book, and the
    lines that :func:`running` finds by their place.
    """
    keys = [k for t in titles or [] if t and (k := _letters(t))]
    shortest = 0.75 * min(map(len, keys), default=0)  # below it no title is like
    out: list[str | None] = []
    for line in lines:
        kind = None
        text = line.strip()
        if text:
            if _is_number(text, page):
                kind = "page_no"
            elif text[-1] not in "。！？!?." and _bears_number(text, page):
                kind = "header"
            elif keys and text[-1] not in "。！？!?." and len(text) >= shortest:
                key = _letters(text)
                if key and any(_like(key, k) for k in keys):
                    kind = "header"
        out.append(kind)
    return out


def placed(lines: list[str], page: int | None) -> list[tuple[str, bool, bool, bool]]:
    """(letters, bears the page's number, stands next to it, is read on in small
    letters) of the lines that end neither a sentence nor a part of one."""
    body = [t for line in lines if (t := line.strip())]
    number = [_is_number(t, page) for t in body]
    out = []
    for i, text in enumerate(body):
        key = "" if number[i] or text[-1] in "。！？!?.,;:，；：、" else _letters(text)
        if len(key) > 2:
            near = any(number[max(0, i - 1) : i + 2])
            out.append((key, _bears_number(text, page), near, i + 1 < len(body) and body[i + 1][0].islower()))
    return out


@lru_cache(maxsize=4096)
def _title(key: str) -> tuple[frozenset, frozenset, SequenceMatcher]:
    """The letters of a title and its pairs of letters, and a matcher that is
    prepared for it."""
    return frozenset(key), frozenset(map(add, key, key[1:])), SequenceMatcher(None, "", key, autojunk=False)


def _like(a: str, b: str) -> bool:
    if a == b:
        return True
    if not 0.75 <= len(a) / len(b) <= 1.34:
        return False
    letters, pairs, s = _title(b)
    size = len(a) + len(b)
    if 2 * sum(map(letters.__contains__, a)) < LIKE_TITLE * size:  # more letters can't match
        return False
    # m matching letters lie in size - 2 m + 1 blocks at most, so m less that many pairs are shared
    if sum(map(pairs.__contains__, map(add, a, a[1:]))) < (1.5 * LIKE_TITLE - 1) * size - 1:
        return False
    s.set_seq1(a)
    return s.quick_ratio() >= LIKE_TITLE and s.ratio() >= LIKE_TITLE


def _bare(token: str) -> str:
    """A token without its outer punctuation."""
    return _OUTER.sub("", token)


def words_of(texts: list[str]) -> Counter:
    """The words of clean texts, counted: tokens between blanks without outer
    punctuation and letters of CJK scripts, in lower case."""
    out: Counter = Counter()
    for token, n in Counter(" ".join(texts).lower().split()).items():
        if not _CJK.search(token) and (bare := _bare(token)):
            out[bare] += n
    return out


_ZEROS = {c: "0" for c in range(0x110000) if chr(c).isdecimal()}


def windows_of(texts: list[str]) -> Counter:
    """Each CJK character between its neighbours, counted; digits are one, line
    ends don't count, the text's ends are blanks."""
    flat = "".join(f" {t.replace('\n', '')} " for t in texts if _CJK.search(t))
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    keys, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
    out: Counter = Counter()
    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
        c = chr(key >> 21 & 0x1FFFFF)
        if _CJK.match(c):
            out[f"{chr(key >> 42)}{c}{chr(key & 0x1FFFFF)}".translate(_ZEROS)] += n
    return out


def parts(text: str, page: int | None, titles: list[str], known: set[str]) -> list[tuple[int, str, str, str]]:
    """(line, kind, text, other) of a block: its furniture (header, page_no),
    its words broken at a line end (hyphen: joined; other: with the hyphen),
    and what is not in ``known``: words (word) and CJK characters between
    their neighbours (cjk, with two neighbours on each side). Line ends
    without a hyphen that could part a word: join (with a word not in
    ``known``, or known if joined) or, for a share of the others, plain."""
    return [x[:4] for x in _parts(text, page, titles, known)]


def _parts(text: str, page: int | None, titles: list[str], known: set[str], checked: dict[str, _Token] | None = None) -> list[tuple[int, str, str, str, str]]:
    """As :func:`parts`, with the line end (left half and its hyphen, a line
    feed, right half) that a row is, or whose half it is. ``checked``
    remembers what is known of a token."""
    checked = {} if checked is None else checked
    if len(checked) > REMEMBERED:
        checked.clear()

    def look(token: str) -> _Token:
        found = checked.get(token)
        if found is None:
            found = checked[token] = _token(token, known)
        return found

    lines = text.split("\n")
    kinds = furniture(lines, page, titles)
    out: list[tuple[int, str, str, str, str]] = [(i, k, "", "", "") for i, k in enumerate(kinds) if k]
    body = [i for i, k in enumerate(kinds) if not k and lines[i].strip()]
    skip_first: set[int] = set()
    half: dict[int, str] = {}
    for at, i in enumerate(body):
        tokens = lines[i].split()
        if i in skip_first:
            tokens = tokens[1:]
        ends = {0: half[i]} if i in half else {}
        if at + 1 < len(body) and tokens:
            last = tokens[-1]
            nxt = lines[body[at + 1]].split()
            stem = last.rstrip(HYPHENS)
            if last != stem and stem and stem[-1].isalpha() and nxt and nxt[0][0].isalpha() and not _CJK.search(last):
                own = "-" if last[len(stem)] == "-" else ""
                left, right = re.sub(r"^[\W_]+", "", stem), re.sub(r"[\W_]+$", "", nxt[0])
                if left and right:
                    out.append((i, "hyphen", left + right, left + "-" + right if own else "", f"{left}{last[len(stem)]}\n{right}"))
                    tokens = tokens[:-1]
                    skip_first.add(body[at + 1])
            elif last == stem and last[-1].isalpha() and nxt[0][0].isalpha() and len(tokens) - 1 not in ends and not (look(last).dense or look(nxt[0]).dense):
                left, right = look(last).bare, look(nxt[0]).bare
                end = f"{left}\n{right}"
                if not (look(last).known and look(nxt[0]).known) or (left + right).lower() in known:
                    out.append((i, "join", left + right, "", end))
                    ends[len(tokens) - 1] = half[body[at + 1]] = end
                elif zlib.crc32(end.encode()) % PLAIN_ENDS == 0:
                    out.append((i, "plain", left + right, "", end))
        for k, token in enumerate(tokens):
            seen = checked.get(token) or look(token)
            if seen.odd:
                out.append((i, "word", seen.bare, "", ends.get(k, "")))
    if _CJK.search(text):
        flat = f"  {''.join(lines[i] for i in body)}  "
        starts = [2]
        for i in body:
            starts.append(starts[-1] + len(lines[i]))
        for j in [j for j in range(2, len(flat) - 2) if flat[j - 1 : j + 2] not in known]:
            if _CJK.match(flat[j]) and flat[j - 1 : j + 2].translate(_ZEROS) not in known:
                out.append((body[bisect_right(starts, j) - 1], "cjk", flat[j - 2 : j + 3].translate(_ZEROS), "", ""))
    return out


class _Token(NamedTuple):
    """A token without outer punctuation; whether it is in a script without
    blanks, known to clean text, and a word that clean text doesn't know."""

    bare: str
    dense: bool
    known: bool
    odd: bool


def _token(token: str, known: set[str]) -> _Token:
    bare = _bare(token)
    wide = _CJK.search(token) is not None
    there = bare.lower() in known
    return _Token(bare, wide or _DENSE.search(token) is not None, there, not wide and not there and len(bare) > 1 and any(c.isalpha() for c in bare))


class Editor:
    """An averaged perceptron that chooses an edit for every character.

    The edits are: keep, put another text in the character's place (replace or
    insert), delete; a pair of characters read for one is a replacement
    followed by a deletion. At a line end it chooses to join or to keep apart.
    Weights lie on pairs of a feature of the place and an edit; one more
    feature of every choice is whether clean text knows the word that results.
    An edit is right if it scores above keeping what is there.
    """

    #: Pseudo-edits of the feature "clean text knows the result", of words and of CJK windows.
    KNOWN = {"word": ("known", "word"), "cjk": ("known", "cjk")}

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.edits: dict[str, list[str]] = {}

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = f"^^{word.lower()}$$"
        j = i + 2
        return ["=" + w[j], "<" + w[j - 1 : j + 1], ">" + w[j : j + 2], "|" + w[j - 1 : j + 2], "<<" + w[j - 2 : j + 1], ">>" + w[j : j + 3], "<>" + w[j - 1] + "." + w[j + 1]]

    def score(self, feats: list[str], edit: str) -> float:
        get = self.weights.get
        return sum(get((f, edit), 0.0) for f in feats)

    @staticmethod
    def end_features(end: str, counts: dict[str, int]) -> list[str]:
        """Of a line end: letters on both sides, hyphen or none, and whether
        clean text knows the joined form and the halves."""
        left, _, right = end.lower().partition("\n")
        stem = left.rstrip(HYPHENS)
        mark = "-" if stem != left else "0"
        known = [str(int(counts[k] > (k == "plain"))) for k in ("plain", "own", "left", "right")]
        return [mark + x for x in ("", "j" + known[0], "o" + known[1], "h" + known[2] + known[3], "all" + "".join(known), "<" + stem[-1:], "<<" + stem[-2:], ">" + right[:1], ">>" + right[:2], "<>" + stem[-1:] + right[:1])]

    @staticmethod
    def end_truth(kind: str, counts: dict[str, int]) -> str | None:
        """What clean text says of a line end, if it does: ``join`` if it knows
        the whole and, without a hyphen, not both halves; without a hyphen
        ``keep`` if it knows both halves or doesn't know the whole."""
        if kind == "hyphen":
            return "join" if counts["plain"] or counts["own"] else None
        both = counts["left"] and counts["right"]
        return "keep" if both or not counts["plain"] else "join" if counts["plain"] > 1 else None

    def joins(self, end: str, counts: dict[str, int]) -> bool:
        """Whether a line end is to be joined; untrained, hyphens are."""
        feats = self.end_features(end, counts)
        s = self.score(feats, "join") - self.score(feats, "keep")
        return s > 0 or (s == 0 and feats[0] == "-")

    def bonus(self, kind: str) -> float:
        """What a known result adds to the score of an edit of an unknown form."""
        return self.weights.get(self.KNOWN[kind], 0.0)

    def train(self, pairs: list[tuple[str, dict[int, str]]], rounds: int = 5, seed: int = 7, ends: list[tuple[list[str], str]] | None = None, known: Container[str] = (), windows: Container[str] = ()) -> None:
        """``pairs``: words (or CJK windows, if they are in ``windows``) with the
        edits at their places; others are kept. ``ends``: features of line ends
        and what is right there. ``known``: the words of clean text; the edits
        that pairs give for windows make known ones."""
        edits: dict[str, Counter] = defaultdict(Counter)
        for word, at in pairs:
            for i, e in at.items():
                edits[word[i].lower()][e] += 1
        self.edits = {c: [e for e, _ in k.most_common()] for c, k in edits.items()}
        # every place where there is a choice: features, truth, and the choices with what they make
        places: list[list[tuple[list[str], str, list[tuple[str, bool]]]]] = []
        for word, at in pairs:
            wide = word in windows
            mine = []
            for i, c in enumerate(word):
                if i == 1 or not wide:
                    truth = at.get(i, "keep")
                    choices = [("keep", not wide and word in known)]
                    for e in self.edits.get(c.lower(), ()):
                        width, _, change_ = e.partition(":")
                        choices.append((e, e == truth if wide else self.put(word, [(i, change_.split(">")[1], int(width))]).lower() in known))
                    if len(choices) > 1:
                        mine.append((self.features(word, i), truth, choices))
            if mine:
                places.append((self.KNOWN["cjk" if wide else "word"], mine))
        total: dict[tuple[str, str], float] = defaultdict(float)
        when: dict[tuple[str, str], int] = {}
        weights: dict[tuple[str, str], float] = defaultdict(float)
        step = 0
        rng = random.Random(seed)

        def change(feats: list[str], edit: str, by: float) -> None:
            for k in [(f, edit) for f in feats]:
                shift(k, by)

        def shift(k: tuple[str, str], by: float) -> None:
            total[k] += (step - when.get(k, 0)) * weights[k]
            when[k] = step
            weights[k] += by

        for _ in range(rounds):
            rng.shuffle(places)
            for lexical, mine in places:
                for feats, truth, choices in mine:
                    step += 1
                    more = weights[lexical]
                    best, guess, is_known, truth_known = None, "", False, False
                    for e, k in choices:
                        score = sum([weights[(f, e)] for f in feats]) + (more if k else 0.0)
                        if e == truth:
                            truth_known = k
                        if best is None or score > best:
                            best, guess, is_known = score, e, k
                    if guess != truth:
                        change(feats, truth, 1.0)
                        change(feats, guess, -1.0)
                        if truth_known != is_known:
                            shift(lexical, 1.0 if truth_known else -1.0)
            for feats, truth in ends or ():
                step += 1
                guess = max(("keep", "join"), key=lambda e: sum(weights[(f, e)] for f in feats))
                if guess != truth:
                    change(feats, truth, 1.0)
                    change(feats, guess, -1.0)
        self.weights = {k: (total[k] + (step - when[k]) * w) / max(1, step) for k, w in weights.items() if w or total[k]}

    def candidates(self, word: str, only: int | None = None, among: set[str] | None = None) -> list[tuple[str, float]]:
        """All words by one or two learned edits, with their scores; ``among``:
        only those whose lower case is there. Two edits make no form with
        digits: numbers two places apart are all right."""
        options: list[tuple[float, int, str, int]] = []
        for i, c in enumerate(word):
            if only is not None and i != only:
                continue
            feats = None
            for edit in self.edits.get(c.lower(), ()):
                feats = feats or self.features(word, i)
                width, _, new = edit.partition(":")
                n = int(width)
                if n == 2 and word[i : i + 2].lower() != new.split(">")[0]:
                    continue
                options.append((self.score(feats, edit) - self.score(feats, "keep"), i, new.split(">")[1], n))
        options.sort(reverse=True)
        low = word.lower()
        quick = among if len(low) == len(word) else None  # letter case doesn't move places
        first = second = options
        if quick is not None:  # a pair's earlier edit must make a begin, the later one an end, of a known word
            begins, ends = affixes(among)
            first = [o for o in options if (low[: o[1]] + o[2])[:AFFIX] in begins]
            second = [o for o in options if (o[2] + low[o[1] + o[3] :])[-AFFIX:] in ends]
        out: dict[str, float] = {}

        def add(edits: list[tuple[int, str, int]], score: float) -> None:
            w = self.put(word, edits)
            if among is None or w.lower() in among:
                out[w] = max(out.get(w, score), score)

        for s, i, new, n in options:
            add([(i, new, n)], s)
        for s, i, x, n in first:
            for t, j, y, m in second:
                if i + n <= j:
                    w = low[:i] + x + low[i + n : j] + y + low[j + m :]
                    if (quick is None or w in quick) and not any(map(str.isdigit, w)):
                        add([(i, x, n), (j, y, m)], s + t - 1.0)
        return list(out.items())

    @staticmethod
    def put(word: str, edits: list[tuple[int, str, int]]) -> str:
        for i, new, n in sorted(edits, reverse=True):
            old = word[i : i + n]
            rest = word[:i] + word[i + n :]
            upper = old[:1].isupper() or (not old[:1].isalpha() and len(rest) > 1 and rest.upper() == rest and rest.lower() != rest)
            if old[:1].isupper() and not (rest.upper() == rest and len(rest) > 1):
                new = new[:1].upper() + new[1:]
            elif upper:
                new = new.upper()
            word = word[:i] + new + word[i + n :]
        return word


@lru_cache(maxsize=1)
def _affixes(words: "_ById") -> tuple[set[str], set[str]]:
    begins, ends = {""}, {""}
    for w in words.held:
        for k in range(1, min(len(w), AFFIX) + 1):
            begins.add(w[:k])
            ends.add(w[-k:])
    return begins, ends


class _ById:
    """A set that is the same only as itself."""

    def __init__(self, held: set[str]):
        self.held = held

    def __hash__(self) -> int:
        return id(self.held)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _ById) and self.held is other.held


def affixes(words: set[str]) -> tuple[set[str], set[str]]:
    """All begins and all ends of up to AFFIX letters of the words."""
    return _affixes(_ById(words))


def difference(a: str, b: str) -> tuple[int, str, str] | None:
    """(place, what stands in a, what stands in b) if two words differ in one
    place by at most two characters against one or two; else None."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if not x and y and i > 0:  # an insertion, told at the character before
        i, x, y = i - 1, a[i - 1], a[i - 1] + y
    return (i, x, y) if 1 <= len(x) <= 2 and len(y) <= 2 and x != y else None


def _holes(word: str) -> Iterator[str]:
    """The word with one or two neighbouring characters taken out."""
    for i in range(len(word)):
        yield word[:i] + "*" + word[i + 1 :]
        if i + 1 < len(word):
            yield word[:i] + "*" + word[i + 2 :]


def train_editor(unknown: list[str], known: dict[str, int], wide: dict[str, list[str]] | None = None, ends: list[tuple[list[str], str]] | None = None, rare: list[str] | None = None) -> Editor:
    """The editor, from unknown words and the known ones next to them.
    ``rare``: right words that are as unknown, to be kept: those that clean
    text has once, and is taken not to know here.

    ``wide``: unknown CJK windows, and what stands in the middle of the known
    windows with the same neighbours; of a character the middle is taken that
    most of its windows allow, three at least. An operation counts that
    LEAST_SHOWN words show; known words teach what to keep. ``ends``: line
    ends, see :meth:`Editor.train`.
    """
    near: dict[str, list[str]] = defaultdict(list)
    for w in known:
        if 3 <= len(w) <= 30:
            for h in _holes(w):
                near[h].append(w)
    found: list[tuple[str, int, str, str]] = []
    for u in unknown:
        u = u.lower()
        if not 3 <= len(u) <= 30:
            continue
        best: tuple[int, str, tuple[int, str, str]] | None = None
        for w in {w for h in _holes(u) for w in near.get(h, ())}:
            d = difference(u, w)
            if d and (best is None or (known[w], w) > best[:2]):
                best = (known[w], w, d)
        if best:
            found.append((u, *best[2]))
    votes: dict[str, Counter] = defaultdict(Counter)
    for window, middles in (wide or {}).items():
        votes[window[1]].update(middles)
    for window, middles in (wide or {}).items():
        own = votes[window[1]]
        right, n = min(own.items(), key=lambda x: (-x[1], x[0]))
        if right in middles and n > 2 and 2 * n >= max(own.total() / len(own), n):
            found.append((window, 1, window[1], right))
    shown: dict[tuple[str, str], set[str]] = defaultdict(set)
    for u, _, x, y in found:
        shown[(x, y)].add(u)
    pairs = [(u, {i: f"{len(x)}:{x}>{y}"}) for u, i, x, y in found if len(shown[(x, y)]) >= LEAST_SHOWN]
    editor = Editor()
    most_known = sorted(known, key=lambda w: (-known[w], w))[: 2 * len(pairs) + 100]
    kept = [(w, {}) for w in [*most_known, *(rare or ())]]
    editor.train(pairs + kept, ends=ends, known=known, windows=wide or {})
    return editor


def _corrections(editor: Editor, kind: str, seen: str, among: set[str] | None = None) -> list[dict]:
    """Candidates for an unknown form, each with the forms that it makes: a word
    itself; a CJK character the windows of it and of its CJK neighbours.
    ``among``: all known words, if a task holds them."""
    if kind != "cjk":
        return [{"fixed": w, "score": s, "forms": [w.lower()]} for w, s in editor.candidates(seen, among=among)]
    out = []
    for w, s in editor.candidates(seen[1:4], only=1):
        if len(w) == 3:
            c = seen[:2] + w[1] + seen[3:]
            forms = [c[i - 1 : i + 2] for i in (1, 2, 3) if i == 2 or _CJK.match(c[i])]
            out.append({"fixed": w[1], "score": s, "forms": sorted(set(forms))})
    return out


_PARTS = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("seen", pa.string()), ("other", pa.string()), ("end", pa.string())]))


def known_forms(clean: DataFrame, text: str) -> DataFrame:
    """form, n, kind (word, cjk) of clean texts: words and CJK windows with
    the number of times they stand there. Counted within each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words, wide = words_of(texts), windows_of(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, *wide], pa.string()), pa.array([*words.values(), *wide.values()], pa.int64()), pa.array(["word"] * len(words) + ["cjk"] * len(wide), pa.string())],
                names=["form", "n", "kind"],
            )

    rows = clean.where(F.col(text).isNotNull()).select(text).mapInArrow(work, "form string, n bigint, kind string")
    return rows.groupBy("form", "kind").agg(F.sum("n").alias("n"))


def running(pages: DataFrame, text: str, page: str, unit: list[str]) -> DataFrame:
    """The running headers found by their place, as letters: ``unit`` and head.

    A header stands on two pages of its unit (a chapter) or more, with the
    page's number in the line, or in three blocks, or next to a page number; if
    no page's number is in it, it is not always read on in small letters. The
    begin and end of a block tell nothing more: sentences that begin alike
    stand there too. One count, grouped by unit and line.
    """
    given = pages.where(F.col(text).isNotNull() & F.col(page).isNotNull()).select(*unit, F.col(page).cast("int").alias("__page"), F.xxhash64(text).alias("__block"), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.string()), ("numbered", pa.bool_()), ("near", pa.bool_()), ("on", pa.bool_())]))
        for batch in batches:
            rows = [[dict(zip(("line", "numbered", "near", "on"), x, strict=True)) for x in placed(t.split("\n"), n)] for n, t in zip(batch.column(len(unit)).to_pylist(), batch.column(len(unit) + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*batch.schema.names[:-1], "__lines"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    lines = given.mapInArrow(work, schema + "__lines array<struct<line:string,numbered:boolean,near:boolean,on:boolean>>").select(*unit, "__page", "__block", F.inline("__lines"))
    counted = lines.groupBy(*unit, "line").agg(F.min("__page").alias("a"), F.max("__page").alias("b"), F.count_distinct("__block").alias("blocks"), F.max("numbered").alias("numbered"), F.max("near").alias("near"), F.min("on").alias("on"))
    return counted.where((F.col("a") < F.col("b")) & (F.col("numbered") | (~F.col("on") & ((F.col("blocks") > 2) | F.col("near"))))).select(*unit, F.col("line").alias("head"))


def find_damage(pages: DataFrame, text: str, page: str, titles: str, keep: list[str], clean: DataFrame, clean_text: str) -> DataFrame:
    """What is wrong in scanned texts: the columns of ``keep``, line_no, defect
    (header, page_no, hyphen, char), seen, repaired.

    ``titles`` is an array of the titles that can head the page, and of the
    lines that :func:`running` finds by their place. Lines count
    from 0 and are parted by line feeds. ``repaired`` is empty for furniture,
    the whole word for hyphen and char, one character in CJK scripts. Null and
    blank texts give no rows; a null page has no page numbers, null titles no
    headers but by number; repeated rows give the same rows again; other columns are
    dropped. Without clean text only furniture and joined words are found.

    Plan: counts of the clean forms (one aggregation), then one narrow pass
    over the pages that sends only furniture, joins and forms that are not
    among the frequent known ones. Only the distinct unknown forms are edited;
    their candidates, and the corrections, are joined by form. The frequent
    forms (FREQUENT) and the editor are all that tasks hold in full.
    """
    spark = pages.sparkSession
    known = cut_lineage(known_forms(clean, clean_text))
    often = {k: [r["form"] for r in known.where((F.col("kind") == k) & (F.col("n") >= 2)).orderBy(F.desc("n"), "form").limit(FREQUENT).select("form").collect()] for k in ("word", "cjk")}
    shared = spark.sparkContext.broadcast({*often["word"], *often["cjk"]})
    given = pages.where(F.col(text).isNotNull()).select(*keep, F.col(page).cast("int").alias("__page"), F.col(titles).alias("__titles"), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        checked: dict[str, _Token] = {}
        for batch in batches:
            numbers, heads, texts = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
            rows = [[dict(zip(("line_no", "kind", "seen", "other", "end"), p, strict=True)) for p in _parts(t, n, h, own, checked)] for n, h, t in zip(numbers, heads, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(rows, _PARTS)], names=[*batch.schema.names[:-3], "__parts"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-3])
    found = cut_lineage(given.mapInArrow(work, schema + "__parts array<struct<line_no:int,kind:string,seen:string,other:string,end:string>>").select(*keep, F.inline("__parts")))

    # the distinct forms that could be wrong, and how often they are seen
    forms = found.where(F.col("kind").isin("word", "cjk", "hyphen")).select(F.when(F.col("kind") == "cjk", "cjk").otherwise("word").alias("kind"), "seen", F.when(F.col("kind") == "cjk", F.substring("seen", 2, 3)).otherwise(F.lower("seen")).alias("form"))
    seen = cut_lineage(forms.groupBy("kind", "seen", "form").agg(F.count(F.lit(1)).alias("m")).join(known.select("form", "kind", F.col("n").alias("n_known")), ["form", "kind"], "left").where(F.coalesce("n_known", F.lit(0)) == 0))
    words = [r["seen"] for r in seen.where(F.col("kind") == "word").orderBy(F.xxhash64("seen")).limit(TRAIN_UNKNOWN).collect()]
    rare = [r["form"] for r in known.where((F.col("kind") == "word") & (F.col("n") == 1)).orderBy(F.xxhash64("form")).limit(TRAIN_UNKNOWN).select("form").collect()]
    table = {r["form"]: r["n"] for r in known.where((F.col("kind") == "word") & (F.col("n") >= 2)).orderBy(F.desc("n"), "form").limit(TRAIN_KNOWN).collect()}
    around = F.concat(F.substring("form", 1, 1), F.substring("form", 3, 1)).alias("around")
    some = seen.where((F.col("kind") == "cjk")).orderBy(F.xxhash64("form")).limit(TRAIN_UNKNOWN).select("form", around)
    middles = known.where((F.col("kind") == "cjk") & (F.col("n") >= 2)).select(around, F.substring("form", 2, 1).alias("middle"), "n").join(F.broadcast(some.select("around").distinct()), "around")
    several = middles.groupBy("around").agg(F.sort_array(F.collect_set("middle")).alias("middles"))
    wide = {r["form"]: r["middles"] for r in some.join(several, "around").collect() if r["form"][1:2] not in r["middles"]}
    # the distinct line ends, with the counts of the whole (plain, own: with its hyphen) and the halves
    counts = known.where(F.col("kind") == "word").select("form", "n")
    roles = {"plain": F.col("seen"), "own": F.col("other"), "left": F.regexp_replace(F.substring_index("end", "\n", 1), f"[{HYPHENS[1:]}-]+$", ""), "right": F.substring_index("end", "\n", -1)}
    ends = found.where(F.col("kind").isin("hyphen", "join", "plain")).select("kind", "seen", "other", "end").distinct()
    asked = ends.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lower(c).alias("form")) for k, c in roles.items()])).alias("x")).select("kind", "seen", "other", "end", "x.*")
    ends = cut_lineage(asked.join(counts, "form", "left").groupBy("kind", "seen", "other", "end").agg(*[F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(k) for k in roles]))
    shown = [(r["kind"], r["end"], {k: r[k] for k in roles}) for r in ends.orderBy(F.xxhash64("end"), "kind", "end", "seen", "other").limit(TRAIN_UNKNOWN).collect()]
    taught = [(Editor.end_features(e, c), t) for k, e, c in shown if (t := Editor.end_truth(k, c))]
    trained = train_editor(words, table, wide, taught, rare)
    editor = spark.sparkContext.broadcast(trained)
    bonus = F.when(F.col("kind") == "cjk", trained.bonus("cjk")).otherwise(trained.bonus("word"))

    # where tasks hold every word that counts, the others needn't be sent to the join
    all_held = len(often["word"]) < FREQUENT

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = editor.value
        among = shared.value if all_held else None
        kind = pa.list_(pa.struct([("fixed", pa.string()), ("score", pa.float64()), ("forms", pa.list_(pa.string()))]))
        for batch in batches:
            rows = [_corrections(own, k, x, among) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "c"])

    tried = seen.select("kind", "seen", "m").mapInArrow(edit, "kind string, seen string, m bigint, c array<struct<fixed:string,score:double,forms:array<string>>>").select("kind", "seen", "m", F.inline("c"))
    # a candidate counts if all forms that it makes are known, and it scores above keeping what is there
    ids = ["kind", "seen", "m", "fixed", "score"]
    fixes = cut_lineage(
        tried.where(F.col("score") + bonus > 0)
        .withColumn("need", F.size("forms"))
        .withColumn("form", F.explode("forms"))
        .join(known, ["form", "kind"])
        .groupBy(*ids, "need")
        .agg(F.count(F.lit(1)).alias("there"), F.min("n").alias("n"))
        .where((F.col("there") == F.col("need")) & (F.col("n") >= 2) & ((F.col("kind") == "cjk") | (F.col("n") >= F.col("m"))))
        .groupBy("kind", "seen")
        .agg(F.max_by("fixed", F.struct("score", "n", "fixed")).alias("fixed"))
    )
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = editor.value
        for batch in batches:
            yield batch.filter(pa.array([own.joins(r["end"], r) for r in batch.to_pylist()], pa.bool_()))

    # a joined word: known as such, known with its hyphen, or set right; without a hyphen it has to be known
    joined = cut_lineage(ends.where((F.col("kind") == "hyphen") | ((F.col("kind") == "join") & (F.col("plain") > 1))).mapInArrow(decide, ends.schema))
    right = joined.join(fixes.where(F.col("kind") == "word").select("seen", "fixed"), "seen", "left").select(
        "kind", "seen", "other", "end", F.when((F.col("own") > F.col("plain")) & (F.col("other") != ""), F.col("other")).when(F.col("plain") > 0, F.col("seen")).otherwise(F.coalesce("fixed", "seen")).alias("repaired")
    )
    out = ["line_no", F.col("kind"), "seen"]
    lines = found.where(F.col("kind").isin("header", "page_no")).select(*keep, *out, F.lit("").alias("repaired"))
    hyphens = found.where(F.col("kind").isin("hyphen", "join")).join(right, ["kind", "seen", "other", "end"]).select(*keep, "line_no", F.lit("hyphen").alias("kind"), "seen", "repaired")
    halves = joined.where(F.col("kind") == "join").select("end").distinct()
    chars = found.where(F.col("kind").isin("word", "cjk")).join(halves, "end", "left_anti").join(fixes, ["kind", "seen"]).select(*keep, "line_no", F.lit("char").alias("kind"), F.when(F.col("kind") == "cjk", F.substring("seen", 3, 1)).otherwise(F.col("seen")).alias("seen"), F.col("fixed").alias("repaired"))
    return lines.unionByName(hyphens).unionByName(chars).withColumnRenamed("kind", "defect")


def paragraphs(text: str, damage: list[tuple[int, str, str, str]]) -> str:
    """A block's text as continuous paragraphs: furniture left out, words
    joined and set right, wrapped lines put together. ``damage``: (line,
    defect, seen, repaired) of the block."""
    lines = text.split("\n")
    gone = {d[0] for d in damage if d[1] in ("header", "page_no")}
    fixes: dict[int, list[tuple[str, str]]] = defaultdict(list)
    broken: dict[int, str] = {}
    for i, kind, seen, repaired in damage:
        if kind == "char":
            fixes[i].append((seen, repaired))
        elif kind == "hyphen":
            broken[i] = repaired
    out: list[str] = []
    carry = False
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if not line.strip():
            out.append("\n\n")
            continue
        for seen, repaired in fixes.get(i, ()):
            line = line.replace(seen, repaired) if _CJK.search(seen) else re.sub(rf"(?<!\w){re.escape(seen)}(?!\w)", lambda _, r=repaired: r, line)
        line = line.strip()
        if carry:  # its first word went to the line before, but for marks behind it
            first, _, rest = line.partition(" ")
            tail = re.search(r"[\W_]*$", first).group()
            line = f"{tail} {rest}".strip() if tail else f" {rest}" if rest else ""
            carry = False
            out.append(line if line.startswith(" ") or tail else " " + line)
        elif out and out[-1] != "\n\n":
            dense = _CJK.search(out[-1][-1:] or " ") or _CJK.search(line[:1]) or line[:1] in "，。、；：！？”」』）》"
            out.append(line if dense else " " + line)
        else:
            out.append(line)
        if i in broken:
            head, _, last = out[-1].rpartition(" ")
            lead = re.match(r"^[\W_]*", last).group()
            out[-1] = (head + " " if head or out[-1].startswith(" ") else "") + lead + broken[i]
            carry = True
    return re.sub(r"\s*\n\n\s*", "\n\n", "".join(out)).strip()

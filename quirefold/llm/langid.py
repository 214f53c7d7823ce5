"""Languages of texts and of their segments, by cross-parsing.

A sentence is parsed with the labelled text of each language: it is cut
greedily into the longest phrases that occur there. The language whose text
needs the fewest phrases per character wins. Longest matches are found by a
suffix automaton of the labelled text.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.segmentation import sentences

# Tags of the languages told apart, and tags that name none.
LANGUAGES = ("zh-CN", "ja", "en", "de", "fr", "es", "ru", "ko", "th")
TAGS = {
    "zh": "zh-CN", "zho": "zh-CN", "chi": "zh-CN", "cmn": "zh-CN", "ja": "ja", "jpn": "ja", "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "ru": "ru", "rus": "ru", "ko": "ko", "kor": "ko", "th": "th", "tha": "th",
}
NO_LANGUAGE = ("", "und", "unknown", "unk", "mis", "mul", "zxx", "none", "null", "n/a", "-", "?")

#: Rows and characters of labelled text used per language.
SAMPLE_ROWS = 240
SAMPLE_CHARS = 20_000
#: Letters under which a text tells too little: of alphabets, of CJK scripts.
SHORT = (12, 4)
#: Confidence under which a sentence tells no language: codes, noise, ties.
UNSURE = 0.15

_SPACE = re.compile(r"[\W\d_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힣\uf900-\ufaff]")


def plain_tag(tag: str | None) -> str | None:
    """A language tag as one of LANGUAGES; None if it names no language;
    another language's tag in lower case."""
    if tag is None:
        return None
    tag = tag.strip().lower().replace("_", "-")
    if tag in NO_LANGUAGE:
        return None
    return TAGS.get(tag.split("-")[0], tag)


def plain_text(text: str) -> str:
    """Letters in lower case; all else becomes one blank."""
    return _SPACE.sub(" ", text.lower()).strip()


def by_script(text: str):
    """The language that the script of a text alone tells, else und."""
    out = F.lit("und")
    for pattern, lang in (("\\p{IsCyrillic}", "ru"), ("\\p{IsThai}", "th"), ("\\p{IsHangul}", "ko"), ("\\p{IsHan}", "zh-CN"), ("[ぁ-ヺ]", "ja")):
        out = F.when(F.col(text).rlike(pattern), lang).otherwise(out)
    return out


def too_short(plain: str) -> bool:
    dense = len(_DENSE.findall(plain))
    return dense < SHORT[1] and len(plain) - plain.count(" ") - dense < SHORT[0]


class SuffixAutomaton:
    """All substrings of a text, as transitions of states."""

    def __init__(self, text: str):
        steps: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(steps)
                    steps.append(steps[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.steps = steps

    def phrases(self, text: str) -> int:
        """Longest-match phrases that ``text`` is cut into; a character that
        doesn't occur is one."""
        n, now = self.go_on(text, 1, 0)
        return n - (now == 0 and n > 1)

    def go_on(self, text: str, n: int, now: int) -> tuple[int, int]:
        """The count and the state after parsing on from a count and a state."""
        steps = self.steps
        root = steps[0]
        for c in text:
            to = steps[now].get(c)
            if to is None:
                if now:
                    n += 1
                to = root.get(c)
                if to is None:
                    now = 0
                    n += 1
                    continue
            now = to
        return n, now


class Parser:
    """The suffix automata of several languages, as arrays: many texts are
    parsed at once, all by one step at a time."""

    #: Texts below which the rest is parsed one by one.
    FEW = 48
    _SALT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, models: dict[str, SuffixAutomaton]):
        self.models = list(models.values())
        letters = sorted({c for m in self.models for step in m.steps for c in step})
        self.code = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.tables = [self._table(m) for m in self.models]

    def _table(self, model: SuffixAutomaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """The transitions as a hash table with open addressing: keys (state
        and letter), where they lead; and those of the root by letter."""
        keys = np.array([at * self.width + int(self.code[ord(c)]) for at, step in enumerate(model.steps) for c in step], dtype=np.int64)
        to = np.array([x for step in model.steps for x in step.values()], dtype=np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        shift = np.uint64(64 - bits)
        held, lead = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        slot, rest = self._slot(keys, shift), np.arange(len(keys))
        while len(rest):
            free = rest[held[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            held[slot[put]], lead[slot[put]] = keys[put], to[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            rest = rest[left[rest]]
            slot[rest] = (slot[rest] + 1) & (len(held) - 1)
        root = np.zeros(self.width, dtype=np.int32)  # 0, the root itself: the letter doesn't occur
        for c, x in model.steps[0].items():
            root[self.code[ord(c)]] = x
        return held, lead, root, shift

    def _slot(self, keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._SALT) >> shift).astype(np.int64)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Longest-match phrases of each text (rows) with each model (columns),
        as :meth:`SuffixAutomaton.phrases` counts them."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        begin = (np.cumsum(sizes) - sizes)[order]
        going = len(texts) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0)) + 1), side="right")  # texts longer than so many letters
        out = np.empty((len(texts), len(self.models)), dtype=np.int64)
        for k, model in enumerate(self.models):
            held, lead, root, shift = self.tables[k]
            mask = len(held) - 1
            n, now = np.ones(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            t = 0
            while t < len(going) - 1 and going[t] >= self.FEW:
                m = going[t]
                c = codes[begin[:m] + t]
                state = now[:m]
                key = state * self.width + c
                slot = self._slot(key, shift)
                there = held[slot]
                hit = there == key
                open_ = np.flatnonzero(~hit & (there >= 0))
                while len(open_):  # collisions
                    slot[open_] = (slot[open_] + 1) & mask
                    there = held[slot[open_]]
                    hit[open_] = same = there == key[open_]
                    open_ = open_[~same & (there >= 0)]
                to = np.where(hit, lead[slot], root[c])
                # the phrase ends; a letter that doesn't occur is one of its own
                n[:m] += (~hit & (state != 0)) + (to == 0).astype(np.int64)
                now[:m] = to
                t += 1
            for i in range(going[t] if t < len(going) else 0):
                n[i], now[i] = model.go_on(texts[order[i]][t:], int(n[i]), int(now[i]))
            out[order, k] = n - ((now == 0) & (n > 1))
        return out


def best(counts: list[int], first: int | None = None) -> tuple[int, float]:
    """The place of the least number of phrases, and a confidence: 1 - it over
    that of the runner-up. Ties go to ``first``, else to the first."""
    least = min(counts)
    who = first if first is not None and counts[first] == least else counts.index(least)
    rest = [n for k, n in enumerate(counts) if k != who]
    return who, 1 - least / min(rest) if rest else 1.0


def train(sample: dict[str, list[str]], chars: int = SAMPLE_CHARS, folds: int = 3, rounds: int = 3) -> dict[str, str]:
    """The text of each language's automaton, from labelled texts some of whose
    labels are wrong and some of which are mixed. A sentence stays only if the
    other folds of its language's sentences, which don't hold its own text,
    need clearly fewer phrases for it than any other language; this is done in
    rounds, each with what the one before left. Sentences are taken whole until
    ``chars`` are reached."""
    rows = {k: [(i, p) for i, t in enumerate(texts) for a, b in sentences(t) if not too_short(p := plain_text(t[a:b]))] for k, texts in sample.items()}
    for _ in range(rounds):
        kept: dict[str, list[tuple[int, str]]] = {k: [] for k in rows}
        for fold in range(folds):
            models = {k: SuffixAutomaton(_joined([p for i, p in v if i % folds != fold], chars // 2)) for k, v in rows.items() if v}
            asked = [(k, i, p) for k, v in rows.items() for i, p in v if i % folds == fold]
            for (k, i, p), counts in zip(asked, Parser(models).phrases([p for _, _, p in asked]).tolist(), strict=True):
                n = dict(zip(models, counts, strict=True))
                if all(n[o] * 0.9 > n[k] for o in models if o != k):
                    kept[k].append((i, p))
        rows = {k: v or rows[k] for k, v in kept.items()}
    return {k: _joined([p for _, p in rows[k]], chars) for k in LANGUAGES if rows.get(k)}


def _joined(rows: list[str], chars: int) -> str:
    out, n = [], 0
    for p in rows:
        if n >= chars:
            break
        out.append(p)
        n += len(p) + 1
    return "\n".join(out)


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser({k: SuffixAutomaton(t) for k, t in texts})


def labelled_sample(df: DataFrame, text: str, label: str, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Up to ``rows`` distinct texts per labelled language, those with the least
    hash; the sample doesn't depend on the order of the rows."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        for batch in batches:
            for t, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang = plain_tag(tag)
                if lang in LANGUAGES:
                    heap = heaps.setdefault(lang, [])
                    entry = (-(xxhash.xxh64_intdigest(t) >> 1), t)
                    if len(heap) < rows:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        flat = [(k, -h, t) for k, heap in heaps.items() for h, t in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.string())], names=["lang", "h", "t"])

    given = df.where(F.col(text).isNotNull() & (F.char_length(F.trim(text)) >= 40)).select(text, F.col(label).cast("string").alias("label"))
    picked = given.mapInArrow(pick, "lang string, h bigint, t string").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    out: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in picked.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect():  # at most `rows` per language
        out[r["lang"]].append(r["t"])
    return out


def segments(texts: list[str], parser: Parser, langs: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Of each text (start, end, language, confidence) of the maximal runs of
    whole sentences in one language. Sentences that are too short, or that no
    language fits clearly better than the others, go with the one before, else
    with the one after; no segment is left if all are such. ``langs`` names
    the parser's models."""
    cut = [[(a, b, plain_text(t[a:b])) for a, b in sentences(t)] for t in texts]
    asked = sorted({p for c in cut for _, _, p in c if p and not too_short(p)})  # equal sentences are parsed once
    counts = dict(zip(asked, parser.phrases(asked).tolist(), strict=True))
    return [_runs(c, counts, langs) for c in cut]


def _runs(cut: list[tuple[int, int, str]], counts: dict[str, list[int]], langs: list[str]) -> list[tuple[int, int, str, float]]:
    parts: list[list] = []
    last = None
    for a, b, plain in cut:
        if not plain:
            if parts:
                parts[-1][1] = b
        elif plain not in counts:
            parts.append([a, b, None, 0.0, len(plain)])
        else:
            last, sure = best(counts[plain], last)
            parts.append([a, b, langs[last] if sure >= UNSURE or len(langs) == 1 else None, sure, len(plain)])
    known = [p[2] for p in parts if p[2]]
    if not known:
        return []
    before = next(iter(known))
    out: list[list] = []
    for p in parts:
        p[2] = before = p[2] or before
        if out and out[-1][2] == p[2]:
            o = out[-1]
            o[3] = (o[3] * o[4] + p[3] * p[4]) / max(1, o[4] + p[4])
            o[1], o[4] = p[1], o[4] + p[4]
        else:
            out.append(list(p))
    return [(a, b, lang, sure) for a, b, lang, sure, _ in out]


_SEGMENTS = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def identify(df: DataFrame, text: str, label: str, keep: list[str], sample: DataFrame | None = None) -> DataFrame:
    """The languages of every text: the columns of ``keep``, label_lang (see
    :func:`plain_tag`), has_letters, and segments, an array of (start_pos,
    end_pos, lang, confidence), empty if the text is too short or has no
    letters. Null texts give a row without letters. Repeated rows stay; other
    columns are dropped.

    The models come from a bounded sample of the labelled rows (of ``sample``,
    else of ``df``), see SAMPLE_ROWS and SAMPLE_CHARS; without any labelled
    text every segment list is empty. Plan: one job for the sample; then one
    narrow Arrow pass over all texts.
    """
    spark = df.sparkSession
    texts = tuple(sorted(train(labelled_sample(df if sample is None else sample, text, label)).items(), key=lambda x: LANGUAGES.index(x[0])))
    shared = spark.sparkContext.broadcast(texts)
    given = df.select(*keep, F.col(label).cast("string").alias("__label"), F.col(text).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, langs = _parser(shared.value), [k for k, _ in shared.value]
        for batch in batches:
            labels, values = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            letters = [bool(t) and any(c.isalpha() for c in t) for t in values]
            found = iter(segments([t for t, ok in zip(values, letters, strict=True) if ok], parser, langs) if langs else ())
            rows = [[{"start_pos": a, "end_pos": b, "lang": k, "confidence": s} for a, b, k, s in next(found)] if ok and langs else [] for ok in letters]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([plain_tag(x) for x in labels], pa.string()), pa.array(letters), pa.array(rows, _SEGMENTS)],
                names=[*batch.schema.names[:-2], "label_lang", "has_letters", "segments"],
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-2])
    return given.mapInArrow(work, schema + "label_lang string, has_letters boolean, segments array<struct<start_pos:int,end_pos:int,lang:string,confidence:double>>")

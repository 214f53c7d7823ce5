"""Test passages inside a training corpus, by a positional inverted index.

Terms are runs of letters and digits of the compared form of a text (see
:func:`compared`), whatever stands between them; so spacing, punctuation,
letter case and the form of characters play no part. Of the terms of a stretch
those with the least hash are stored (see :func:`terms_of`). The index keeps
the postings of all training texts - term, text, position - in a table that
lies with the texts it was made of; any test set can ask it. The lists of the
rarest terms of each part of a passage are intersected after subtracting the
terms' offsets; what is left is checked letter by letter for an unbroken
stretch.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.llm.lookalike import mapping, replace_all
from quirefold.session import cut_lineage

#: Letters of a term, of a window that stores its least term, of the shortest
#: block that counts as matching, and of the longest gap between two blocks
#: (one changed word or term, or an inserted mark); for alphabets, and for
#: scripts whose characters are syllables or words.
SIZES = {False: (12, 8, 12, 40), True: (6, 4, 5, 14)}
#: Letters of a passage's part that asks with its rarest term.
PART = {False: 16, True: 8}
#: Share of a passage's letters and digits that has to be in one stretch.
LEAST = 0.5
#: Share of a stretch that changed words and marks may take.
MOST_CHANGED = 0.38
#: Share of the parts of a least stretch of which a text has to hold a term,
#: one after another, to be checked; and how far apart they may stand: a gap
#: and the terms, windows and parts on both sides.
LEAST_HIT = 0.2
REACH = 40 + 2 * (12 + 8 + 16)
#: Texts whose terms are computed at once.
TEXTS = 256
#: Terms of a test set that are broadcast; more are joined.
HELD = 2_000_000
_DROP = re.compile(r"[\W_]+")
_WIDE = re.compile(r"[ᄀ-ᇿ぀-ヿ㐀-鿿가-힣\uf900-\ufaff]")


def _folded(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", replace_all(text, _letters()))
    return text.casefold()


@lru_cache(maxsize=1)
def _letters() -> dict[str, str]:
    return {chr(c): x for c, x in mapping().items()}


def compared(text: str) -> str:
    """The letters and digits of a text in one form: look-alikes, widths and
    compatibility forms made one, case folded, everything else left out."""
    return _DROP.sub("", _folded(text))


def is_wide(form: str) -> bool:
    """Most of the text is in a script of syllables or words."""
    return 2 * len(_WIDE.findall(form)) > len(form)


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: belongs to the compared form; has short terms."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    short = np.zeros(len(every), dtype=bool)
    for m in _WIDE.finditer(every):
        short[m.start()] = True
    return np.fromiter(map(str.isalnum, every), bool, len(every)), short


def _ahead(x: np.ndarray, k: int, fill: int) -> np.ndarray:
    """The values k places further on."""
    return np.concatenate((x[k:], np.full(min(k, len(x)), fill, dtype=x.dtype)))


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, term, short) of the terms that are stored of the texts'
    compared forms: positions count their letters, terms are hashes.

    A term starts at each letter; its length goes by the script of that letter
    (``short``: the shorter one). Stored are those that have the least hash in
    some window of neighbouring terms, as 32 bits of it: what meets by chance
    is told by the check of the letters. So two texts that share a run as long
    as a term and a window, less one letter, store the same term there.
    """
    alnum, short_ones = _kinds()
    forms = [_folded(t) for t in texts]
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = alnum[codes]
    row = np.repeat(np.arange(len(forms)), np.fromiter(map(len, forms), np.int64, len(forms)))[inside]
    codes = codes[inside]
    sizes = np.bincount(row, minlength=len(forms))
    pos = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[row]
    short = short_ones[codes]
    base = np.uint64(0x9E3779B97F4A7C15)
    power = [np.uint64(pow(int(base), n, 1 << 64)) for n in range(13)]
    one = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    two = one * power[1] + _ahead(one, 1, 0)
    four = two * power[2] + _ahead(two, 2, 0)
    six = four * power[2] + _ahead(two, 4, 0)
    twelve = six * power[6] + _ahead(six, 6, 0)
    term = np.where(short, six, twelve)
    for shift in (33, 29):
        term ^= term >> np.uint64(shift)
        term *= np.uint64(0xFF51AFD7ED558CCD)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    whole = sizes[row] - pos >= np.where(short, SIZES[True][0], SIZES[False][0])
    term = np.where(whole, term, most)
    stored = np.zeros(len(term), dtype=bool)
    for wide in (True, False):
        least, k = term, 1
        while k < SIZES[wide][1]:
            least = np.minimum(least, _ahead(least, k, int(most)))
            k *= 2
        # the greatest of the minima of all windows around a term is the term itself if it is one of them
        back = least[::-1]
        k = 1
        while k < SIZES[wide][1]:
            back = np.maximum(back, _ahead(back, k, 0))
            k *= 2
        stored |= (term == back[::-1]) & (short if wide else True)
    at = np.flatnonzero(stored & whole)
    return row[at], pos[at].astype(np.int32), (term[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), short[at]


def stretch(passage: str, text: str, wide: bool) -> int:
    """Letters of the longest stretch of ``passage`` that stands unbroken in
    ``text`` (both in compared form).

    Blocks of equal letters are chained in the order of both texts; between
    two of them at most one gap's length of letters may differ or be missing
    in the passage, and be put in its place in the text. The stretch runs from
    the first block's begin to the last one's end, with what was changed
    between them; but the changed letters may be no more than ``MOST_CHANGED`` of it.
    """
    block, gap = SIZES[wide][2:]
    n = len(passage)
    if n <= block:
        return n if passage in text else 0
    at: dict[str, list[int]] = {}
    for i in range(n - block + 1):
        at.setdefault(passage[i : i + block], []).append(i)
    open_runs: dict[int, list[int]] = {}
    runs: list[list[int]] = []  # [begin in text, begin in passage, length]
    for p in range(len(text) - block + 1):
        for i in at.get(text[p : p + block], ()):
            run = open_runs.get(p - i)
            if run is not None and run[0] + run[2] == p + block - 1:
                run[2] += 1
            else:
                run = [p, i, block]
                open_runs[p - i] = run
                runs.append(run)
    runs.sort()
    best = 0
    ends: list[tuple[int, int, int, int, int]] = []  # text end, passage end, passage begin, matched, text begin
    for p, i, size in runs:
        begin, matched = i, size
        ends = [e for e in ends if p - e[0] <= gap]  # the others are too far back for all that follow
        for te, pe, pb, m, _ in reversed(ends):
            over = max(0, te - p, pe - i)
            if over < size and p - te <= gap and i - pe <= gap and p > te - size and i > pe - size and pb <= i:
                if m + size - over > matched or (m + size - over == matched and pb < begin):
                    begin, matched = pb, m + size - over
        ends.append((p + size, i + size, begin, matched, p))
        span = i + size - begin
        if span - matched <= MOST_CHANGED * span:
            best = max(best, span)
    return best


def _postings(rows: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` columns of ``rows`` with term, pos and short for every
    term stored of the last column, a text. Narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS)):
            row, pos, term, short = terms_of(batch.column(keep).to_pylist())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:keep]), pa.array(term), pa.array(pos), pa.array(short)], names=[*batch.schema.names[:keep], "term", "pos", "short"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:keep])
    return rows.mapInArrow(work, schema + "term int, pos int, short boolean")


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The positional index of a corpus: key, text_key (a hash of the text),
    term, pos; written to the shared folder, to be asked by any number of test
    sets (see :func:`find_leaks`). Null keys and texts have no postings.

    Plan: one narrow pass. The table is partitioned by documents, as they are
    read: an intersection happens within a document, so postings need not be
    brought together by term, and no posting is shuffled.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    return cut_lineage(_postings(rows, 2).select("key", "text_key", "term", "pos"))


def _asked(tests: DataFrame, item: str, passage: str) -> DataFrame:
    """item, q (a number of the passage), passage (in compared form) and
    n_letters, of the test rows that have letters or digits; distinct."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [compared(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array([is_wide(f) for f in forms], pa.bool_())], names=["item", "passage", "wide"])

    rows = tests.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).alias("item"), F.col(passage).cast("string").alias("passage")).distinct()
    kind = tests.schema[item].dataType.simpleString()
    forms = rows.mapInArrow(work, f"item {kind}, passage string, wide boolean").where("passage <> ''").distinct()
    return cut_lineage(forms.withColumn("q", F.xxhash64("item", "passage")).withColumn("n_letters", F.char_length("passage")))


def _rarest(index: DataFrame, asked: DataFrame) -> DataFrame:
    """term, q, off, need: of every part of each passage the term that the
    index has least often, and at least once; and how many of them a text must
    hold. Ties go to the first."""
    terms = cut_lineage(_postings(asked.select("q", "passage"), 1))
    distinct = terms.select("term").distinct()
    there = index.join(F.broadcast(distinct) if terms.count() <= HELD else distinct, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    part = F.floor(F.col("pos") / F.when(F.col("short"), PART[True]).otherwise(PART[False]))
    nth = F.row_number().over(Window.partitionBy("q", "short", part).orderBy("n", "pos"))
    rare = terms.join(there, "term").withColumn("nth", nth).where("nth = 1").select("term", "q", F.col("pos").alias("off"))
    parts = terms.groupBy("q").agg(F.count_distinct("short", part).alias("parts"))
    return rare.join(parts, "q")


def _short(asked: DataFrame) -> F.Column:
    """Passages whose least stretch can be shorter than a term and a window."""
    return F.col("n_letters") * LEAST < F.when(F.col("wide"), SIZES[True][0] + SIZES[True][1] - 1).otherwise(SIZES[False][0] + SIZES[False][1] - 1)


def find_leaks(docs: DataFrame, key: str, text: str, tests: DataFrame, item: str, passage: str, least: float = LEAST, index: DataFrame | None = None) -> DataFrame:
    """Documents that hold a test passage: key, item, share; distinct pairs.

    ``share`` is the part of the passage's letters and digits that stands in
    one stretch, see :func:`stretch`; rows have share >= ``least``. Null, empty
    and letterless passages or texts are in no pair. A key that repeats with
    several texts is judged for each and named once. Extra columns are not
    looked at. ``index`` is the one of ``docs``, see :func:`build_index`; it
    is built if none is given.

    Plan: the index is read for how often it has the test terms, and for the
    postings of the rarest of each part. A document and a passage meet where
    enough parts have postings one after another; the texts of these pairs
    only are joined and checked. Test terms are broadcast up to HELD, beyond that
    joined; nothing else is held by a task, and nothing by the driver.
    Passages too short to be sure of a stored term are looked for in all texts
    by their terms of all positions, in one more narrow pass.
    """
    spark = docs.sparkSession
    kinds = f"key {docs.schema[key].dataType.simpleString()}, item {tests.schema[item].dataType.simpleString()}, share double"
    asked = _asked(tests, item, passage)
    index = build_index(docs, key, text) if index is None else index
    rare = cut_lineage(_rarest(index, asked))
    held = F.broadcast(rare) if rare.count() <= HELD else rare
    # which parts a text holds, in runs of postings that stand close to each other
    pair = ["key", "text_key", "q"]
    in_order = Window.partitionBy(*pair).orderBy("at")
    hits = index.join(held.drop("parts"), "term").select(*pair, (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("off")).alias("at"))  # both in one, to be sorted
    pos, off = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(2**32 - 1))
    hits = hits.withColumn("apart", pos - F.lag(pos).over(in_order) > REACH)
    hits = hits.withColumn("run", F.count_if("apart").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = hits.groupBy(*pair, "run").agg(F.size(F.collect_set(off)).alias("n"), F.min(pos - off).cast("int").alias("low"), F.max(pos - off).cast("int").alias("high"))
    runs = runs.where(F.col("n") >= least * LEAST_HIT).join(rare.groupBy("q").agg(F.max("parts").alias("parts")), "q")
    pairs = cut_lineage(runs.where(F.col("n") >= F.greatest(F.lit(1.0), F.col("parts") * least * LEAST_HIT)).select(*pair, "low", "high"))
    given = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    texts = given.join(pairs, ["key", "text_key"]).join(asked.select("q", "item", "passage", "wide"), "q").select("key", "item", "text", "passage", "wide", "low", "high")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form: dict[str, str] = {}
            shares = []
            for t, p, wide, low, high in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if t not in form:
                    form = {t: compared(t)}  # pairs of one text mostly come together
                around = SIZES[wide][3] + len(p)
                shares.append(stretch(p, form[t][max(0, low - around) : high + len(p) + around], wide) / len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["key", "item", "share"])

    found = texts.mapInArrow(check, kinds)
    short = asked.where(_short(asked))
    if not short.isEmpty():
        found = found.unionByName(_scanned(given.select("key", "text"), short, kinds))
    return found.where(F.col("share") >= least).groupBy("key", "item").agg(F.max("share").alias("share"))


#: Short passages that one pass over the texts looks for.
SHORT_ROWS = 50_000


def _scanned(given: DataFrame, short: DataFrame, kinds: str) -> DataFrame:
    """Pairs of all texts with short passages, which are dealt over passes."""
    spark = given.sparkSession
    passes = max(1, -(-short.count() // SHORT_ROWS))
    numbered = cut_lineage(short.withColumn("pass", F.pmod("q", F.lit(passes))))
    out = None
    for n in range(passes):
        shared = spark.sparkContext.broadcast([(r["item"], r["passage"], r["wide"]) for r in numbered.where(F.col("pass") == n).collect()])  # about SHORT_ROWS
        found = given.mapInArrow(_looker(shared, to_arrow_type(short.schema["item"].dataType)), kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _looker(shared, item_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        own = shared.value
        where: dict[str, list[int]] = {}
        for q, (_, p, wide) in enumerate(own):
            block = min(SIZES[wide][2], len(p))
            for i in range(len(p) - block + 1):
                where.setdefault(p[i : i + block], []).append(q)
        automaton = ahocorasick.Automaton()
        for block, qs in where.items():
            automaton.add_word(block, qs)
        automaton.make_automaton()
        for batch in batches:
            rows, items, shares = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                form = compared(t)
                for q in sorted({q for _, qs in automaton.iter(form) for q in qs}):
                    rows.append(row)
                    items.append(own[q][0])
                    shares.append(stretch(own[q][1], form, own[q][2]) / len(own[q][1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(shares, pa.float64())], names=["key", "item", "share"])

    return work

"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.segmentation import breaks

_TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
_CLAUSE = "，、；：,;:—–。．.!?！？…·"
#: Kinds of cut, best first; ``hard`` is a cut without any boundary.
KINDS = ("sentence", "clause", "blank", "hard")


def _parts_words(c: str) -> bool:
    return not c.isalnum() and (c.isspace() or unicodedata.category(c)[0] == "P")


def unbroken(text: str) -> int:
    """Length of the longest stretch without white space and punctuation."""
    longest = run = 0
    for c in text:
        run = 0 if _parts_words(c) else run + 1
        longest = max(longest, run)
    return longest


def stretch_at_cuts(text: str, pieces: list[tuple[int, int, str]]) -> int:
    """Length of the longest stretch without white space and punctuation that
    a hard cut parts; 0 without hard cuts. A stretch longer than the limit
    leaves no other cut, so it is never missed."""
    longest = reached = 0
    for _, end, kind in pieces:
        if kind == "hard" and end >= reached:
            a = b = end
            while a > 0 and not _parts_words(text[a - 1]):
                a -= 1
            while b < len(text) and not _parts_words(text[b]):
                b += 1
            longest, reached = max(longest, b - a), b
    return longest


def cut(text: str, limit: int, overlap: int, measure: Callable[[list[str]], list[int]] | None = None) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of a text.

    Every piece measures at most ``limit`` and each one after the first starts
    ``overlap`` before the end of the one before. Sizes are characters, or
    whatever ``measure`` gives for a list of tokens. The tokens' sizes are
    summed up once; boundaries are arrays of token ends, one per kind, and the
    last one under the limit is found by binary search. A better kind of
    boundary is taken if it lies in the second half of the room, a lesser one
    else; without any, a token larger than the room is cut hard. A hard cut
    doesn't part a letter from its combining marks. A text within the limit is
    one piece; an empty text has none. An overlap that leaves no room below
    the limit is reduced to the limit less one; a limit under 1 counts as 1.
    """
    n = len(text)
    if n == 0:
        return []
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if measure is None:
        size_at = range(n + 1)  # characters: a prefix sum is the offset itself
    else:
        sizes = measure([text[a:b] for a, b in spans])
        steps: list[float] = []
        for (a, b), size in zip(spans, sizes, strict=True):
            steps += [size / (b - a)] * (b - a)
        size_at = [0, *accumulate(steps)]
    if size_at[n] <= limit:
        return [(0, n, "end")]
    sentence = sorted({p for p in breaks(text) if 0 < p < n})
    clause = [b for a, b in spans if b - a == 1 and text[a] in _CLAUSE and b < n]
    blank = [b for a, b in spans if text[a].isspace() and b < n]
    levels = (sentence, clause, blank)
    out: list[tuple[int, int, str]] = []
    start = 0
    while True:
        base = size_at[start]
        if size_at[n] - base <= limit:
            out.append((start, n, "end"))
            return out
        top = bisect_right(size_at, base + limit + 1e-9) - 1  # the furthest end
        back = bisect_left(size_at, base + overlap)  # an end must lie beyond the overlap
        middle = bisect_left(size_at, base + limit / 2)
        end, kind = 0, ""
        for floor in (max(middle, back + 1), back + 1):
            for name, at in zip(KINDS, levels, strict=False):
                i = bisect_right(at, top) - 1
                if i >= 0 and at[i] >= max(floor, start + 1):
                    end, kind = at[i], name
                    break
            if end:
                break
        if not end:
            end, kind = max(top, start + 1), "hard"
            while end > back + 1 and end > start + 1 and unicodedata.combining(text[end]):
                end -= 1
        out.append((start, end, kind))
        step = bisect_left(size_at, size_at[end] - overlap)
        start = step if step > start else end


_PIECES = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("cut", pa.string())]))


def split_oversized(df: DataFrame, text: str, limit: str, overlap: str, keep: list[str], measure: Callable | None = None) -> DataFrame:
    """The items above their limit, each with its pieces.

    Result: the columns of ``keep``, size_limit and overlap as given, n_chars,
    cut_stretch (see :func:`stretch_at_cuts`), and pieces, an array of
    (start_pos, end_pos, cut).
    Items with a null text or limit, or within the limit, give no row. Repeated
    rows stay repeated; other columns of ``df`` are dropped.

    Plan: sizes in characters are compared in the JVM, so only the oversized
    texts reach Python (one Arrow pass, no shuffle); with ``measure`` all do.
    """
    given = df.where(F.col(text).isNotNull() & F.col(limit).isNotNull())
    if measure is None:
        given = given.where(F.char_length(F.col(text)) > F.col(limit))
    given = given.select(*keep, F.col(limit).cast("int").alias("__limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("__overlap"), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits, overlaps, texts = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
            pieces = [cut(t, a, b, measure) for t, a, b in zip(texts, limits, overlaps, strict=True)]
            rows = pa.array([[{"start_pos": a, "end_pos": b, "cut": k} for a, b, k in p] for p in pieces], type=_PIECES)
            counts = pa.array([len(t) for t in texts], type=pa.int32())
            runs = pa.array([stretch_at_cuts(t, p) for t, p in zip(texts, pieces, strict=True)], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts, runs, rows], names=[*batch.schema.names[:-1], "n_chars", "cut_stretch", "pieces"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    out = given.mapInArrow(work, schema + "n_chars int, cut_stretch int, pieces array<struct<start_pos:int,end_pos:int,cut:string>>")
    return out.where(F.size("pieces") > 1).withColumnsRenamed({"__limit": "size_limit", "__overlap": "overlap"})

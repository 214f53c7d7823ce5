"""Texts put onto the times of spoken words."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import readable_count
from quirefold.operators.windows import as_of

_LETTER = regex.compile(r"[\p{L}\p{N}]")


def _weight(text: str):
    return F.greatest(F.coalesce(readable_count(text), F.lit(0)), F.lit(1))


def by_weight(parts: DataFrame, boundaries: DataFrame, group: list[str]) -> DataFrame:
    """Each part's time by its letters: between the begin of the group's first
    boundary and the end of its last one; the last part takes the rest.

    ``parts``: group, ord, text. ``boundaries``: group, ord, text, offset_ms,
    duration_ms. Adds start_ms and end_ms; parts of groups without boundaries
    get none. Windows only.
    """
    span = boundaries.groupBy(*group).agg(F.min_by("offset_ms", "ord").alias("__a"), F.max_by(F.col("offset_ms") + F.col("duration_ms"), "ord").alias("__b"))
    w = Window.partitionBy(*group)
    p = parts.join(span, group).withColumn("__w", _weight("text"))
    step = F.floor((F.col("__b") - F.col("__a")) * F.col("__w") / F.sum("__w").over(w) + 0.5).cast("long")
    p = p.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("ord") == F.max("ord").over(w)
    return p.select(*parts.columns, (F.col("__a") + F.col("__sum") - F.col("__step")).alias("start_ms"), F.when(last, F.col("__b")).otherwise(F.col("__a") + F.col("__sum")).alias("end_ms"))


def anchored(parts: DataFrame, boundaries: DataFrame, group: list[str]) -> DataFrame:
    """Each part's time on the boundaries: its place among the letters of the
    parts, scaled to the letters of the boundaries, and interpolated within
    the boundary that holds it. Columns as in :func:`by_weight`.

    Cumulative sums and two as-of look-ups; nothing is paired or folded.
    """
    w = Window.partitionBy(*group)
    upto = w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = boundaries.withColumn("__w", _weight("text")).withColumn("__to", F.sum("__w").over(upto).cast("double"))
    b = b.withColumns({"__from": F.col("__to") - F.col("__w"), "__t0": F.col("offset_ms").cast("double"), "__t1": (F.col("offset_ms") + F.col("duration_ms")).cast("double"), "__down": -F.col("__to")})
    whole = b.groupBy(*group).agg(F.max("__to").alias("__all"), F.min_by("__t0", "ord").alias("__a"), F.max_by("__t1", "ord").alias("__b"))
    p = parts.withColumn("__w", _weight("text")).withColumn("__p1", F.sum("__w").over(upto)).withColumn("__total", F.sum("__w").over(w)).join(whole, group)
    p = p.withColumns({"__s0": (F.col("__p1") - F.col("__w")) / F.col("__total") * F.col("__all"), "__s1": F.col("__p1") / F.col("__total") * F.col("__all")}).withColumn("__up", -F.col("__s1"))
    span = ["__from", "__to", "__t0", "__t1"]

    def time(at: str) -> F.Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("__from")) / F.greatest(F.lit(1.0), F.col("__to") - F.col("__from"))))
        inner = F.floor(F.col("__t0") + (F.col("__t1") - F.col("__t0")) * share + 0.5)
        return F.when(F.col(at) <= 0, F.col("__a")).when(F.col(at) >= F.col("__all"), F.col("__b")).otherwise(inner).cast("long")

    cols = p.columns
    p = as_of(p, b, group, "__s0", "__from", span).withColumn("start_ms", time("__s0")).select(*cols, "start_ms")
    p = as_of(p, b, group, "__up", "__down", span).withColumn("__end", time("__s1"))
    return p.select(*parts.columns, "start_ms", F.greatest(F.col("start_ms") + 1, F.col("__end")).alias("end_ms"))


def _plain(text) -> str:
    return "".join(_LETTER.findall(text or ""))


def take_in_turn(parts: list[str], boundaries: list[tuple[str, int, int]]) -> list[tuple[int, int]] | None:
    """(first, last) boundary of each part: boundaries are taken until a part
    has its letters, the last part takes all that is left; None if a part gets
    none, or its letters are not those of its boundaries."""
    at, out = 0, []
    for k, text in enumerate(parts):
        want, have, first = max(1, len(_plain(text))), 0, at
        while at < len(boundaries) and (have < want or k == len(parts) - 1):
            have += max(1, len(_plain(boundaries[at][0])))
            at += 1
        if at == first or _plain(text) != _plain("".join(b[0] for b in boundaries[first:at])):
            return None
        out.append((first, at - 1))
    return out


def assign(parts: DataFrame, boundaries: DataFrame, group: list[str]) -> DataFrame:
    """Each part's time by its own boundaries, where their texts agree in the
    whole group; else by :func:`anchored`. Adds start_ms, end_ms and source
    (text, anchored). Groups without boundaries give no rows.

    Taking boundaries in turn depends on what was taken before, so a group is
    handed to one task; a group is one recording.
    """
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.schema.fields) + "start_ms bigint, end_ms bigint"

    def work(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, b = p.sort_values("ord"), b.sort_values("ord")
        spans = take_in_turn(p["text"].tolist(), list(zip(b["text"], b["offset_ms"], b["duration_ms"], strict=True))) if len(b) else None
        if not spans:
            return p.iloc[:0].assign(start_ms=pd.Series(dtype="int64"), end_ms=pd.Series(dtype="int64"))
        offset, length = b["offset_ms"].tolist(), b["duration_ms"].tolist()
        return p.assign(start_ms=[offset[i] for i, _ in spans], end_ms=[offset[j] + length[j] for _, j in spans])

    exact = parts.groupBy(*group).cogroup(boundaries.groupBy(*group)).applyInPandas(work, schema).withColumn("source", F.lit("text"))
    rest = parts.join(exact.select(*group).distinct(), group, "left_anti")
    return exact.unionByName(anchored(rest, boundaries, group).withColumn("source", F.lit("anchored")))


def reliable(boundaries: DataFrame, texts: DataFrame, group: list[str], length: str, text: str) -> DataFrame:
    """Whether a group's boundaries can be trusted: times in order (80 ms of
    overlap at most) and within the speech (250 ms over at most), and at least
    72 % of the text's letters. ``texts``: group, ``text``, ``length``."""
    w = Window.partitionBy(*group).orderBy("ord")
    end = F.col("offset_ms") + F.col("duration_ms")
    b = boundaries.withColumn("__late", F.col("offset_ms") < F.coalesce(F.lag(end).over(w), F.lit(-1)) - 80)
    sums = b.groupBy(*group).agg(F.bool_or((F.col("offset_ms") < 0) | (F.col("duration_ms") <= 0) | F.col("__late")).alias("__bad"), F.max(end).alias("__end"), F.sum(F.coalesce(readable_count("text"), F.lit(0))).alias("__n"))
    j = texts.join(sums, group, "left")
    n = F.coalesce(readable_count(text), F.lit(0))
    ok = ~F.col("__bad") & (F.col("__end") <= F.col(length) + 250) & (n > 0) & (F.col("__n") / F.greatest(n, F.lit(1)) >= 0.72)
    return j.select(*texts.columns, F.coalesce(ok, F.lit(False)).alias("reliable"))

"""Ordered rows: ranges, runs, gaps, timelines and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges_from_starts(df: DataFrame, group: list[str], start: str, last) -> DataFrame:
    """Adds end = next start - 1, or ``last`` for a group's last row; of rows
    with the same start as the row before, only the first stays."""
    w = Window.partitionBy(*group).orderBy(start)
    firsts = df.withColumn("__before", F.lag(start).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(start))).drop("__before")
    return firsts.withColumn("range_end", F.coalesce(F.lead(start).over(w) - 1, F.col(last) if isinstance(last, str) else last))


def runs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run``, the number of the run of equal neighbouring values."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w)).drop("__new")


def gaps(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Adds ``gap``: what lies between a row's start and the end of the row
    before, at least 0; null for the first."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.lag(end).over(w)
    return df.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.lit(0), F.col(start) - before)))


def middle(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``is_middle`` for the row at floor(n / 2) of each group in order,
    the upper median; a group is sorted, not held in one row."""
    w = Window.partitionBy(*group)
    return df.withColumn("is_middle", F.row_number().over(w.orderBy(*order)) - 1 == F.floor(F.count(F.lit(1)).over(w) / 2))


def timeline(df: DataFrame, group: list[str], order: list[str], duration, pause, lead_in: int = 0) -> DataFrame:
    """Adds start_at and end_at: durations one after another, each followed by
    its pause, the first after ``lead_in``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(duration + pause).over(w)
    return df.withColumn("end_at", lead_in + total - pause).withColumn("start_at", F.col("end_at") - duration)


def allocate(df: DataFrame, group: list[str], order: list[str], weight: str, budget) -> DataFrame:
    """Adds ``share``: whole parts of ``budget`` by weight, halves up; a group's
    last row takes what is left. Groups without weight give their budget to
    the last row."""
    w = Window.partitionBy(*group)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(budget * F.col(weight) / F.nullif(F.sum(weight).over(w), F.lit(0)), F.lit(0)) + 0.5).cast("long")
    out = df.withColumn("__part", part).withColumn("__before", F.coalesce(F.sum("__part").over(upto), F.lit(0)))
    is_last = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order])) == 1
    return out.withColumn("share", F.when(is_last, budget - F.col("__before")).otherwise(F.col("__part"))).drop("__part", "__before")


def allocate_times(df: DataFrame, group: list[str], order: list[str], weight: str, start, end) -> DataFrame:
    """Adds start_at, end_at: the time between ``start`` and ``end`` by weight,
    each row at least 1 and none beyond the end, the last up to it."""
    w = Window.partitionBy(*group)
    run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.greatest(F.lit(1), F.floor((end - start) * F.col(weight) / F.greatest(F.sum(weight).over(w), F.lit(1)) + 0.5).cast("long"))
    is_last = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order])) == 1
    out = df.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(run))
    done = F.when(is_last, end).otherwise(F.least(end, start + F.col("__sum")))
    return out.withColumn("end_at", done).withColumn("start_at", F.least(end, start + F.col("__sum") - F.col("__step"))).drop("__step", "__sum")


def bucket_overlap(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per bucket of ``width`` that a half-open interval touches:
    bucket, bucket_start, shared (length in it). An equi-join on the bucket
    then stands for an interval join."""
    last = F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)
    out = df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    lower = F.col("bucket") * width
    return out.withColumn("bucket_start", lower).withColumn("shared", F.greatest(F.lit(0), F.least(F.col(end), lower + width) - F.greatest(F.col(start), lower)))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the ``values`` of the last right row at or before it.

    Both sides are united and sorted by time within the key, and the last
    value is carried on; no pairs are formed. On a tie in time the right row
    counts as before; of several right rows at one time the one with the
    largest values is taken. Left rows without any keep nulls.
    """
    names = [f.name for f in left.schema.fields]
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in names]
    lft = left.select(*[F.col(c).alias(f"k_{c}") for c in on], F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("v"), *[F.col(c).alias(f"l_{c}") for c in names])
    rgt = right.select(*[F.col(c).alias(f"k_{c}") for c in on], F.col(right_at).alias("at"), F.lit(0).alias("side"), F.struct(*values).alias("v"), *blank)
    w = Window.partitionBy(*[f"k_{c}" for c in on]).orderBy("at", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lft.unionByName(rgt).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select(*[F.col(f"l_{c}").alias(c) for c in names], *[F.col(f"v.{c}").alias(c) for c in values])


def in_ranges(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """For each point the values of the range (both ends inclusive) of its key
    that holds it; ranges of one key must not overlap. Points in none keep
    nulls. An as-of look-up on the start, then a test of the end."""
    found = as_of(points, ranges, on, at, start, [end, *values])
    inside = F.col(at) <= F.col(end)
    return found.select(*points.columns, *[F.when(inside, F.col(v)).alias(v) for v in values])


def hopping_rows(df: DataFrame, group: list[str], order: list[str], size: int, hop: int) -> DataFrame:
    """One row per window of ``size`` rows that starts every ``hop`` rows:
    window_no is added to each member row."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    first = F.greatest(F.ceil((F.col("__n") - size + 1) / hop), F.lit(0))
    return df.withColumn("__n", n).withColumn("window_no", F.explode(F.sequence(first.cast("int"), F.floor(F.col("__n") / hop).cast("int")))).drop("__n")

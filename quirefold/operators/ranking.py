"""Choosing rows: best, first, evenly spaced, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their rank. Spark turns the
    rank filter into a group limit below the shuffle, so hot groups send no
    more than k rows per task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_k(df, key, order, 1).drop("rank")


def first_place_last_value(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """One row per key: the place of its first row and the value of its last;
    two partial aggregates, no sort."""
    return df.groupBy(*key).agg(F.min(order).alias("place"), F.max_by(value, order).alias(value))


def evenly_spaced(df: DataFrame, group: list[str], order: list[str], k) -> DataFrame:
    """``k`` rows (a number or a column) of every group spread evenly over its
    order: the rows round(i * (n - 1) / (k - 1)); all rows of smaller groups,
    the first if k is 1. Adds ``position`` and ``n``."""
    w = Window.partitionBy(*group)
    k = k if isinstance(k, Column) else F.lit(k)
    rows = df.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    step = (F.col("n") - 1) / F.greatest(k - 1, F.lit(1))
    nearest = F.floor(F.col("position") / F.nullif(step, F.lit(0.0)) + 0.5)
    picked = F.exists(F.array(nearest - 1, nearest, nearest + 1), lambda i: (i >= 0) & (i <= k - 1) & (F.floor(i * step + 0.5) == F.col("position")))
    return rows.where((F.col("n") <= k) | F.when(k <= 1, F.col("position") == 0).otherwise(picked))


def greedy_fill(items: Column, size_of, most: int, enough: int) -> Column:
    """Takes items of an array in turn: one that would go beyond ``most`` is
    skipped, none is taken once ``enough`` is reached."""
    kind = "array<bigint>"

    def step(acc, x):
        n = size_of(x)
        takes = (acc["total"] < enough) & (acc["total"] + n <= most)
        return F.struct(
            F.when(takes, F.concat(acc["taken"], F.array(x["ord"].cast("bigint")))).otherwise(acc["taken"]).alias("taken"),
            F.when(takes, acc["total"] + n).otherwise(acc["total"]).cast("bigint").alias("total"),
        )

    start = F.struct(F.array().cast(kind).alias("taken"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(items, start, step)


def window_of(nth: Column, size: int) -> Column:
    """The number of the window of ``size`` rows that the nth row (from 1) is in."""
    return F.floor((nth - 1) / size)


def rotating_window(items: Column, most: int, index: Column) -> Column:
    """The window of at most ``most`` items that ``index`` points to, round and
    round."""
    windows = F.greatest(F.ceil(F.size(items) / most), F.lit(1))
    return F.slice(items, (F.pmod(index, windows) * most + 1).cast("int"), most)


def set_bundles(df: DataFrame, group: list[str], member: str, least: int = 2) -> DataFrame:
    """The distinct member sets of the groups: members (sorted), groups (their
    number), of sets with at least ``least`` members."""
    sets = df.where(F.col(member).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= least)
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("groups"))


def fill_up(df: DataFrame, group: list[str], order: list[str], required: Column, most: int) -> DataFrame:
    """All rows for which ``required`` holds, and of the others as many, evenly
    spaced, as fill the group up to ``most``."""
    marked = df.withColumn("required", F.coalesce(required, F.lit(False)))
    room = F.greatest(F.lit(most) - F.count_if("required").over(Window.partitionBy(*group)), F.lit(0))
    rest = evenly_spaced(marked.withColumn("room", room).where("not required and room > 0"), group, order, F.col("room"))
    return marked.where("required").unionByName(rest.select(*marked.columns))


def budgeted_sample(df: DataFrame, group: list[str], order: list[str], size: str, budget: int, keep: Column, least: int = 2, at_once: int = 16) -> DataFrame:
    """All rows of groups whose sizes stay within ``budget``; of the others the
    rows for which ``keep`` holds, and of the rest as many, evenly spaced, as
    their share of the budget allows.

    The number is lowered from that share until the sample fits, ``least`` is
    taken in any case. Sums are not monotone in it, so each is tried, but
    ``at_once`` of them in one pass over the open groups; no group is held in
    one row. Null sizes count as 0.
    """
    rows = df.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("__keep", F.coalesce(keep, F.lit(False)))
    sums = rows.groupBy(*group).agg(F.sum("__size").alias("__all"), F.sum(F.when(F.col("__keep"), F.col("__size")).otherwise(0)).alias("__kept"), F.count_if(~F.col("__keep")).alias("__n"))
    large = sums.where(F.col("__all") > budget).withColumn("__room", F.greatest(F.lit(1), budget - F.col("__kept")))
    most = F.least(F.col("__n"), F.greatest(F.lit(least), F.floor(F.col("__n") * F.col("__room") / F.greatest(F.col("__all") - F.col("__kept"), F.lit(1)))))
    large = cut_lineage(large.select(*group, "__n", "__room", most.cast("int").alias("__k")))
    body = rows.join(large.select(*group), group, "left_semi").where("not __keep")
    body = cut_lineage(body.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1))
    open_, chosen = large, None
    while not open_.isEmpty():
        tried = open_.withColumn("__try", F.explode(F.sequence(F.col("__k"), F.greatest(F.col("__k") - at_once + 1, F.least(F.col("__k"), F.lit(least))), F.lit(-1))))
        at = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("__try") - 1, F.lit(0))), lambda i: F.floor(i * (F.col("__n") - 1) / F.greatest(F.col("__try") - 1, F.lit(1)) + 0.5).cast("int")))
        total = tried.where("__try > 0").select(*group, "__try", "__room", at.alias("__at")).join(body.select(*group, "__at", "__size"), [*group, "__at"]).groupBy(*group, "__try", "__room").agg(F.sum("__size").alias("s"))
        best = total.where((F.col("s") <= F.col("__room")) | (F.col("__try") <= least)).groupBy(*group).agg(F.max("__try").alias("__take"))
        best = cut_lineage(open_.select(*group, "__n").join(best, group))
        chosen = best if chosen is None else chosen.unionByName(best)
        open_ = cut_lineage(open_.join(best, group, "left_anti").withColumn("__k", F.col("__k") - at_once).where(F.col("__k") >= F.least(F.col("__n"), F.lit(least))))
    small = rows.join(large.select(*group), group, "left_anti")
    kept = rows.where("__keep").join(large.select(*group), group, "left_semi")
    if chosen is None:
        return small.unionByName(kept).select(*df.columns)
    picks = chosen.select(*group, F.explode(F.transform(F.sequence(F.lit(0), F.col("__take") - 1), lambda i: F.floor(i * (F.col("__n") - 1) / F.greatest(F.col("__take") - 1, F.lit(1)) + 0.5).cast("int"))).alias("__at")).distinct()
    return small.unionByName(kept).select(*df.columns).unionByName(body.join(picks, [*group, "__at"], "left_semi").select(*df.columns))

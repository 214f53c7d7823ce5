"""Constraints and referential integrity: one rule, one table of violations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIOLATION = ("code", "artifact", "item", "detail")


@dataclass(frozen=True)
class Rule:
    """A declared rule: how grave a violation is (BLOCK, WARN, INFO), whether
    it blocks what follows, and what is to be done again."""

    code: str
    severity: str
    blocking: bool
    retry: str


def described(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations with severity, blocking and retry_strategy of their rules;
    codes without a rule get nulls. The rules are constants of the plan."""

    def of(name: str) -> Column:
        out = F.lit(None)
        for r in rules:
            out = F.when(F.col("code") == r.code, F.lit(getattr(r, name))).otherwise(out)
        return out

    return df.select("*", of("severity").alias("severity"), of("blocking").alias("blocking"), of("retry").alias("retry_strategy"))


def violations(df: DataFrame, code: str, artifact: str, item, detail=None) -> DataFrame:
    """Rows of ``df`` as violations."""
    return df.select(
        F.lit(code).alias("code"),
        F.lit(artifact).alias("artifact"),
        (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"),
        (F.lit("") if detail is None else F.coalesce((F.col(detail) if isinstance(detail, str) else detail).cast("string"), F.lit(""))).alias("detail"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All violation tables as one."""
    return reduce(DataFrame.unionByName, parts)


def check(df: DataFrame, bad: Column, code: str, artifact: str, item, detail=None) -> DataFrame:
    """Rows for which ``bad`` holds; an unknown condition is no violation."""
    return violations(df.where(bad), code, artifact, item, detail)


def later_duplicates(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its key. Rows with a null in the key are
    compared too. One shuffle on the key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("nth", n).where("nth > 1")


def overlapping(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Rows that start at or before the largest end of the rows before them."""
    w = Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("end_before", F.max(end).over(w)).where(F.col(start) <= F.col("end_before"))


def missing_numbers(df: DataFrame, group: list[str], number: str, first: int = 1) -> DataFrame:
    """The whole numbers between ``first`` and a group's largest that no row has.

    Gaps are told by the next smaller number, so only what is missing is
    generated, not the whole range."""
    have = df.where(F.col(number).isNotNull() & (F.col(number) >= first)).select(*group, number).distinct()
    before = F.lag(number, 1, first - 1).over(Window.partitionBy(*group).orderBy(number))
    gaps = have.withColumn("__before", before).where(F.col(number) - F.col("__before") > 1)
    return gaps.select(*group, F.explode(F.sequence(F.col("__before") + 1, F.col(number) - 1)).alias(number))


def dangling(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """References whose key no target has; null keys refer to nothing."""
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return refs.where(there).join(targets.select(*on).distinct(), on, "left_anti")


def coverage_difference(left: DataFrame, right: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Full comparison of two keyed tables: keys only on one side, and keys
    whose columns ``same`` differ: the key and state (only_left, only_right,
    differs)."""
    a = left.select(*on, F.struct(*same).alias("__a"), F.lit(1).alias("__la"))
    b = right.select(*on, F.struct(*same).alias("__b"), F.lit(1).alias("__lb"))
    state = F.when(F.col("__lb").isNull(), "only_left").when(F.col("__la").isNull(), "only_right").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return a.join(b, on, "full_outer").select(*on, state.alias("state")).where(F.col("state").isNotNull())


def all_of(children: DataFrame, group: list[str], holds: Column) -> DataFrame:
    """Groups with at least one row all of whose rows satisfy ``holds``."""
    return children.groupBy(*group).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("__all")).where("__all").drop("__all")


def same_ids(a: Column, b: Column) -> Column:
    """Two id arrays hold the same ids, none twice."""
    return (F.size(a) == F.size(F.array_distinct(a))) & (F.size(b) == F.size(F.array_distinct(b))) & (F.array_sort(a).eqNullSafe(F.array_sort(b)))


def covers(outer: Column, inner: Column) -> Column:
    """Every id of ``inner`` is in ``outer``."""
    return F.size(F.array_except(inner, outer)) == 0

"""References to records that do not exist, over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key beyond which its references are dealt over several tasks.
HOT_ROWS = 200_000
SALTS = 64


def plain_key(c):
    """A key in the form in which keys are compared: lower case, no outer
    blanks; blank and null keys become null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def utc_month(at):
    """YYYY-MM of a time in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM")


def parent_keys(df: DataFrame, name: str, key: str, scope: str = "book_id", since: str = "ingested_at", until: str = "deleted_at") -> DataFrame:
    """Tagged keys of one referred table: target, scope, key, since, until."""
    return df.select(
        F.lit(name).alias("target"),
        F.col(scope).cast("string").alias("scope"),
        plain_key(F.col(key)).alias("key"),
        F.col(since).alias("since"),
        F.col(until).alias("until"),
    ).where(F.col("key").isNotNull() & F.col("since").isNotNull())


def child_keys(df: DataFrame, ref_table: str, target: str, owner: str, key, at: str, scope: str = "book_id") -> DataFrame:
    """Tagged references of one referring table: ref_table, target, scope,
    key, owner, at. ``key`` is a column name or expression; null and blank
    keys refer to nothing and are left out, as are references without time."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(
        F.lit(ref_table).alias("ref_table"),
        F.lit(target).alias("target"),
        F.col(scope).cast("string").alias("scope"),
        plain_key(key).alias("key"),
        F.col(owner).cast("string").alias("owner"),
        F.col(at).alias("at"),
    ).where(F.col("key").isNotNull() & F.col("at").isNotNull())


def find_orphans(parents: list[DataFrame], children: list[DataFrame], hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """References whose target was not there at their time.

    Result, distinct: ref_table, owner, scope, key, at, reason. A target is
    there at time t if one of its rows has since <= t and until null or > t.
    reason is ``missing`` if no row of the key exists at all, ``late`` if all
    of them came after t, else ``deleted``. Repeated rows count once; ties in
    time are settled as written above. Empty tables give no rows (children
    without any parents are all ``missing``). Rows with a null scope match
    rows with a null scope.

    Plan: parent and child keys are united in long form as events on a time
    line - a parent row opens at ``since`` and closes at ``until`` - and
    grouped by target table, scope and key. A running sum over each group
    tells how many rows are open at a reference; a group without opening
    events lacks the parent flag. One shuffle on the key; the sort spills, no
    group is collected. References of keys with more than ``hot_rows`` rows
    are dealt over ``salts`` sub-groups, to each of which the few events of
    that key are copied.
    """
    kids = reduce(DataFrame.unionByName, children).distinct()
    rows = reduce(DataFrame.unionByName, parents)
    ids = ["target", "scope", "key"]
    hot = kids.groupBy(*ids).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*[F.col(c).alias(f"__{c}") for c in ids], F.lit(True).alias("__hot"))
    versions = rows.distinct()
    opens = versions.select(*ids, F.col("since").alias("at"), F.lit(1).alias("step"))
    closes = versions.where(F.col("until").isNotNull()).select(*ids, F.col("until").alias("at"), F.lit(-1).alias("step"))

    def flagged(df: DataFrame) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ids])
        return df.join(hot, on, "left").drop(*[f"__{c}" for c in ids])

    none = F.lit(None).cast("string")
    events = (
        flagged(opens.unionByName(closes))
        .withColumn("salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .select(*ids, "salt", "at", "step", F.lit(0).alias("is_child"), none.alias("ref_table"), none.alias("owner"))
    )
    refs = flagged(kids).select(
        *ids,
        F.when(F.col("__hot"), F.pmod(F.xxhash64("ref_table", "owner", "at"), F.lit(salts)).cast("int")).otherwise(F.lit(0)).alias("salt"),
        "at",
        F.lit(0).alias("step"),
        F.lit(1).alias("is_child"),
        "ref_table",
        "owner",
    )
    group = Window.partitionBy(*ids, "salt")
    so_far = group.orderBy("at", "is_child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("step") > 0, 1).otherwise(0)
    return (
        events.unionByName(refs)
        .withColumn("__open", F.sum("step").over(so_far))
        .withColumn("__seen", F.sum(opened).over(so_far))
        .withColumn("__ever", F.sum(opened).over(group))
        .where((F.col("is_child") == 1) & (F.col("__open") <= 0))
        .select(
            "ref_table",
            "owner",
            "scope",
            "key",
            "at",
            F.when(F.col("__ever") == 0, "missing").when(F.col("__seen") == 0, "late").otherwise("deleted").alias("reason"),
        )
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referring table, UTC month and reason: orphans,
    orphan_targets (distinct targets). The count of distinct targets is made
    in two steps, so a hot month does not gather its rows in one task."""
    by = [F.col("ref_table"), utc_month(F.col("at")).alias("period"), F.col("reason")]
    per_key = orphans.groupBy(*by, "scope", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "period", "reason").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("orphan_targets"))

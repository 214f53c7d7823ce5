"""Work that is done again only if its input changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut_lineage


def fingerprint(*parts) -> Column:
    """sha256 over parts joined by a separator; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def reuse(work: DataFrame, done: DataFrame, key: str, print_column: str = "input_hash") -> DataFrame:
    """``work`` with state: hit if the result table has the key with the same
    fingerprint, stale if with another one, else miss. Only hits need no work."""
    have = done.groupBy(key).agg(F.max_by(print_column, print_column).alias("__have"))
    state = F.when(F.col("__have").isNull(), "miss").when(F.col("__have") == F.col(print_column), "hit").otherwise("stale")
    return work.join(have, key, "left").withColumn("state", state).drop("__have")


def create_or_reuse(work: DataFrame, done: DataFrame, key: str, provider: Callable[[DataFrame], DataFrame], valid: Column, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Results for ``work`` (``key``, input_hash and what the provider needs):
    those of ``done`` with the same fingerprint that still satisfy ``valid``,
    and for the others what ``provider`` makes of their rows. Results that
    don't satisfy it are asked for again, up to ``attempts`` times; what is
    left over is the second result (the rows for review).

    ``provider`` maps a DataFrame to one with ``key``, input_hash and the
    columns of ``done``: a plan, mapInArrow, or a join with a table of results.
    """
    have = done.where(valid).select(*done.columns)
    hits = work.select(key, "input_hash").distinct().join(have, [key, "input_hash"]).select(*done.columns)
    results, open_ = hits, work.join(hits.select(key).distinct(), key, "left_anti")
    for _ in range(attempts):
        new = cut_lineage(provider(open_).select(*done.columns).where(valid))
        results = results.unionByName(new)
        open_ = cut_lineage(open_.join(new.select(key).distinct(), key, "left_anti"))
        if open_.isEmpty():
            break
    return results, open_


def pipeline(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stages, each a function from DataFrame to DataFrame, as one."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run

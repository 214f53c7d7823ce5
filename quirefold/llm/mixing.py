"""Sources mixed to target weights by entropy balancing.

Each document gets a rate, the number of times it is to be used on average.
Among all rates that give every source its tokens, those closest to one use
each (in relative entropy) are an exponential tilt, rate = exp(a * tokens),
cut off at the most uses allowed; one number ``a`` per source, found by Newton
steps on the convex dual. Each step is one aggregation over the documents.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

#: Rows of a source that are rounded in one task.
BUCKET_ROWS = 50_000


def plain_source(c):
    """Source names that differ in case or outer blanks are one."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str, pattern: str) -> DataFrame:
    """The columns of ``keep`` and n_tokens, by a byte-level BPE whose ranks lie
    in the file ``vocabulary`` of the driver; it is sent to the executors, and
    read once by each of their processes. A null text has 0 tokens. Narrow."""
    import tiktoken  # noqa: F401  (fails here rather than in the tasks)

    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    given = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(work, schema + "n_tokens bigint")


def solve(sizes: DataFrame, wanted: dict[str, float], most: dict[str, int], scale: float, rounds: int = 60) -> dict[str, float]:
    """The tilt of each source: sum of t * min(most, exp(a * t / scale)) over its
    documents equals its wanted tokens.

    ``sizes``: source, n_tokens, n (documents of that size). Newton steps, held
    in a bracket that shrinks; the driver keeps two numbers per source.
    """
    tilt = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    open_ = set(wanted)
    for _ in range(rounds):
        if not open_:
            break
        at = F.create_map(*[F.lit(x) for s in open_ for x in (s, tilt[s])])
        cap = F.create_map(*[F.lit(x) for s in open_ for x in (s, float(most[s]))])
        t = F.col("n_tokens").cast("double")
        rate = F.exp(F.least(F.element_at(at, F.col("source")) * t / scale, F.lit(50.0)))
        top = F.element_at(cap, F.col("source"))
        sums = (
            sizes.where(F.col("source").isin(*open_))
            .groupBy("source")
            .agg(F.sum(F.col("n") * t * F.least(rate, top)).alias("f"), F.sum(F.when(rate < top, F.col("n") * t * t / scale * rate).otherwise(0.0)).alias("d"))
            .collect()  # one row per target
        )
        for r in sums:
            s, off = r["source"], r["f"] - wanted[r["source"]]
            if abs(off) <= 1e-9 * max(1.0, wanted[s]):
                open_.discard(s)
                continue
            if off > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - off / r["d"] if r["d"] > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]):
                    step = high[s] - max(1.0, 2 * abs(high[s]))
                elif math.isinf(high[s]):
                    step = low[s] + max(1.0, 2 * abs(low[s]))
                else:
                    step = (low[s] + high[s]) / 2
            tilt[s] = step
    return tilt


def balance(docs: DataFrame, key: str, targets: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Copies per document, and a report per source.

    ``docs``: ``key``, source, n_tokens. ``targets``: source, target_share,
    max_repeats; a source named twice has the sum of its shares and the least
    repeats. The mix is as large as the sources allow, up to the tokens that
    the targeted sources have: no source can give more than its tokens times
    max_repeats. Shares of targets without documents are dealt to the others
    in proportion, and reported as 0.

    First result: key, source, n_tokens, rate, copies (>= 1). Documents
    without a target, or without tokens, are not used. Second: source,
    target_share, max_repeats, n_documents, tokens_available, tokens_used,
    actual_share, most_copies. Rates become copies by systematic rounding: the
    copies of the first k documents of a bucket differ from the sum of their
    rates by less than one. Repeated rows count as one; empty tables give
    empty copies, and a report with zeros.

    Plan: documents are reduced to a table of sizes before the solver runs; a
    source is cut into buckets by a hash, so a hot one is spread.
    """
    goal = (
        targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    rows = docs.select(F.col(key), plain_source(F.col("source")).alias("source"), F.col("n_tokens")).where(F.col(key).isNotNull() & (F.col("n_tokens") > 0)).distinct()
    used = cut_lineage(rows.join(goal, "source").select(key, "source", "n_tokens"))
    sizes = cut_lineage(used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: (r["tokens"], r["n"]) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n")).collect()}
    plan = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in goal.collect()}
    open_share = sum(plan[s][0] for s in have)
    total = float(sum(t for t, _ in have.values()))
    room = min([total, *(have[s][0] * plan[s][1] * open_share / plan[s][0] for s in have)]) if have else 0.0
    wanted = {s: room * plan[s][0] / open_share for s in have}
    full = {s for s in have if wanted[s] >= have[s][0] * plan[s][1] * (1 - 1e-12)}
    scale = total / max(1, sum(n for _, n in have.values()))
    tilt = solve(sizes, {s: w for s, w in wanted.items() if s not in full}, {s: plan[s][1] for s in have}, max(scale, 1.0))
    tilt |= dict.fromkeys(full, 1e6)
    spark = docs.sparkSession
    solved = spark.createDataFrame([(s, tilt[s], float(plan[s][1]), max(1, have[s][1] // bucket_rows)) for s in have], "source string, tilt double, most double, buckets int")
    rated = used.join(F.broadcast(solved), "source").withColumn("rate", F.least(F.col("most"), F.exp(F.least(F.col("tilt") * F.col("n_tokens") / F.lit(max(scale, 1.0)), F.lit(700.0)))))
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64(key), F.col("buckets")))
    run = Window.partitionBy("source", "bucket").orderBy("n_tokens", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rated.withColumn("__sum", F.sum("rate").over(run))
    copies = F.floor(F.col("__sum") + 0.5 + 1e-9) - F.floor(F.col("__sum") - F.col("rate") + 0.5 + 1e-9)
    given = sums.select(key, "source", "n_tokens", "rate", F.least(copies, F.col("most")).cast("int").alias("copies"))
    per = given.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens_available"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    all_used = F.sum("tokens_used").over(Window.partitionBy())  # one row per target
    report = goal.join(per, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "tokens_available", "tokens_used")],
        F.coalesce(F.col("tokens_used") / all_used, F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return given.where("copies > 0"), report

"""Every query of the text problems runs on whole small tables, and agrees
with its SQL where it has one."""

from glob import glob
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert len(got) == len(set(got)) and (got or name == "p9_found" or name == "p7_found")
    if name in queries.SQL:
        c = duckdb.connect()
        for f in glob(f"{SF}/*.parquet"):
            c.execute(f"create view {Path(f).stem} as select * from '{f}'")
        d = c.execute(queries.SQL[name])
        at = [[x[0] for x in d.description].index(k) for k in df.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in d.fetchall()), key=repr)


def test_mix_keeps_its_promises(spark):
    sf = "/root/testdata/sf0.01"
    report, copies = queries.p8_shares(spark, sf), queries.p8_copies(spark, sf)
    largest = copies.agg(F.max("n_tokens")).first()[0]
    rows = [r for r in report.collect() if r["tokens_available"]]
    total, open_share = sum(r["tokens_used"] for r in rows), sum(r["target_share"] for r in rows)
    room = min(r["tokens_available"] * r["max_repeats"] * open_share / r["target_share"] for r in rows)
    for r in rows:
        assert r["most_copies"] <= r["max_repeats"]
        assert abs(r["tokens_used"] - min(room, sum(x["tokens_available"] for x in rows)) * r["target_share"] / open_share) <= largest * 2
    used = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    assert used == {r["source"]: r["tokens_used"] for r in rows if r["tokens_used"]} and total == sum(used.values())


def test_segments_of_every_block(spark):
    blocks = spark.read.parquet(f"{SF}/blocks.parquet").where(r"original_text rlike '\\p{L}'").select("book_id", "block_id").distinct()
    assert blocks.join(queries.p4_segments(spark, SF), ["book_id", "block_id"], "left_anti").count() == 0

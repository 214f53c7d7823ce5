from datetime import datetime, timedelta

from quirefold.operators.orphans import child_keys, find_orphans, orphan_report, parent_keys

T0 = datetime(2025, 1, 1)
P = "book_id string, block_id string, ingested_at timestamp, deleted_at timestamp, key string"
C = "ref_id bigint, book_id string, block_id string, ref_at timestamp, at string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, parents, children, **kw):
    p = spark.createDataFrame([(b, k, day(a), day(z), "clash") for b, k, a, z in parents], P)
    c = spark.createDataFrame([(i, b, k, day(t), "clash") for i, b, k, t in children], C)
    out = find_orphans([parent_keys(p, "blocks", "block_id")], [child_keys(c, "refs", "blocks", "ref_id", "block_id", "ref_at")], **kw)
    return out, {(r["owner"], r["reason"]) for r in out.collect()}


PARENTS = [("b", "k1", 0, None), ("b", "K2 ", 10, None), ("b", "k3", 0, 5), ("b", "k3", 0, 5), ("b", "k4", 0, 5), ("b", "k4", 5, None), ("b", None, 0, None), (None, "k9", 0, None), ("b", "k5", None, None)]
CHILDREN = [
    (1, "b", " k1", 1), (2, "b", "k2", 9), (3, "b", "k2", 10), (4, "b", "k3", 5), (5, "b", "k3", 4), (6, "b", "k4", 5), (7, "b", "none", 1),
    (8, "b", " ", 1), (9, "b", None, 1), (10, "c", "k1", 1), (11, "b", "k1", None), (12, None, "k9", 1), (13, "b", "k5", 1), (7, "b", "none", 1),
]
WANT = {("2", "late"), ("4", "deleted"), ("7", "missing"), ("10", "missing"), ("13", "missing")}


def test_reasons_ties_nulls_and_repeats(spark):
    out, got = run(spark, PARENTS, CHILDREN)
    assert got == WANT
    assert out.count() == len(WANT)


def test_hot_keys_are_dealt_with_the_same_result(spark):
    assert run(spark, PARENTS, CHILDREN, hot_rows=0, salts=3)[1] == WANT
    many = [(100 + i, "b", "k3", i % 12) for i in range(300)]
    assert run(spark, PARENTS, many, hot_rows=50, salts=4)[1] == run(spark, PARENTS, many)[1] == {(str(100 + i), "deleted") for i in range(300) if i % 12 >= 5}


def test_empty_tables_and_report(spark):
    assert run(spark, [], [])[1] == set()
    out, got = run(spark, [], [(1, "b", "x", 1), (2, "b", "X ", 40)])
    assert got == {("1", "missing"), ("2", "missing")}
    rows = sorted(tuple(r) for r in orphan_report(out).collect())
    assert rows == [("refs", "2025-01", "missing", 1, 1), ("refs", "2025-02", "missing", 1, 1)]

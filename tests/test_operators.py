"""Relational operators on small tables, against plain Python."""

import random

from pyspark.sql import functions as F

from quirefold.operators import cache, layout, ranking, rules, similarity, windows
from quirefold.sources.documents import assemble_chunks, read_json_documents, write_json_documents
from quirefold.streaming import events as E


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_evenly_spaced(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 10), ("b", 3), ("c", 5)) for i in range(n)], "g string, i int")
    for k in (1, 2, 4, 5):
        got = rows(ranking.evenly_spaced(df, ["g"], ["i"], k), "g", "i")
        want = []
        for g, n in (("a", 10), ("b", 3), ("c", 5)):
            take = range(n) if n <= k else {int(i * (n - 1) / (k - 1) + 0.5) for i in range(k)} if k > 1 else {0}
            want += [(g, i) for i in take]
        assert got == sorted(want)


def test_missing_numbers_and_ranges(spark):
    df = spark.createDataFrame([("a", 2), ("a", 5), ("a", 5), ("b", 1), ("b", None), ("c", -3)], "g string, n int")
    assert rows(rules.missing_numbers(df, ["g"], "n"), "g", "n") == [("a", 1), ("a", 3), ("a", 4)]
    starts = spark.createDataFrame([("a", 1, 99), ("a", 5, 99), ("a", 5, 99), ("a", 9, 99)], "g string, s int, last int")
    assert rows(windows.ranges_from_starts(starts, ["g"], "s", "last"), "s", "range_end") == [(1, 4), (5, 8), (9, 99)]


def test_rules(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    r = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, k string")
    assert rows(rules.dangling(r, t, ["k"]), "id") == [(2,)]
    o = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, v int")
    assert rows(rules.coverage_difference(t, o, ["k"], ["v"]), "k", "state") == [("b", "differs"), ("c", "only_right")]
    assert rules.overlapping(spark.createDataFrame([("g", 1, 9), ("g", 3, 4), ("g", 10, 11)], "g string, a int, b int"), ["g"], "a", "b").count() == 1
    dup = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "k string, o int")
    assert rules.later_duplicates(dup, ["k"], ["o"]).count() == 2
    assert rules.union_all([rules.check(t, F.col("v") > 1, "C", "t", "k")]).collect()[0]["item"] == "b"


def test_as_of_and_ranges(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(50), i) for i in range(60)]
    right = [(rng.choice("abc"), t, t) for t in rng.sample(range(50), 12)]
    got = rows(windows.as_of(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"]), "id", "v")
    want = sorted((i, max((v for kk, u, v in right if kk == k and u <= t), default=None)) for k, t, i in left)
    assert got == want
    r = spark.createDataFrame([("a", 0, 9, "x"), ("a", 20, 29, "y")], "k string, s int, e int, n string")
    p = spark.createDataFrame([("a", 5), ("a", 15), ("a", 29), ("b", 5)], "k string, t int")
    assert [x[2] for x in rows(windows.in_ranges(p, r, ["k"], "t", "s", "e", ["n"]), "k", "t", "n")] == ["x", None, "y", None]


def test_allocate_and_timeline(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("b", 0, 0)], "g string, o int, w int")
    assert rows(windows.allocate(df, ["g"], ["o"], "w", F.lit(100)), "g", "o", "share") == [("a", 0, 33), ("a", 1, 33), ("a", 2, 34), ("b", 0, 100)]
    t = windows.timeline(df, ["g"], ["o"], F.lit(10), F.lit(5), 60)
    assert rows(t.where("g = 'a'"), "start_at", "end_at") == [(60, 70), (75, 85), (90, 100)]
    c = windows.allocate_times(df.where("g = 'a'"), ["g"], ["o"], "w", F.lit(5000), F.lit(9000))
    assert rows(c, "start_at", "end_at")[0][0] == 5000 and rows(c, "end_at")[-1] == (9000,)


def test_runs_hops_buckets_gaps(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate("aabbba")] + [("u", 6, None), ("u", 7, None)], "g string, o int, v string")
    assert [r[1] for r in rows(windows.runs(df, ["g"], ["o"], "v"), "o", "run")] == [1, 1, 2, 2, 2, 3, 4, 4]
    h = windows.hopping_rows(df, ["g"], ["o"], 5, 4).groupBy("window_no").agg(F.count(F.lit(1)).alias("n"))
    assert rows(h, "window_no", "n") == [(0, 5), (1, 4)]
    b = windows.bucket_overlap(spark.createDataFrame([(0, 10), (10, 25), (5, 5)], "s int, e int"), "s", "e", 10)
    assert rows(b, "s", "bucket", "shared") == [(0, 0, 10), (5, 0, 0), (10, 1, 10), (10, 2, 5)]
    g = windows.gaps(spark.createDataFrame([("a", 0, 5), ("a", 8, 9), ("a", 7, 20)], "g string, s int, e int"), ["g"], "s", "e")
    assert rows(g.where("gap is not null"), "gap") == [(0,), (2,)]


def test_ranking_more(spark):
    e = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y")], "k string, o int, v string")
    assert rows(ranking.first_place_last_value(e, ["k"], "o", "v"), "place", "v") == [(1, "z")]
    assert rows(ranking.top_k(e, ["k"], [F.desc("o")], 2), "v", "rank") == [("y", 2), ("z", 1)]
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("size")) for i, n in enumerate((50, 100, 40, 30))])
    f = spark.range(1).select(ranking.greedy_fill(items, lambda x: x["size"], 120, 90).alias("f")).first()["f"]
    assert (f["taken"], f["total"]) == ([0, 2], 90)
    w = spark.range(1).select(ranking.rotating_window(F.array(*map(F.lit, range(5))), 2, F.lit(5)).alias("w")).first()["w"]
    assert w == [4]
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, None)], "g int, m string")
    assert rows(ranking.set_bundles(s, ["g"], "m"), "members", "groups") == [(["a", "b"], 2)]


def test_near_pairs_lose_none(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = []
    for _ in range(40):
        t = [rng.choice(words) for _ in range(8)]
        texts += [" ".join(t), " ".join(t[:-1] + [rng.choice(words)])]
    df = spark.createDataFrame([("g", str(i), t) for i, t in enumerate(texts)] + [("g", "n", None), ("g", "e", "")], "g string, id string, t string")
    f = similarity.with_features(df, "t").where("size(grams) > 0").cache()
    for least in (0.8, 0.5):
        got = rows(similarity.near_pairs(f, ["g"], "id", least), "key_a", "key_b")
        sets = {r["id"]: set(r["grams"]) for r in f.collect()}
        want = sorted((a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) >= least)
        assert got == want and want


def test_best_match(spark):
    a = similarity.with_features(spark.createDataFrame([("g", "c1", "abcd"), ("g", "c2", "zz")], "g string, c string, t string"), "t")
    b = similarity.with_features(spark.createDataFrame([("g", "b2", "xabcdx"), ("g", "b1", "abcd"), ("h", "b3", "abcd")], "g string, b string, t string"), "t")
    assert rows(similarity.best_match(a, b, ["g"], "c", "b"), "c", "b", "score") == [("c1", "b1", 1.0)]


def test_cache_and_sources(spark, tmp_path):
    w = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, t string").select("id", cache.fingerprint(F.col("t")).alias("input_hash"))
    d = spark.createDataFrame([(1, "x"), (2, "old")], "id int, t string").select("id", cache.fingerprint(F.col("t")).alias("input_hash"))
    assert rows(cache.reuse(w, d, "id"), "id", "state") == [(1, "hit"), (2, "stale"), (3, "miss")]
    write_json_documents(w, str(tmp_path / "out"))
    assert read_json_documents(spark, str(tmp_path / "out"), "id int, input_hash string", "*.json").count() >= 1
    lines = [(1, 2, '{"message":{"content":"b"}}'), (1, 1, '{"message":{"content":"a"}}'), (1, 3, "broken"), (2, 1, '{"error":"no"}')]
    out = assemble_chunks(spark.createDataFrame(lines, "k int, o int, line string"), ["k"], "o", "line")
    assert rows(out, "k", "text", "error") == [(1, "ab", None), (2, "", "no")]


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = E.windowed_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w"), "window_start", "event_type", "n") == rows(E.windowed_counts(e, "ts", ["event_type"]), "window_start", "event_type", "n")
    assert E.first_deliveries(e.union(e), "ts", ["event_id"]).count() == e.count()


def test_greedy_novelty_equals_one_by_one(spark):
    rng = random.Random(6)
    edges = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08}
    order = {k: rng.randrange(15) for k in range(40)}  # with ties
    nodes = spark.createDataFrame([(k, order[k]) for k in range(40)], "k int, o int")
    pairs = spark.createDataFrame(sorted(edges), "key_a int, key_b int")
    kept = []
    for k in sorted(range(40), key=lambda k: (order[k], k)):
        if not any((min(k, j), max(k, j)) in edges for j in kept):
            kept.append(k)
    assert rows(similarity.greedy_novelty(nodes, pairs, "k", "o"), "k") == [(k,) for k in sorted(kept)]
    assert similarity.greedy_novelty(nodes, pairs.limit(0), "k", "o").count() == 40


L = "doc_id int, idx int, page int, text string, y double, height double"


def test_detect_chapters(spark):
    lines = [
        (3, "目录", 610.0, 9.0), (3, "第一章北岸灯塔的来历 ........ 1", 580.0, 9.0), (3, "第二章 换班与巡视 ........ 21", 560.0, 9.0),
        (4, "第十三章 雾季的渡船记录 ........ 340", 580.0, 9.0), (5, "第十三章只是附带提到的一句话。", 300.0, 9.0),
        (6, "第一章", 600.0, 15.0), (6, "北岸灯塔的来历", 580.0, 15.0), (12, "第二章 换班与巡视", 600.0, 9.0),
        (31, "第十三章雾季的渡船记录", 600.0, 15.0),
    ]
    more = [(88, "第五章", 600.0, 15.0), (88, "从“油灯”到“电灯”", 580.0, 15.0), (88, "学徒的一年", 561.0, 15.0), (88, "第四章讲过油的价格。", 410.0, 9.0)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)] + [(2, i, *x) for i, x in enumerate(more)] + [(3, 0, 1, None, None, None)], L)
    assert rows(layout.detect_chapters(df), "doc_id", "number", "title", "page") == [
        (1, 1, "第一章 北岸灯塔的来历", 6), (1, 2, "第二章 换班与巡视", 12), (1, 13, "第十三章 雾季的渡船记录", 31), (2, 5, "第五章 从“油灯”到“电灯” 学徒的一年", 88),
    ]


def test_lines_from_items(spark):
    items = [(1, "b", 50.0, 100.0, 5.0, 9.0), (1, "a", 10.0, 101.0, 5.0, 9.0), (1, "c", 10.0, 80.0, 5.0, 9.0), (1, "d", None, 80.0, 5.0, 9.0), (2, None, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(items, "page int, text string, x double, y double, width double, height double")
    assert rows(layout.lines_from_items(df, ["page"]), "page", "line_no", "text", "x2") == [(1, 0, "a b", 55.0), (1, 1, "c", 15.0), (2, 0, "", 1.0)]

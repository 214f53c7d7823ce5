"""Claims against evidence, samples and alignment, against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import alignment, cache, ranking, rules, support

GRADES = T.GRADES


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def norm(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if not (c.isspace() or unicodedata.category(c)[0] in "PS"))


def numbers(s):
    return re.findall(r"[0-9]+(?:\.[0-9]+)?%?", unicodedata.normalize("NFKC", s))


def features(s):
    n = norm(s)
    return {n[i : i + 2] for i in range(len(n) - 1)} | set(re.findall(r"[a-z]{3,}|[0-9]+(?:\.[0-9]+)?%?", unicodedata.normalize("NFKC", s).lower()))


def cover(a, b):
    return len(features(a) & features(b)) / len(features(a)) if features(a) else 0.0


def grade(s, e):
    if not e.strip() or set(numbers(s)) - set(numbers(e)) or bool(re.search(T.NEGATION, s)) != bool(re.search(T.NEGATION, e)):
        return "unsupported"
    c = cover(s, e)
    return "strong" if c >= 0.28 else "partial" if c >= 0.16 else "weak" if c >= 0.07 else "unsupported"


def relation(s):
    for pattern, a, b in ((f"^(.{{2,120}}?)(?:{T.CAUSES})(.{{2,120}})$", 1, 2), (f"^(.{{2,120}}?)(?:{T.CAUSED_BY})(.{{2,120}})$", 2, 1), (f"(?:{T.BECAUSE})(.{{2,120}}?)(?:{T.THEREFORE})(.{{2,120}})$", 1, 2)):
        m = re.search(pattern, s)
        if m:
            return m.group(a), m.group(b)
    return None


def calibrate(claims, evidence):
    """claims: id -> (statement, declared, scopes, limits); evidence: (claim, id, n, excerpt, summary)."""
    issues, out = set(), {}
    for k, (s, declared, scopes, limits) in claims.items():
        mine = sorted((n, e, x, y) for c, e, n, x, y in evidence if c == k)
        if not mine:
            issues.add(("CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE", k, None))
        used = []
        for _, e, x, y in mine:
            if grade(s, x) == "unsupported":
                issues |= {("SEVERE_EXCERPT_MISMATCH", k, e), ("EVIDENCE_CLAIM_MISMATCH", k, e)}
            else:
                used.append(x)
            if y is not None and grade(y, x) != "strong":
                issues.add(("EVIDENCE_SUMMARY_EXCERPT_MISMATCH", k, e))
        whole = "\n".join(used)
        measured = grade(s, whole) if used else "unsupported"
        final = min(declared or measured, measured, key=GRADES.index)
        out[k] = final
        narrowed = re.search(T.HEDGES, s) or any(len(norm(x)) >= 8 and not re.search(T.GENERIC_SCOPE, x.strip()) for x in scopes)
        if final == "unsupported":
            issues.add(("UNSUPPORTED_CLAIM", k, None))
        elif final == "weak":
            issues.add(("WEAK_CLAIM_REQUIRES_REVISION", k, None))
        elif final == "partial" and not narrowed:
            issues.add(("PARTIAL_SUPPORT_SCOPE_OVERCLAIM", k, None))
        if re.search(T.CAUSAL, s):
            own = relation(s)
            if not own or not any((r := relation(x)) and cover(own[0], r[0]) >= 0.16 and cover(own[1], r[1]) >= 0.16 for x in used):
                issues.add(("CAUSAL_OVERCLAIM", k, None))
        if any((re.search(T.UNIVERSAL, x) and not re.search(T.UNIVERSAL, whole)) or (len(norm(x)) >= 8 and cover(x, whole) < 0.07) for x in scopes) or any(re.search(T.UNIVERSAL, x) or not re.search(T.BOUNDARY, x) for x in limits):
            issues.add(("SCOPE_OVERCLAIM", k, None))
        t = s.strip()
        if len(t) < 8 or re.search(T.FRAGMENT_START, t) or t[-1] in "，,、；;：:":
            issues.add(("FRAGMENTARY_CLAIM", k, None))
    return issues, out


def enforce(claims, evidence, chapter, passes=3):
    open_ = set(chapter.values())
    for _ in range(passes):
        mine = {k: v for k, v in claims.items() if chapter[k] in open_}
        issues, grades = calibrate(mine, evidence)
        gone = {k for code, k, _ in issues if code in support.FATAL}
        apart = {(k, e) for code, k, e in issues if code in ("SEVERE_EXCERPT_MISMATCH", "EVIDENCE_SUMMARY_EXCERPT_MISMATCH")}
        evidence = [x for x in evidence if x[0] not in gone and (x[0], x[1]) not in apart]
        kept = {k: (v[0], grades[k], *v[2:]) for k, v in mine.items() if k not in gone}
        after, grades = calibrate(kept, evidence)
        claims = {k: v for k, v in claims.items() if chapter[k] not in open_} | {k: (v[0], grades[k], *v[2:]) for k, v in kept.items()}
        open_ = {chapter[k] for code, k, _ in after if code in ("UNSUPPORTED_CLAIM", "CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE")}
        if not open_:
            break
    return {k: v[1] for k, v in claims.items()}, {(c, e) for c, e, *_ in evidence}


WORDS = ["灯塔", "学徒", "渡船", "大雾", "潮位", "值班", "换班", "巡视", "记录", "风向", "停航", "导致", "不", "所有", "仅", "3%", "12", "Tower", "night", "因为", "所以", "，"]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice(WORDS) for _ in range(n))
    claims, evidence, chapter = {}, [], {}
    for i in range(70):
        k = f"c{i}"
        s = some(rng.randrange(2, 9))
        claims[k] = (s, rng.choice([None, *GRADES]), [some(rng.randrange(1, 6)) for _ in range(rng.randrange(3))], [some(2) + rng.choice(["之外", ""]) for _ in range(rng.randrange(2))])
        chapter[k] = f"h{i % 6}"
        for j in range(rng.randrange(4)):
            excerpt = rng.choice([some(12), s + some(4), some(3) + s, ""])
            evidence.append((k, f"e{i}-{j}", rng.randrange(100), excerpt, rng.choice([None, excerpt[:12] or None, some(5)])))
    return claims, evidence, chapter


def frames(spark, claims, evidence, chapter):
    c = spark.createDataFrame([(k, *v, chapter[k], "x") for k, v in claims.items()], "claim_id string, statement string, evidence_support string, applies_to array<string>, does_not_apply_to array<string>, chapter_id string, n string")
    return c, spark.createDataFrame(evidence, "claim_id string, evidence_id string, n int, excerpt string, summary string")


def test_calibrate(spark, sample):
    c, e = frames(spark, *sample)
    issues, graded = support.calibrate(c, e)
    want, grades = calibrate(*sample[:2])
    got = [tuple(r) for r in issues.select("code", "claim_id", "evidence_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({x[0] for x in want}) == 10
    assert dict(rows(graded, "claim_id", "evidence_support")) == grades
    none, _ = support.calibrate(c.limit(0), e.limit(0))
    assert none.count() == 0
    odd = spark.createDataFrame([("z", None, None, None, None, "h", "x")], c.schema)
    assert {r["code"] for r in support.calibrate(odd, e)[0].collect()} == {"CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE", "UNSUPPORTED_CLAIM"}


def test_enforce(spark, sample):
    c, e = frames(spark, *sample)
    claims, evidence = support.enforce(c, e, "chapter_id")
    kept, pairs = enforce(*sample)
    assert dict(rows(claims, "claim_id", "evidence_support")) == kept and 0 < len(kept) < 70
    assert {tuple(r) for r in evidence.select("claim_id", "evidence_id").collect()} == pairs


def spaced(items, k):
    n = len(items)
    return items if n <= k else items[:1] if k <= 1 else [items[int(i * (n - 1) / (k - 1) + 0.5)] for i in range(k)]


def test_budgeted_sample_and_fill(spark):
    rng = random.Random(9)
    data = [(g, i, rng.choice([None, rng.randrange(200)]) if i % 9 == 0 else rng.randrange(200), i % 7 == 0) for g in "abcde" for i in range({"a": 3, "b": 40, "c": 90, "d": 14, "e": 1}[g])]
    df = spark.createDataFrame(data, "g string, i int, n int, head boolean")
    got = rows(ranking.budgeted_sample(df, ["g"], ["i"], "n", 1000, F.col("head"), at_once=3), "g", "i")
    want = []
    for g in "abcde":
        mine = [x for x in data if x[0] == g]
        size = lambda xs: sum(x[2] or 0 for x in xs)
        if size(mine) > 1000:
            heads, body = [x for x in mine if x[3]], [x for x in mine if not x[3]]
            room = max(1, 1000 - size(heads))
            k = min(len(body), max(2, int(len(body) * room / max(1, size(body)))))
            while k > 2 and size(spaced(body, k)) > room:
                k -= 1
            mine = heads + spaced(body, k)
        want += [x[:2] for x in mine]
    assert got == sorted(want, key=repr)
    filled = rows(ranking.fill_up(df, ["g"], ["i"], F.col("head"), 5), "g", "i")
    want = []
    for g in "abcde":
        heads, body = ([x[:2] for x in data if x[0] == g and x[3] == h] for h in (True, False))
        want += heads + (spaced(body, 5 - len(heads)) if len(heads) < 5 else [])
    assert filled == sorted(want, key=repr)


def test_alignment(spark):
    parts = [("j", 0, "ab cd"), ("j", 1, "efg"), ("k", 0, "abc"), ("k", 1, "x"), ("m", 0, None)]
    words = [("j", 0, "ab", 100, 50), ("j", 1, "cd", 160, 40), ("j", 2, "e fg", 220, 80), ("k", 0, "zzzz", 0, 400), ("k", 1, "y", 450, 50)]
    p = spark.createDataFrame(parts, "g string, ord int, text string")
    b = spark.createDataFrame(words, "g string, ord int, text string, offset_ms bigint, duration_ms bigint")
    assert rows(alignment.assign(p, b, ["g"]), "g", "ord", "start_ms", "end_ms", "source") == [("j", 0, 100, 200, "text"), ("j", 1, 220, 300, "text"), ("k", 0, 0, 375, "anchored"), ("k", 1, 375, 500, "anchored")]
    assert rows(alignment.by_weight(p, b, ["g"]), "g", "ord", "start_ms", "end_ms") == [("j", 0, 100, 214), ("j", 1, 214, 300), ("k", 0, 0, 375), ("k", 1, 375, 500)]
    t = spark.createDataFrame([("j", 300, "abcdefg"), ("k", 100, "zzzzy"), ("n", 9, "a")], "g string, length int, said string")
    assert rows(alignment.reliable(b, t, ["g"], "length", "said"), "g", "reliable") == [("j", True), ("k", False), ("n", False)]
    assert alignment.assign(p.limit(0), b, ["g"]).count() == 0 and alignment.take_in_turn(["a", "b"], [("a", 0, 1)]) is None


def test_create_or_reuse(spark):
    work = spark.createDataFrame([(k, f"h{k}") for k in range(6)], "id int, input_hash string")
    done = spark.createDataFrame([(0, "h0", 5), (1, "old", 5), (2, "h2", -1)], "id int, input_hash string, v int")
    asked = []

    def provider(df):
        asked.append(sorted(r["id"] for r in df.collect()))
        return df.select("id", "input_hash", F.when(F.col("id") < 5, F.col("id") + len(asked) - 2).otherwise(-9).alias("v"))

    results, review = cache.create_or_reuse(work, done, "id", provider, F.col("v") >= 1)
    assert asked == [[1, 2, 3, 4, 5], [1, 5]] and rows(results, "id", "v") == [(0, 5), (1, 1), (2, 1), (3, 2), (4, 3)] and rows(review, "id") == [(5,)]
    double = cache.pipeline(lambda d: d.withColumn("w", F.col("v") * 2), lambda d: d.where("w > 4"))
    assert rows(double(results), "id", "w") == [(0, 10), (4, 6)]


def test_described(spark):
    v = rules.violations(spark.createDataFrame([("a",), ("b",)], "k string"), "X", "t", "k")
    d = rules.described(v.unionByName(rules.violations(v, "Y", "t", "item")), [rules.Rule("X", "BLOCK", True, "again")])
    assert rows(d, "code", "item", "severity", "blocking", "retry_strategy") == [("X", "a", "BLOCK", True, "again"), ("X", "b", "BLOCK", True, "again"), ("Y", "a", None, None, None), ("Y", "b", None, None, None)]

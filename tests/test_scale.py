"""What large tables need: nothing that grows is sent to the driver or held at once."""

import random

import pytest

from quirefold import plans
from quirefold.operators import similarity, support
from quirefold.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["angle_support"])
def test_texts_are_not_broadcast(spark, name):
    """By the size of its files a table looks small enough, by its features it isn't."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.fixture
def crowded(spark, monkeypatch):
    """Statements of a hot group that is cut into tiles, of small groups, and of none."""
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "_CELLS", 24)
    monkeypatch.setattr(similarity, "_GRAMS", 3)
    rng = random.Random(4)
    texts = {(g, f"{g}{i:02}"): "".join(rng.choice("abcd中𠀀") for _ in range(rng.randrange(2, 14))) for g, n in (("h", 40), ("i", 9), ("s", 4), ("t", 1)) for i in range(n)}
    df = spark.createDataFrame([(*k, t) for k, t in texts.items()] + [(None, "n", "abab"), (None, "m", "abab")], "g string, id string, t string")
    return similarity.with_features(df, "t").where("size(grams) > 0")


def _sets(df):
    return {(r["g"], r["id"]): set(r["grams"]) for r in df.collect() if r["g"]}


def test_near_pairs_in_tiles(crowded):
    sets = _sets(crowded)
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    want = {(a[0], a[1], b[1], round(dice(x, y), 9)) for a, x in sets.items() for b, y in sets.items() if a[0] == b[0] and a < b and dice(x, y) >= 0.5}
    got = [(r["g"], r["key_a"], r["key_b"], round(r["dice"], 9)) for r in similarity.near_pairs(crowded, ["g"], "id", 0.5).collect()]
    assert len(got) == len(want) > 9 and set(got) == want


def test_greedy_novelty_merges_by_key(spark):
    n = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, o string")
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "key_a string, key_b string")
    kept = similarity.greedy_novelty(n, p, "k", "o")
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in kept.collect()) == ["a", "c"]


@pytest.mark.parametrize("name", ["dice_near_duplicates", "repeated_statements", "best_evidence_block"])
def test_only_lists_of_hot_groups_are_broadcast(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1


def test_earlier_alike_in_tiles(crowded):
    sets = _sets(crowded)
    hits = lambda a, x: sorted(b[1] for b, y in sets.items() if a[0] == b[0] and b < a and 2 * len(x & y) >= min(len(x), len(y)) and x & y)
    want = {(*a, found[0], len(found)) for a, x in sets.items() if (found := hits(a, x))}
    got = similarity.earlier_alike(crowded, ["g"], "id", lambda k, n, m: 2 * k >= (n + m - abs(n - m)) / 2).collect()
    assert {(r["g"], r["id"], r["first"], r["n"]) for r in got} == want and len(got) == len(want) > 9


def test_best_match_in_tiles(crowded):
    left = crowded.selectExpr("g", "concat('l', id) l", "grams")
    right = crowded.where("id not in ('h01', 'h02')").selectExpr("g", "concat('r', id) r", "grams")
    sets = _sets(crowded)
    want = set()
    for a, x in sets.items():
        score, least = min((-len(x & y) / len(x), "r" + b[1]) for b, y in sets.items() if a[0] == b[0] and b[1] not in ("h01", "h02"))
        if score:
            want.add((a[0], "l" + a[1], least, -score))
    got = similarity.best_match(left, right.union(right), ["g"], "l", "r").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_calibration_writes_no_texts_of_evidence(spark, monkeypatch):
    written = []
    monkeypatch.setattr(support, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    c = spark.createDataFrame([("c", "灯塔值班记录", None, ["大雾停航以后的渡船"], None)], "claim_id string, statement string, evidence_support string, applies_to array<string>, does_not_apply_to array<string>")
    e = spark.createDataFrame([("c", f"e{i}", i, t, None) for i, t in enumerate(("灯塔", "值班记录渡", "船"))], "claim_id string, evidence_id string, n int, excerpt string, summary string")
    issues, graded = support.calibrate(c, e)
    assert not {"excerpt", "norm", "ef"} & {x for cols in written for x in cols} and any("evidence_id" in cols for cols in written)
    assert [r["evidence_support"] for r in graded.collect()] == ["strong"]
    assert {(r["code"], r["evidence_id"]) for r in issues.collect() if r["evidence_id"]} == {("EVIDENCE_CLAIM_MISMATCH", "e2"), ("SEVERE_EXCERPT_MISMATCH", "e2")}


@pytest.fixture
def cited():
    """Claims of a chapter with scopes, and blocks that support them or don't."""
    c = [(f"c{i}", "k", "灯塔值班记录", None, ["大雾停航以后的渡船"], None) for i in range(4)]
    e = [(f"c{i}", f"e{j}", j, t, None) for i in range(3) for j, t in enumerate(("灯塔", "值班记录渡", "船")[: i + 1])]
    return c, e


@pytest.fixture
def tables(spark, cited):
    return spark.createDataFrame(cited[0], "claim_id string, chapter_id string, statement string, evidence_support string, applies_to array<string>, does_not_apply_to array<string>"), spark.createDataFrame(cited[1], "claim_id string, evidence_id string, n int, excerpt string, summary string")


@pytest.fixture
def broadcasts(spark, monkeypatch):
    """Whether a table, or what was written for it by then, is broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    seen = lambda df: "Broadcast" in df._jdf.queryExecution().executedPlan().toString()
    written = []
    monkeypatch.setattr(support, "cut_lineage", lambda df: written.append(seen(df)) or cut_lineage(df))
    return lambda df: seen(df) or any(written)


def test_issues_of_claims_are_not_broadcast(tables, broadcasts):
    issues = support.calibrate(*tables)[0]
    assert not broadcasts(issues)
    assert {(r["code"], r["claim_id"]) for r in issues.collect()} > {("CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE", "c3"), ("SEVERE_EXCERPT_MISMATCH", "c2")}


def test_corrected_claims_are_not_broadcast(tables, broadcasts):
    graded = support.calibrate(*tables)[1]
    assert not broadcasts(graded)
    assert {r["claim_id"]: r["evidence_support"] for r in graded.collect()} == {"c0": "partial", "c1": "strong", "c2": "strong", "c3": "unsupported"}


def test_enforcement_is_not_broadcast_and_measures_once(tables, broadcasts, monkeypatch):
    asked = []
    grade = support.lexical_grade
    monkeypatch.setattr(support, "lexical_grade", lambda *a: asked.append(a) or grade(*a))
    claims, evidence = support.enforce(*tables, "chapter_id")
    assert not broadcasts(claims) and not broadcasts(evidence) and len(asked) == 2
    assert [(r["claim_id"], r["evidence_support"]) for r in claims.collect()] == []
    assert evidence.count() == 0


def test_enforcement_query_is_not_broadcast(spark, broadcasts):
    assert not broadcasts(plans.queries()["claim_enforcement_fixpoint"](spark, SF))

"""Interval labels against a recursive reading."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.operators.nested import label, label_nodes, link_to_parent, node_table, plain_name
from quirefold.plans.data_care import p2_found

KEYS = ("claims", "scope", "appliesTo", "page", "x")
VALUES = st.recursive(st.none() | st.integers(-5, 5) | st.text(max_size=3) | st.booleans(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(KEYS), c, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(KEYS), VALUES, max_size=4))
def test_intervals_nest_or_part(doc):
    nodes = label(json.dumps(doc))
    spans = [(n["pre"], n["post"]) for n in nodes]
    assert len({x for s in spans for x in s}) == 2 * len(nodes)
    for a in nodes:
        for b in nodes:
            inside = a["pre"] < b["pre"] and b["post"] < a["post"]
            apart = a["post"] < b["pre"] or b["post"] < a["pre"] or a is b
            assert inside or apart or (b["pre"] < a["pre"] and a["post"] < b["post"])
            if inside:
                assert b["level"] > a["level"]


def test_encodings_and_broken_texts():
    plain = {"claims": [{"scope": {"appliesTo": ["a", None, "b"]}}]}
    want = label(json.dumps(plain))
    assert label(json.dumps(json.dumps(plain))) == want
    assert label("﻿" + json.dumps(plain)) == want
    assert label(json.dumps({"claims": json.dumps(plain["claims"])})) == want
    for broken in (None, "", "  ", "{", '{"a": ', "nonsense", '"text"', "12", "null", "[" * 100_000):
        assert label(broken) == []
    deep = '{"x":' * 400 + "1" + "}" * 400
    assert len(label(deep)) == 401
    assert plain_name("book_evidence-Refs") == "bookevidencerefs"


def test_tables_and_links(spark):
    doc = {"claims": [{"scope": {"appliesTo": ["a", "b"]}}, None, {"scope": {"appliesTo": "c"}, "page": 4}]}
    rows = [(1, json.dumps(doc), "extra"), (2, None, None), (3, "{", "x"), (None, json.dumps(doc), "y")]
    df = spark.createDataFrame(rows, "id int, payload string, name string")  # `name` clashes with a result column
    nodes = label_nodes(df, "payload", ["id"])
    linked = link_to_parent(nodes, ["id"], "claims", ["appliesTo"]).where("id = 1").orderBy("pre")
    assert [(r["parent_ord"], r["ord"], r["value"]) for r in linked.collect()] == [(0, 0, "a"), (0, 1, "b"), (2, 0, "c")]
    claims = node_table(nodes, ["id"], "claims", fields=["page"]).where("id = 1").orderBy("pre").collect()
    assert [r["page"] for r in claims] == [None, None, "4"]
    empty = spark.createDataFrame([], "id int, payload string")
    assert label_nodes(empty, "payload", ["id"]).count() == 0


def _read(payload):
    """The rows of p2 by plain recursion."""
    try:
        doc = json.loads(payload.lstrip("﻿")) if payload else None
    except ValueError:
        return set()

    def opened(v):
        while isinstance(v, str) and v.strip()[:1] in "{[" and v.strip():
            try:
                v = json.loads(v)
            except ValueError:
                return v
        return v

    def find(v, name):
        v = opened(v)
        if isinstance(v, list):
            v = opened(v[0]) if len(v) == 1 else None
        if not isinstance(v, dict):
            return None
        for k, x in v.items():
            if plain_name(k) == name:
                return opened(x)
        for x in v.values():
            if isinstance(opened(x), dict) and (y := find(x, name)) is not None:
                return y
        return None

    def many(v):
        v = opened(v)
        return list(enumerate(v)) if isinstance(v, list) else [(0, v)]

    def own(d, name):
        return next((x for k, x in d.items() if plain_name(k) == name), None)

    while isinstance(doc, str):
        try:
            doc = json.loads(doc)
        except ValueError:
            return set()
    out = set()
    for i, c in many(find(doc, "claims")):
        c = opened(c)
        if not isinstance(c, dict):
            continue
        scope = opened(own(c, "scope"))
        if isinstance(scope, dict):
            out |= {("applies_to", i, j, str(x)) for j, x in many(own(scope, "appliesto")) if x is not None and str(x).strip()}
        for j, r in many(own(c, "bookevidencerefs")):
            if isinstance(r, dict):
                page = own(r, "page")
                out.add(("evidence_ref", i, j, "" if page is None else str(int(float(page)))))
    for j, v in many(find(doc, "visualelements")):
        if isinstance(v, dict) and (own(v, "elementid") or "").strip():
            out.add(("visual_element", 0, j, own(v, "elementid")))
    return out


def test_p2_against_recursive_reading(spark):
    sf = "/root/testdata/sf0.01"
    got: dict = {}
    for r in p2_found(spark, sf).collect():
        got.setdefault((r["record_table"], r["record_id"]), set()).add((r["child_kind"], r["parent_ord"], r["child_ord"], r["child_value"]))
    want: dict = {}
    for t in ("chapter_records", "page_records"):
        for r in spark.read.parquet(f"{sf}/{t}.parquet").select(F.col("record_id"), "payload").collect():
            if rows := _read(r["payload"]):
                want.setdefault((t, r["record_id"]), set()).update(rows)
    assert got == want

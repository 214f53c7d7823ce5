"""Queries of claims against their evidence, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import support
from quirefold.operators.similarity import earlier_alike
from quirefold.plans.graph import _AC, _CL, _R, _angle_claims, _claims, _refs
from quirefold.plans.texts import _G, _H, _WORDS, _norm
from quirefold.session import table


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that claims cite: one excerpt per block, with the caption
    or heading of its page as its summary, if there is one."""
    b = table(spark, sf, "blocks").where("block_id is not null")
    text = b.groupBy("book_id", "block_id").agg(F.min("original_text").alias("excerpt"))
    pages = b.groupBy("book_id", "block_id").agg(F.min("page").alias("page"))
    heads = b.where("block_type in ('caption', 'heading')").groupBy("book_id", "page").agg(F.min("original_text").alias("summary"))
    refs = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim' and owner_id is not null").groupBy(F.col("owner_id").alias("claim_id"), "book_id", "block_id").agg(F.min("ref_id").alias("n"))
    # the texts of blocks, by far the most of it, are sent once: to the refs
    named = refs.join(pages.hint("merge"), ["book_id", "block_id"]).join(heads.hint("merge"), ["book_id", "page"], "left").drop("page")
    j = named.join(text.hint("merge"), ["book_id", "block_id"])
    return j.select("claim_id", F.concat_ws("/", "book_id", "block_id").alias("evidence_id"), "n", F.coalesce("excerpt", F.lit("")).alias("excerpt"), "summary")


def claim_calibration(spark, sf):
    """All issues of all claims against what they cite, by ten codes."""
    return support.calibrate(_claims(spark, sf), _evidence(spark, sf))[0]


def claim_support_corrected(spark, sf):
    """The support of every claim as declared, and as the evidence allows."""
    graded = support.calibrate(_claims(spark, sf), _evidence(spark, sf))[1]
    return graded.select("claim_id", F.col("evidence_support").alias("support"))


def claim_enforcement_fixpoint(spark, sf):
    """Claims and evidence that are left when all objections are enforced."""
    claims, evidence = support.enforce(_claims(spark, sf).where("chapter_id is not null"), _evidence(spark, sf), "chapter_id")
    return claims.join(evidence.hint("merge"), "claim_id", "left").groupBy("claim_id", "chapter_id", F.col("evidence_support").alias("support")).agg(F.count("evidence_id").alias("pairs"))


def match_scores(spark, sf):
    """Claims against each block that they cite: -1 if a number is missing
    there, else the share of pairs of characters found there."""
    c = _claims(spark, sf).where("statement is not null").select("claim_id", "statement", T.bigrams(T.normalize("statement")).alias("a"))
    e = _evidence(spark, sf).select("claim_id", "evidence_id", "excerpt").distinct()
    texts = e.select("evidence_id", "excerpt").distinct().withColumn("b", T.bigrams(T.normalize("excerpt")))
    j = e.select("claim_id", "evidence_id").join(texts, "evidence_id").join(c, "claim_id")
    return j.select("claim_id", "evidence_id", F.when(T.numbers_missing("statement", "excerpt"), -1.0).otherwise(F.round(T.coverage("a", "b"), 6)).alias("score"))


def most_relevant_evidence(spark, sf):
    """Of the blocks that a claim cites the one with the best score; the
    first cited wins a tie."""
    scores = match_scores(spark, sf).join(_evidence(spark, sf).select("claim_id", "evidence_id", "n"), ["claim_id", "evidence_id"])
    return scores.groupBy("claim_id").agg(F.min_by(F.struct("evidence_id", "score"), F.struct(-F.col("score"), F.col("n"))).alias("b")).select("claim_id", "b.*")


def _angle_support(spark: SparkSession, sf: str, least: float, least_each: float) -> DataFrame:
    a = table(spark, sf, "angles").where("thesis is not null").groupBy("angle_id").agg(F.min("thesis").alias("thesis"))
    a = a.select("angle_id", "thesis", T.bigrams(T.normalize("thesis")).alias("tf"), F.array_distinct(T.numeric_tokens("thesis")).alias("numbers"))
    c = _claims(spark, sf).where("statement is not null").select("claim_id", "statement", T.bigrams(T.normalize("statement")).alias("sf"), T.numeric_tokens("statement").alias("have"))
    # merged by key: by the size of their files, texts with their pairs of characters look small enough for the driver
    j = _angle_claims(spark, sf).select("angle_id", "claim_id").join(a.hint("merge"), "angle_id").join(c.hint("merge"), "claim_id")
    per = j.select("angle_id", "thesis", F.size("tf").alias("n"), F.size("numbers").alias("n_numbers"), F.array_intersect("tf", "sf").alias("f"), F.array_intersect("numbers", "have").alias("k"), T.coverage("tf", "sf").alias("each"), F.col("statement").rlike(T.CAUSAL).alias("causal"))
    covered = per.select("angle_id", F.explode("f").alias("f")).distinct().groupBy("angle_id").agg(F.count(F.lit(1)).alias("covered"))
    found = per.select("angle_id", F.explode("k").alias("k")).distinct().groupBy("angle_id").agg(F.count(F.lit(1)).alias("found"))
    g = per.groupBy("angle_id", "thesis", "n", "n_numbers").agg(F.min("each").alias("least_each"), F.max("causal").alias("causal"))
    g = g.join(covered.hint("merge"), "angle_id", "left").join(found.hint("merge"), "angle_id", "left").withColumn("score", F.coalesce("covered", F.lit(0)) / F.greatest("n", F.lit(1)))
    ok = (F.col("score") >= least) & (F.col("least_each") >= least_each) & (F.coalesce("found", F.lit(0)) == F.col("n_numbers")) & (~F.col("thesis").rlike(T.CAUSAL) | F.col("causal"))
    return g.select("angle_id", F.round("score", 6).alias("score"), ok.alias("supported"))


def thesis_support(spark, sf):
    """Theses against the statements of their claims together: cover, numbers,
    and causal words only if a claim has some."""
    return _angle_support(spark, sf, 0.28, 0.0)


def angle_support(spark, sf):
    """As thesis_support, with a low bound overall and one for each claim."""
    return _angle_support(spark, sf, 0.12, 0.08)


def repeated_statements(spark, sf):
    """Claims that say much of what an earlier claim of their chapter says:
    by Dice value or by the share of the shorter one."""
    c = _claims(spark, sf).where("chapter_id is not null").withColumn("g", T.bigrams(T.normalize("statement"))).where(F.size("g") > 0)
    hit = lambda k, n, m: (2 * k / (n + m) >= 0.55) | (k / np.minimum(n, m) >= 0.5)
    return earlier_alike(c.withColumnRenamed("g", "grams"), ["chapter_id"], "claim_id", hit).select("claim_id", F.col("first").alias("earlier_id"), "n")


_F = "list_distinct(list_concat(" + _G.format("{n}") + ", {w}))"


def _features(c: str) -> str:
    return _F.format(n=_norm(c), w=_WORDS.format(c))


def _numbers(c: str) -> str:
    return f"regexp_extract_all({_H.format(c)}, '[0-9]+(?:\\.[0-9]+)?%?')"


def _cover(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then len(list_intersect({a}, {b})) / len({a}) else 0.0 end)"


def _blank(c: str) -> str:
    return f"regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g') = ''"


def _grade(s: str, x: str, score: str) -> str:
    missing = f"len(list_filter({_numbers(s)}, lambda q: not list_contains({_numbers(x)}, q))) > 0"
    return f"(case when {_blank(x)} or {missing} or regexp_matches({s}, '{T.NEGATION}') <> regexp_matches({x}, '{T.NEGATION}') then 'unsupported' when {score} >= 0.28 then 'strong' when {score} >= 0.16 then 'partial' when {score} >= 0.07 then 'weak' else 'unsupported' end)"


def _cause(c: str, part: int) -> str:
    d, r, b = f"^(.{{2,120}}?)(?:{T.CAUSES})(.{{2,120}})$", f"^(.{{2,120}}?)(?:{T.CAUSED_BY})(.{{2,120}})$", f"(?:{T.BECAUSE})(.{{2,120}}?)(?:{T.THEREFORE})(.{{2,120}})$"
    return f"(case when regexp_matches({c}, '{d}') then regexp_extract({c}, '{d}', {part}) when regexp_matches({c}, '{r}') then regexp_extract({c}, '{r}', {3 - part}) when regexp_matches({c}, '{b}') then regexp_extract({c}, '{b}', {part}) end)"


_EV = f"""(with t as (select book_id, block_id, coalesce(min(original_text), '') as excerpt, min(page) as page from blocks where block_id is not null group by all),
h as (select book_id, page, min(original_text) as summary from blocks where block_id is not null and block_type in ('caption', 'heading') group by all)
select owner_id as claim_id, r.book_id || '/' || r.block_id as evidence_id, n, excerpt, summary from (select owner_id, book_id, block_id, min(ref_id) as n from {_R} where ref_type = 'book' and owner_kind = 'claim' and owner_id is not null group by all) r
join t using (book_id, block_id) left join h on h.book_id = r.book_id and h.page = t.page)"""
_RANK = "(case {0} when 'strong' then 3 when 'partial' then 2 when 'weak' then 1 else 0 end)"
_CALIBRATED = f"""with c as materialized (select *, {_features("statement")} as sf, {_cause("statement", 1)} as sc, {_cause("statement", 2)} as se from {_CL}),
ev as materialized {_EV},
x as materialized (select evidence_id, any_value(excerpt) as excerpt, any_value(summary) as summary, {_features("any_value(excerpt)")} as ef, {_cause("any_value(excerpt)", 1)} as ec, {_cause("any_value(excerpt)", 2)} as ee from ev group by 1),
x2 as materialized (select *, {_grade("summary", "excerpt", _cover(_features("summary"), "ef"))} as sg from x),
p as materialized (select ev.claim_id, evidence_id, n, x2.excerpt, x2.summary, sg, {_grade("c.statement", "x2.excerpt", _cover("sf", "ef"))} as g,
 coalesce({_cover(_features("sc"), _features("ec"))} >= 0.16 and {_cover(_features("se"), _features("ee"))} >= 0.16 and sc is not null and ec is not null, false) as causes from ev join x2 using (evidence_id) join c using (claim_id)),
a as (select claim_id, count(*) as pairs, bool_or(g <> 'unsupported') as used, bool_or(g <> 'unsupported' and causes) as causes, coalesce(string_agg(excerpt, chr(10) order by n, evidence_id) filter (g <> 'unsupported'), '') as grounding from p group by 1),
m as materialized (select c.*, pairs, coalesce(used, false) as used, coalesce(causes, false) as causes, coalesce(grounding, '') as grounding, {_features("coalesce(grounding, '')")} as gf from c left join a using (claim_id)),
k as materialized (select *, case when used then (case when {_cover("sf", "gf")} >= 0.28 then 'strong' when {_cover("sf", "gf")} >= 0.16 then 'partial' when {_cover("sf", "gf")} >= 0.07 then 'weak' else 'unsupported' end) else 'unsupported' end as measured from m),
f as materialized (select *, case when {_RANK.format("coalesce(evidence_support, measured)")} <= {_RANK.format("measured")} then (case when {_RANK.format("coalesce(evidence_support, measured)")} = 0 then 'unsupported' else coalesce(evidence_support, measured) end) else measured end as support,
 list_filter(coalesce(applies_to, []), lambda s: s is not null) as scopes, list_filter(coalesce(does_not_apply_to, []), lambda s: s is not null) as limits from k),
sc as materialized (select claim_id, bool_or(long and not regexp_matches(trim(s), '{T.GENERIC_SCOPE}')) as specific, bool_or((regexp_matches(s, '{T.UNIVERSAL}') and not regexp_matches(grounding, '{T.UNIVERSAL}')) or (long and score < 0.07)) as bad
 from (select *, length({_norm("s")}) >= 8 as long, {_cover(_features("s"), "gf")} as score from (select claim_id, grounding, gf, unnest(scopes) as s from f)) group by 1)
"""

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "claim_calibration": _CALIBRATED
    + f""", j as (select f.*, coalesce(specific, false) as specific, coalesce(bad, false) as bad from f left join sc using (claim_id))
select 'CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE' as code, claim_id, null::varchar as evidence_id from j where pairs is null
union all select case support when 'unsupported' then 'UNSUPPORTED_CLAIM' else 'WEAK_CLAIM_REQUIRES_REVISION' end, claim_id, null from j where support in ('unsupported', 'weak')
union all select 'PARTIAL_SUPPORT_SCOPE_OVERCLAIM', claim_id, null from j where support = 'partial' and not coalesce(regexp_matches(statement, '{T.HEDGES}'), false) and not specific
union all select 'CAUSAL_OVERCLAIM', claim_id, null from j where regexp_matches(statement, '{T.CAUSAL}') and not causes
union all select 'SCOPE_OVERCLAIM', claim_id, null from j where bad or len(list_filter(limits, lambda s: regexp_matches(s, '{T.UNIVERSAL}') or not regexp_matches(s, '{T.BOUNDARY}'))) > 0
union all select 'FRAGMENTARY_CLAIM', claim_id, null from j where length(trim(statement)) < 8 or regexp_matches(trim(statement), '{T.FRAGMENT_START.replace("[，,\\s]", "[，,\\s\\p{Z}]")}') or regexp_matches(trim(statement), '[，,、；;：:]$')
union all select unnest(['SEVERE_EXCERPT_MISMATCH', 'EVIDENCE_CLAIM_MISMATCH']), claim_id, evidence_id from p where g = 'unsupported'
union all select 'EVIDENCE_SUMMARY_EXCERPT_MISMATCH', claim_id, evidence_id from p where summary is not null and sg <> 'strong'""",
    "claim_support_corrected": _CALIBRATED + "select claim_id, support from f",
    "match_scores": f"""select claim_id, evidence_id, case when len(list_filter({_numbers("statement")}, lambda q: not list_contains({_numbers("excerpt")}, q))) > 0 then -1.0 else round({_cover(_G.format(_norm("statement")), _G.format(_norm("excerpt")))}, 6) end as score
from {_EV} join (select claim_id, statement from {_CL} where statement is not null) using (claim_id)""",
    "repeated_statements": f"""with c as (select chapter_id, claim_id, {_G.format(_norm("statement"))} as g from {_CL} where chapter_id is not null),
x as (select a.claim_id, b.claim_id as earlier_id, len(list_intersect(a.g, b.g)) as k, len(a.g) as n, len(b.g) as m from c a join c b on a.chapter_id = b.chapter_id and b.claim_id < a.claim_id where len(a.g) > 0 and len(b.g) > 0)
select claim_id, min(earlier_id) as earlier_id, count(*) as n from x where 2 * k / (n + m) >= 0.55 or k / least(n, m) >= 0.5 group by 1""",
}
SQL["most_relevant_evidence"] = f"with s as ({SQL['match_scores']}) select claim_id, arg_min(evidence_id, (-score, n)) as evidence_id, max(score) as score from s join (select claim_id, evidence_id, n from {_EV}) using (claim_id, evidence_id) group by 1"
for _name, _least, _each in (("thesis_support", 0.28, 0.0), ("angle_support", 0.12, 0.08)):
    SQL[_name] = f"""with a as (select angle_id, min(thesis) as thesis from angles where thesis is not null group by 1), x as (select angle_id, thesis, {_G.format(_norm("thesis"))} as tf, {_numbers("thesis")} as k from a),
s as (select claim_id, statement, {_G.format(_norm("statement"))} as sf, {_numbers("statement")} as have from {_CL} where statement is not null),
g as (select angle_id, any_value(thesis) as thesis, any_value(tf) as tf, any_value(k) as k, list_distinct(flatten(list(sf))) as every, list_distinct(flatten(list(have))) as have, min({_cover("tf", "sf")}) as least_each, bool_or(regexp_matches(statement, '{T.CAUSAL}')) as causal
 from x join (select angle_id, claim_id from {_AC}) using (angle_id) join s using (claim_id) group by 1)
select angle_id, round({_cover("tf", "every")}, 6) as score, {_cover("tf", "every")} >= {_least} and least_each >= {_each} and len(list_filter(k, lambda q: not list_contains(have, q))) = 0 and (not regexp_matches(thesis, '{T.CAUSAL}') or causal) as supported from g"""

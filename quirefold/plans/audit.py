"""Queries of audits: what is said against what is there, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import rules
from quirefold.plans.graph import _AC, _CL, _R, _angle_claims, _claims, _refs
from quirefold.plans.reading import _LET, _SC, _scenes
from quirefold.plans.texts import _norm
from quirefold.session import table


def recognised_lines(spark, sf):
    """Recognised text that is not blank and sure enough, from top to bottom
    and left to right, with its place on the page."""
    b = table(spark, sf, "blocks").where("pdf_kind = 'scanned' and bbox is not null and page is not null and confidence >= 0.5")
    b = b.where(T.collapse("original_text") != "").groupBy("book_id", "page", "block_id").agg(F.min(F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "confidence")).alias("q"))
    w = Window.partitionBy("book_id", "page").orderBy(F.desc("q.y"), "q.x", "block_id")
    return b.select("book_id", "page", "block_id", F.row_number().over(w).alias("nth"), F.col("q.confidence").alias("confidence"))


def extractive_audit(spark, sf):
    """Claims against the blocks that they cite, by all reasons why a claim is
    no extract: no such block, not said there, number or scope not there."""
    c = _claims(spark, sf).where("statement is not null").select("claim_id", "chapter_id", "statement", T.normalize("statement").alias("n"))
    refs = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim' and block_id is not null").select(F.col("owner_id").alias("claim_id"), "book_id", "block_id").distinct()
    b = table(spark, sf, "blocks").where("block_id is not null").groupBy("book_id", "block_id").agg(F.min("original_text").alias("t"), F.min("chapter_id").alias("at"))
    b = b.select("book_id", "block_id", "t", "at", T.normalize("t").alias("m"))
    j = c.join(refs, "claim_id").join(b, ["book_id", "block_id"], "left")
    pair = j.select("claim_id", F.col("m").isNotNull().alias("there"), F.contains("m", "n").alias("said"), F.coalesce(~T.numbers_missing("statement", "t"), F.lit(True)).alias("numbers"), (F.col("at") == F.col("chapter_id")).alias("same"))
    g = pair.groupBy("claim_id").agg(*[F.max(F.coalesce(k, F.lit(False))).alias(k) for k in ("there", "said", "numbers", "same")])
    reasons = F.array(*[F.when(~F.col(k), code) for k, code in (("there", "NO_BLOCK"), ("said", "NOT_SAID"), ("numbers", "NUMBERS"), ("same", "OTHER_CHAPTER"))])
    return g.select("claim_id", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("reasons"))


def recommended_angle(spark, sf):
    """Per book whether its first eligible angle is its best one; books without
    or with several are told."""
    a = table(spark, sf, "angles").groupBy("book_id", "angle_id").agg(F.min("ord").alias("ord"), F.max("overall_score").alias("score"), F.max("eligible").alias("eligible"))
    e = a.groupBy("book_id").agg(
        F.count_if("eligible").alias("eligible"),
        F.min_by("angle_id", F.when(F.col("eligible"), F.struct("ord", "angle_id"))).alias("first"),
        F.max_by("angle_id", F.when(F.col("eligible"), F.struct("score", -F.col("ord"), "angle_id"))).alias("best"),
    )
    state = F.when(F.col("eligible") == 0, "NONE").when(F.col("first") != F.col("best"), "NOT_THE_BEST").when(F.col("eligible") > 1, "SEVERAL").otherwise("ONE")
    return e.select("book_id", "eligible", "first", "best", state.alias("state"))


def draft_expansion(spark, sf):
    """Relations with the ends as stable ids: claims numbered in their chapter.
    Ends that are no claims keep their id."""
    w = Window.partitionBy("book_id", "chapter_id").orderBy("ord", "claim_id")
    ids = _claims(spark, sf).where("chapter_id is not null").select("claim_id", F.concat("chapter_id", F.lit("-claim-"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("stable"))
    rel = table(spark, sf, "claim_relations").select("relation_id", "from_claim_id", "to_claim_id", "relation").distinct()
    for end in ("from", "to"):
        rel = rel.join(ids.select(F.col("claim_id").alias(f"{end}_claim_id"), F.col("stable").alias(f"{end}_stable")), f"{end}_claim_id", "left")
    return rel.select("relation_id", "relation", *[F.coalesce(f"{e}_stable", f"{e}_claim_id").alias(f"{e}_id") for e in ("from", "to")])


def chapter_coverage_rules(spark, sf):
    """Claims and chapters: claims of unknown chapters, statements that a
    chapter has twice, chapters without any claim."""
    c = _claims(spark, sf).where("chapter_id is not null").select("book_id", "chapter_id", "claim_id", "statement")
    ch = table(spark, sf, "chapters").select("book_id", "chapter_id").distinct()
    on = ["book_id", "chapter_id"]
    first = F.row_number().over(Window.partitionBy(*on, "statement").orderBy("claim_id"))
    return rules.union_all(
        [
            rules.violations(c.join(ch, on, "left_anti"), "UNKNOWN", "claims", "claim_id", "chapter_id"),
            rules.violations(c.where("statement is not null").withColumn("nth", first).where("nth > 1"), "REPEATED", "claims", "claim_id", "nth"),
            rules.violations(ch.join(c, on, "left_anti"), "UNCOVERED", "chapters", F.concat_ws("/", *on)),
        ]
    )


def conditional_shape(spark, sf):
    """Claims whose fields don't go with their state: verified without a
    reference, judged without need, unsupported but certain, and angles that are
    eligible without evidence."""
    c, refs = _claims(spark, sf), _refs(spark, sf).where("owner_kind = 'claim'").select(F.col("owner_id").alias("claim_id")).distinct()
    angles = table(spark, sf, "angles").select("angle_id", "eligible", F.coalesce(F.size("evidence_ids"), F.lit(0)).alias("n")).distinct()
    return rules.union_all(
        [
            rules.violations(c.where("verification_status = 'verified'").join(refs, "claim_id", "left_anti"), "VERIFIED_WITHOUT_REF", "claims", "claim_id", "evidence_support"),
            rules.check(c, (F.col("verification_status") == "not_required") & F.col("evidence_support").isNull(), "NO_SUPPORT_GIVEN", "claims", "claim_id"),
            rules.check(c, (F.col("evidence_support") == "unsupported") & (F.col("importance.level") == "core"), "CORE_UNSUPPORTED", "claims", "claim_id", "importance.score"),
            rules.check(angles, F.col("eligible") & (F.col("n") <= 0), "ELIGIBLE_WITHOUT_EVIDENCE", "angles", "angle_id"),
        ]
    )


def duration_specs(spark, sf):
    """Jobs whose time is not what their scenes add up to, within 2 %, and the
    longest time that nothing changes in."""
    s = _scenes(spark, sf)
    j = s.groupBy("job_id").agg(F.max("end_ms").alias("length"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("added"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"))
    off = F.abs(F.col("length") - F.col("added")) / F.greatest(F.col("length"), F.lit(1))
    return j.select("job_id", "length", "added", "longest", (off > 0.02).alias("off"), (F.col("longest") > 10000).alias("static"))


def speech_clamped(spark, sf):
    """Ends of speech at 220 ms a letter, never beyond the scene; hooks whose
    speech takes more than three seconds are told."""
    s = _scenes(spark, sf).withColumn("n", F.coalesce(T.readable_count("voice_text"), F.lit(0)))
    end = F.least(F.col("end_ms"), F.col("start_ms") + F.col("n") * 220)
    return s.select("job_id", "scene_id", end.alias("speech_end_ms"), (F.col("start_ms") + F.col("n") * 220 > F.col("end_ms")).alias("clamped"), ((F.col("purpose") == "hook") & (end - F.col("start_ms") > 3000)).alias("late_hook"))


def claims_by_ref_overlap(spark, sf):
    """Angles and claims that are not theirs but cite a block that the angle
    cites: what an angle could take up."""
    refs = _refs(spark, sf).where("ref_type = 'book' and block_id is not null")
    a = refs.where("owner_kind = 'angle'").select(F.col("owner_id").alias("angle_id"), "book_id", "block_id").distinct()
    c = refs.where("owner_kind = 'claim'").select(F.col("owner_id").alias("claim_id"), "book_id", "block_id").distinct()
    both = a.join(c, ["book_id", "block_id"]).groupBy("angle_id", "claim_id").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(_angle_claims(spark, sf).select("angle_id", "claim_id"), ["angle_id", "claim_id"], "left_anti")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
_RB = f"(select distinct owner_id as claim_id, book_id, block_id from {_R} where ref_type = 'book' and owner_kind = 'claim' and block_id is not null)"
SQL = {
    "recognised_lines": r"""with b as (select book_id, page, block_id, min({'y': bbox.y, 'x': bbox.x, 'confidence': confidence}) as q from blocks where pdf_kind = 'scanned' and bbox is not null and page is not null and confidence >= 0.5 and regexp_replace(original_text, '[\s\p{Z}]+', '', 'g') <> '' group by all)
select book_id, page, block_id, row_number() over (partition by book_id, page order by q.y desc, q.x, block_id) as nth, q.confidence as confidence from b""",
    "extractive_audit": f"""with b as (select book_id, block_id, min(original_text) as t, min(chapter_id) as at_ from blocks where block_id is not null group by all), n as (select *, {_norm("t")} as m from b), c as (select claim_id, chapter_id, statement, {_norm("statement")} as n from {_CL} where statement is not null),
p as (select claim_id, m is not null as there, contains(m, n) as said, len(list_filter(regexp_extract_all(replace(statement, '…', '...'), '[0-9０-９]+(?:[.．][0-9０-９]+)?[%％]?'), lambda q: not list_contains(regexp_extract_all(t, '[0-9０-９]+(?:[.．][0-9０-９]+)?[%％]?'), q))) = 0 as numbers, at_ = chapter_id as same from c join {_RB} using (claim_id) left join n using (book_id, block_id)),
g as (select claim_id, bool_or(coalesce(there, false)) as there, bool_or(coalesce(said, false)) as said, bool_or(coalesce(numbers, false)) as numbers, bool_or(coalesce(same, false)) as same from p group by 1)
select claim_id, concat_ws(',', case when not there then 'NO_BLOCK' end, case when not said then 'NOT_SAID' end, case when not numbers then 'NUMBERS' end, case when not same then 'OTHER_CHAPTER' end) as reasons from g""",
    "recommended_angle": """with a as (select book_id, angle_id, min(ord) as ord, max(overall_score) as score, bool_or(eligible) as eligible from angles group by all),
e as (select book_id, count_if(eligible) as n, arg_min(angle_id, (ord, angle_id)) filter (eligible) as first, arg_max(angle_id, (score, -ord, angle_id)) filter (eligible) as best from a group by 1)
select book_id, n as eligible, first, best, case when n = 0 then 'NONE' when first <> best then 'NOT_THE_BEST' when n > 1 then 'SEVERAL' else 'ONE' end as state from e""",
    "draft_expansion": f"""with i as (select claim_id, chapter_id || '-claim-' || lpad(cast(row_number() over (partition by book_id, chapter_id order by ord, claim_id) as varchar), 3, '0') as k from {_CL} where chapter_id is not null)
select relation_id, relation, coalesce(a.k, from_claim_id) as from_id, coalesce(b.k, to_claim_id) as to_id from (select distinct relation_id, from_claim_id, to_claim_id, relation from claim_relations) r left join i a on a.claim_id = from_claim_id left join i b on b.claim_id = to_claim_id""",
    "chapter_coverage_rules": f"""with c as (select book_id, chapter_id, claim_id, statement from {_CL} where chapter_id is not null), h as (select distinct book_id, chapter_id from chapters)
select 'UNKNOWN' as code, 'claims' as artifact, claim_id as item, chapter_id as detail from c where (book_id, chapter_id) not in (select (book_id, chapter_id) from h)
union all select 'REPEATED', 'claims', claim_id, cast(n as varchar) from (select claim_id, row_number() over (partition by book_id, chapter_id, statement order by claim_id) as n from c where statement is not null) where n > 1
union all select 'UNCOVERED', 'chapters', book_id || '/' || chapter_id, '' from h where (book_id, chapter_id) not in (select (book_id, chapter_id) from c where book_id is not null)""",
    "conditional_shape": f"""with c as {_CL} select 'VERIFIED_WITHOUT_REF' as code, 'claims' as artifact, claim_id as item, coalesce(evidence_support, '') as detail from c where verification_status = 'verified' and claim_id not in (select owner_id from {_R} where owner_kind = 'claim' and owner_id is not null)
union all select 'NO_SUPPORT_GIVEN', 'claims', claim_id, '' from c where verification_status = 'not_required' and evidence_support is null
union all select 'CORE_UNSUPPORTED', 'claims', claim_id, coalesce(cast(importance.score as varchar), '') from c where evidence_support = 'unsupported' and importance.level = 'core'
union all select 'ELIGIBLE_WITHOUT_EVIDENCE', 'angles', angle_id, '' from (select distinct angle_id, eligible, coalesce(len(evidence_ids), 0) as n from angles) where eligible and n = 0""",
    "duration_specs": f"""with j as (select job_id, max(end_ms) as length, cast(sum(end_ms - start_ms) as bigint) as added, max(end_ms - start_ms) as longest from {_SC} group by 1)
select *, abs(length - added) / greatest(length, 1) > 0.02 as off, longest > 10000 as static from j""",
    "speech_clamped": f"""with s as (select *, coalesce({_LET.format("voice_text")}, 0) as n from {_SC}) select job_id, scene_id, least(end_ms, start_ms + n * 220) as speech_end_ms, start_ms + n * 220 > end_ms as clamped, purpose = 'hook' and least(end_ms, start_ms + n * 220) - start_ms > 3000 as late_hook from s""",
    "claims_by_ref_overlap": f"""select angle_id, claim_id, count(*) as shared from (select distinct owner_id as angle_id, book_id, block_id from {_R} where ref_type = 'book' and owner_kind = 'angle' and block_id is not null) join {_RB} using (book_id, block_id)
where (angle_id, claim_id) not in (select (angle_id, claim_id) from {_AC} where angle_id is not null) group by 1, 2""",
}

"""Queries of the reference graph and of declared constraints, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import ranking, rules
from quirefold.session import table

#: How grave a violation is, whether it blocks, and what to do again.
RULES = [
    rules.Rule("CLAIM_REF_BLOCK", "BLOCK", True, "cite an existing block"),
    rules.Rule("EVIDENCE_REF_BLOCK", "BLOCK", True, "cite an existing block"),
    rules.Rule("REF_CHAPTER", "BLOCK", True, "cite an existing chapter"),
    rules.Rule("REF_OWNER", "BLOCK", True, "build the owner anew"),
    rules.Rule("ANGLE_CLAIM", "BLOCK", True, "build the angle anew"),
    rules.Rule("ANGLE_EVIDENCE", "BLOCK", True, "build the angle anew"),
    rules.Rule("ANGLE_CLAIM_UNUSABLE", "BLOCK", True, "choose other claims"),
    rules.Rule("RELATION_CLAIM", "BLOCK", True, "build the relation anew"),
    rules.Rule("RELATION_SELF", "WARN", False, "drop the relation"),
    rules.Rule("CLAIM_ID_TWICE", "BLOCK", True, "number the claims anew"),
]


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_refs").select("ref_id", "book_id", "owner_kind", "owner_id", "ref_type", "chapter_id", "page", "block_id").distinct()


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """One row per claim, the one delivered first."""
    c = table(spark, sf, "claims").where("claim_id is not null")
    cols = ["book_id", "chapter_id", "claim_type", "statement", "importance", "verification_status", "evidence_support", "ord", "applies_to", "does_not_apply_to"]
    first = c.groupBy("claim_id").agg(F.min_by(F.struct(*cols), F.struct("ingested_at", "chapter_id", "statement")).alias("r"))
    return first.select("claim_id", "r.*")


def _angle_claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "angles").select("book_id", "angle_id", F.explode("core_claim_ids").alias("claim_id")).where("claim_id is not null").distinct()


def ref_graph_violations_union(spark, sf):
    """Every kind of broken reference as one table of described violations.

    Refs of claims count once per claim and block, those of evidence once
    each; all are looked up by book, chapter, page and block.
    """
    refs, claims, angles = _refs(spark, sf), _claims(spark, sf), table(spark, sf, "angles")
    where = ["book_id", "chapter_id", "page", "block_id"]
    blocks = table(spark, sf, "blocks").select(*where)
    book = refs.where("ref_type = 'book'")
    of_claims = book.where("owner_kind = 'claim'").select("owner_id", *where).distinct()
    of_evidence = book.where("owner_kind = 'evidence'").select("ref_id", *where)
    core = _angle_claims(spark, sf)
    shown = angles.select("angle_id", F.explode("evidence_ids").alias("owner_id")).distinct()
    relations = table(spark, sf, "claim_relations").select("relation_id", "from_claim_id", "to_claim_id").distinct()
    ends = relations.select("relation_id", F.explode(F.array("from_claim_id", "to_claim_id")).alias("claim_id")).distinct()
    owners = claims.select(F.lit("claim").alias("owner_kind"), F.col("claim_id").alias("owner_id")).unionByName(angles.select(F.lit("angle").alias("owner_kind"), F.col("angle_id").alias("owner_id")))
    unusable = claims.where("evidence_support = 'unsupported' or verification_status = 'needs_external_check'").select("claim_id")
    eligible = angles.where("eligible").select("angle_id").distinct()
    twice = table(spark, sf, "claims").where("claim_id is not null").groupBy("claim_id").agg(F.count_distinct("book_id", "chapter_id").alias("n")).where("n > 1")
    v = rules.violations
    found = [
        v(rules.dangling(of_claims, blocks, where), "CLAIM_REF_BLOCK", "source_refs", "owner_id", "block_id"),
        v(rules.dangling(of_evidence, blocks, where), "EVIDENCE_REF_BLOCK", "source_refs", "ref_id", "block_id"),
        v(rules.dangling(book, table(spark, sf, "chapters"), ["book_id", "chapter_id"]), "REF_CHAPTER", "source_refs", "ref_id", "chapter_id"),
        v(rules.dangling(refs.where("owner_kind <> 'evidence'"), owners, ["owner_kind", "owner_id"]), "REF_OWNER", "source_refs", "ref_id", "owner_id"),
        v(rules.dangling(core, claims, ["claim_id"]), "ANGLE_CLAIM", "angles", "angle_id", "claim_id"),
        v(rules.dangling(shown, refs.where("owner_kind = 'evidence'"), ["owner_id"]), "ANGLE_EVIDENCE", "angles", "angle_id", "owner_id"),
        v(core.join(eligible, "angle_id", "left_semi").join(unusable, "claim_id", "left_semi"), "ANGLE_CLAIM_UNUSABLE", "angles", "angle_id", "claim_id"),
        v(rules.dangling(ends, claims, ["claim_id"]), "RELATION_CLAIM", "claim_relations", "relation_id", "claim_id"),
        rules.check(relations, F.col("from_claim_id") == F.col("to_claim_id"), "RELATION_SELF", "claim_relations", "relation_id", "from_claim_id"),
        v(twice, "CLAIM_ID_TWICE", "claims", "claim_id", "n"),
    ]
    return rules.described(rules.union_all(found), RULES)


def refs_dangling_or_ineligible(spark, sf):
    """Refs of claims to blocks of their book: the block doesn't exist, or it
    is unsure or on a page with a very unsure one."""
    b = table(spark, sf, "blocks").select("book_id", "block_id", "page", "confidence").where("block_id is not null")
    low = b.where("confidence < 0.5").select("book_id", "page").distinct().withColumn("low", F.lit(True))
    known = b.join(low, ["book_id", "page"], "left").groupBy("book_id", "block_id").agg(F.max((F.coalesce("confidence", F.lit(0.0)) >= 0.85) & F.col("low").isNull()).alias("good"))
    refs = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim' and block_id is not null").select("book_id", F.col("owner_id").alias("claim_id"), "block_id").distinct()
    state = F.when(F.col("good").isNull(), "dangling").when(~F.col("good"), "ineligible")
    return refs.join(known, ["book_id", "block_id"], "left").select("claim_id", "book_id", "block_id", state.alias("state")).where("state is not null")


def constraint_checks(spark, sf):
    """Single rows and groups against declared constraints: pages beyond the
    book, ends before starts, important claims without a source, books with
    one type of claim only, refs to pages without blocks, scores that are not
    the sum of their parts, ids that differ from their parts."""
    claims, refs = _claims(spark, sf), _refs(spark, sf)
    chapters = table(spark, sf, "chapters").select("book_id", "chapter_id", "start_page", "end_page").distinct()
    blocks = table(spark, sf, "blocks").select("book_id", "block_id", "page").distinct()
    last = chapters.groupBy("book_id").agg(F.max("end_page").alias("last_page"))
    scenes = table(spark, sf, "scenes").select("job_id", "scene_id", "start_ms", "end_ms").distinct()
    sourced = refs.where("owner_kind = 'claim'").select(F.col("owner_id").alias("claim_id"))
    kinds = claims.groupBy("book_id").agg(F.count_distinct("claim_type").alias("kinds"))
    angles = table(spark, sf, "angles").select("angle_id", "eligible", "overall_score", "title_integrity_score").distinct()
    block_of = F.concat_ws("/", "book_id", "block_id")
    return rules.union_all(
        [
            rules.check(blocks.join(last, "book_id"), F.col("page") > F.col("last_page"), "PAGE_BEYOND_END", "blocks", block_of, "page"),
            rules.check(chapters, F.col("end_page") < F.col("start_page"), "END_BEFORE_START", "chapters", F.concat_ws("/", "book_id", "chapter_id"), "end_page"),
            rules.check(scenes, F.col("end_ms") <= F.col("start_ms"), "END_BEFORE_START", "scenes", F.concat_ws("/", "job_id", "scene_id"), "end_ms"),
            rules.violations(claims.where("importance.score >= 80").join(sourced, "claim_id", "left_anti"), "IMPORTANT_WITHOUT_SOURCE", "claims", "claim_id", "importance.level"),
            rules.check(kinds, F.col("kinds") < 2, "ONE_KIND_ONLY", "claims", "book_id", "kinds"),
            rules.violations(rules.dangling(refs.where("ref_type = 'book'"), blocks, ["book_id", "page"]), "PAGE_WITHOUT_BLOCKS", "source_refs", "ref_id", "page"),
            rules.check(angles, F.col("eligible") & (F.col("title_integrity_score") < 50), "ELIGIBLE_AGAINST_SCORE", "angles", "angle_id", "title_integrity_score"),
        ]
    )


def scene_list_checks(spark, sf):
    """The scenes of a job as a list: ids, begin, order, roles of the first and
    the last, seams, transitions against cuts and neighbours, emphasis and
    on-screen text that the text must hold."""
    s = table(spark, sf, "scenes").select("job_id", "scene_id", "ord", "start_ms", "end_ms", "purpose", "voice_text", "transition", "transition_ms", "emphasis", "on_screen_text").distinct()
    w = Window.partitionBy("job_id").orderBy("ord", "scene_id", "start_ms", F.coalesce("voice_text", F.lit("")))
    length = F.col("end_ms") - F.col("start_ms")
    s = s.withColumns(
        {
            "before": F.lag("end_ms").over(w),
            "before_length": F.lag(length).over(w),
            "is_last": F.lead("scene_id").over(w).isNull(),
            "nth": F.row_number().over(Window.partitionBy("job_id", "scene_id").orderBy("ord", "start_ms", F.coalesce("voice_text", F.lit("")))),
        }
    )
    item = F.concat_ws("/", "job_id", "scene_id")
    words = s.select("job_id", "scene_id", "voice_text", F.explode("emphasis").alias("word")).where("word <> ''").distinct()
    shown = s.select("job_id", "scene_id", F.explode("on_screen_text").alias("line")).where("line is not null")
    c = rules.check
    return rules.union_all(
        [
            c(s, F.col("nth") > 1, "SCENE_ID_TWICE", "scenes", item, "nth"),
            c(s, F.col("before").isNull() & (F.col("start_ms") != 0), "FIRST_NOT_AT_ZERO", "scenes", item, "start_ms"),
            c(s, F.col("before").isNull() & (F.col("purpose") != "hook"), "FIRST_NO_HOOK", "scenes", item, "purpose"),
            c(s, F.col("is_last") & (F.col("purpose") != "summary"), "LAST_NO_SUMMARY", "scenes", item, "purpose"),
            c(s, F.col("before") != F.col("start_ms"), "SEAM", "scenes", item, F.col("start_ms") - F.col("before")),
            c(s, (F.col("purpose") == "hook") & (length > 3000), "HOOK_TOO_LONG", "scenes", item, length),
            c(s, (F.col("transition") == "cut") != (F.col("transition_ms") == 0), "CUT_WITH_TIME", "scenes", item, "transition_ms"),
            c(s, 2 * F.col("transition_ms") >= F.least(length, F.col("before_length")), "TRANSITION_TOO_LONG", "scenes", item, "transition_ms"),
            c(words, ~F.coalesce(F.contains("voice_text", "word"), F.lit(False)), "EMPHASIS_NOT_IN_TEXT", "scenes", item, "word"),
            rules.violations(shown.groupBy("job_id", "scene_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SHOWN_TWICE", "scenes", item, "line"),
        ]
    ).distinct()


def pacing_checks(spark, sf):
    """Jobs against bounds of their pace: scenes, shortest and longest one,
    longest time without a new one, whole length."""
    s = table(spark, sf, "scenes").select("job_id", "scene_id", "ord", "start_ms", "end_ms").distinct()
    w = Window.partitionBy("job_id").orderBy("start_ms", "scene_id")
    s = s.withColumn("gap", F.greatest(F.col("start_ms") - F.lag("end_ms").over(w), F.lit(0)))
    length = F.col("end_ms") - F.col("start_ms")
    j = s.groupBy("job_id").agg(F.count(F.lit(1)).alias("scenes"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), (F.max("end_ms") - F.min("start_ms")).alias("total"))
    flags = {"FEW": F.col("scenes") < 5, "SHORT": F.col("shortest") < 3000, "LONG": F.col("longest") > 30000, "GAP": F.col("longest_gap") > 6000, "LENGTH": ~F.col("total").between(60000, 330000)}
    return j.withColumn("flags", F.array_join(F.filter(F.array(*[F.when(c, k) for k, c in flags.items()]), lambda x: x.isNotNull()), ","))


def exact_id_set(spark, sf):
    """Angles: are all their claims known in their book, is none named twice.
    The ids are looked up one by one; no list of a book's ids is made."""
    a = table(spark, sf, "angles").select("book_id", "angle_id", "core_claim_ids").where("core_claim_ids is not null").distinct()
    core = F.filter("core_claim_ids", lambda x: x.isNotNull())
    ids = a.select("book_id", "angle_id", F.explode_outer(core).alias("claim_id"))
    there = table(spark, sf, "claims").where("claim_id is not null").select("book_id", "claim_id").distinct().withColumn("there", F.lit(1))
    return ids.join(there, ["book_id", "claim_id"], "left").groupBy("angle_id").agg(
        (F.count("claim_id") == F.count("there")).alias("all_known"), (F.count("claim_id") == F.count_distinct("claim_id")).alias("no_repeats"), F.count("claim_id").alias("n")
    )


def angles_of_one_chapter(spark, sf):
    """Angles all of whose claims stand in one chapter, with it."""
    j = _angle_claims(spark, sf).join(_claims(spark, sf).select("claim_id", "chapter_id"), "claim_id").where("chapter_id is not null")
    return j.groupBy("angle_id").agg(F.count_distinct("chapter_id").alias("n"), F.min("chapter_id").alias("chapter_id"), F.count(F.lit(1)).alias("claims")).where("n = 1").drop("n")


def claims_on_unsure_pages_only(spark, sf):
    """Claims with refs, all of which lie on pages with an unsure block."""
    low = table(spark, sf, "blocks").where("confidence < 0.8").select("book_id", "page").distinct().withColumn("low", F.lit(True))
    refs = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim' and page is not null").select("book_id", F.col("owner_id").alias("claim_id"), "page").distinct()
    return refs.join(low, ["book_id", "page"], "left").groupBy("claim_id").agg(F.bool_and(F.coalesce("low", F.lit(False))).alias("all_low"), F.count(F.lit(1)).alias("pages")).where("all_low").drop("all_low")


def angles_not_protected(spark, sf):
    """Angles but those all of whose claims are verified; without claims they stay."""
    ids = table(spark, sf, "angles").select("angle_id", F.explode_outer("core_claim_ids").alias("claim_id")).distinct()
    safe = _claims(spark, sf).where("verification_status = 'verified'").select("claim_id").withColumn("safe", F.lit(1))
    j = ids.join(safe, "claim_id", "left").groupBy("angle_id").agg(F.count("claim_id").alias("claims"), F.count("safe").alias("verified"))
    return j.where("claims = 0 or claims > verified")


def angles_kept(spark, sf):
    """Eligible angles all of whose claims are known, with one at least."""
    known = _claims(spark, sf).select("claim_id").withColumn("there", F.lit(1))
    ok = _angle_claims(spark, sf).join(known, "claim_id", "left").groupBy("angle_id").agg(F.count(F.lit(1)).alias("claims"), F.count("there").alias("known")).where("claims = known")
    return table(spark, sf, "angles").where("eligible").select("angle_id").distinct().join(ok.select("angle_id", "claims"), "angle_id")


def angles_within_bundles(spark, sf):
    """Angles whose claims another angle of the book holds too, all of them:
    division by counting the claims in common."""
    a = _angle_claims(spark, sf).select("book_id", "angle_id", "claim_id")
    sizes = a.groupBy("angle_id").agg(F.count(F.lit(1)).alias("n"))
    both = a.join(a.select("book_id", F.col("angle_id").alias("bundle_id"), "claim_id"), ["book_id", "claim_id"]).where("angle_id <> bundle_id")
    hits = both.groupBy("angle_id", "bundle_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "angle_id").where("hits = n").select("angle_id", "bundle_id", "n")


def evidence_owner_in_angle(spark, sf):
    """Blocks that an angle cites, whether the first claim that cites the same
    block is one of the angle's."""
    refs = _refs(spark, sf).where("ref_type = 'book' and block_id is not null")
    first = refs.where("owner_kind = 'claim'").groupBy("book_id", "block_id").agg(F.min_by("owner_id", "ref_id").alias("claim_id"))
    cited = refs.where("owner_kind = 'angle'").select("book_id", "block_id", F.col("owner_id").alias("angle_id")).distinct()
    core = _angle_claims(spark, sf).select("angle_id", "claim_id").withColumn("own", F.lit(True))
    return cited.join(first, ["book_id", "block_id"]).join(core, ["angle_id", "claim_id"], "left").select("angle_id", "book_id", "block_id", "claim_id", F.coalesce("own", F.lit(False)).alias("own"))


def angle_refs_outside_claims(spark, sf):
    """Refs of angles to blocks that none of their claims cites; angles that
    may be judged freely (not eligible) are left out."""
    refs = _refs(spark, sf).where("ref_type = 'book' and block_id is not null")
    mine = refs.where("owner_kind = 'angle'").select(F.col("owner_id").alias("angle_id"), "book_id", "block_id").distinct()
    bound = table(spark, sf, "angles").where("eligible").select("angle_id").distinct()
    allowed = refs.where("owner_kind = 'claim'").select(F.col("owner_id").alias("claim_id"), "book_id", "block_id").distinct().join(_angle_claims(spark, sf).select("angle_id", "claim_id"), "claim_id")
    return mine.join(bound, "angle_id", "left_semi").join(allowed.select("angle_id", "book_id", "block_id").distinct(), ["angle_id", "book_id", "block_id"], "left_anti")


def relations_with_shared_source(spark, sf):
    """Relations whose two claims cite a block in common."""
    rel = table(spark, sf, "claim_relations").select("relation_id", "from_claim_id", "to_claim_id").where("from_claim_id <> to_claim_id").distinct()
    refs = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim' and block_id is not null").select("owner_id", "book_id", "block_id").distinct()
    a = rel.join(refs.withColumnRenamed("owner_id", "from_claim_id"), "from_claim_id")
    return a.join(refs.withColumnRenamed("owner_id", "to_claim_id"), ["to_claim_id", "book_id", "block_id"]).groupBy("relation_id").agg(F.count_distinct("book_id", "block_id").alias("shared"))


def chapter_assembly(spark, sf):
    """Chapters with what is known of them: their place, the number of their
    blocks, and their rank by the importance of their claims."""
    ch = table(spark, sf, "chapters").groupBy("book_id", "chapter_id").agg(F.min("ord").alias("ord"), F.min("start_page").alias("start_page"))
    blocks = table(spark, sf, "blocks").where("chapter_id is not null").groupBy("book_id", "chapter_id").agg(F.count_distinct("block_id").alias("blocks"))
    weight = _claims(spark, sf).where("chapter_id is not null").groupBy("book_id", "chapter_id").agg(F.round(F.avg("importance.score") + 1e-9, 4).alias("importance"), F.count(F.lit(1)).alias("claims"))
    ranked = weight.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("importance"), "chapter_id")))
    on = ["book_id", "chapter_id"]
    empty = {"blocks": 0, "claims": 0, "importance": 0.0}
    return ch.join(blocks, on, "left").join(ranked, on, "left").fillna(empty)


def top3_per_group(spark, sf):
    """The three claims of most importance of every chapter; chapters with
    fewer are told."""
    c = _claims(spark, sf).where("chapter_id is not null").select("book_id", "chapter_id", "claim_id", F.col("importance.score").alias("score"))
    best = ranking.top_k(c, ["book_id", "chapter_id"], [F.desc_nulls_last("score"), F.col("claim_id")], 3)
    return best.select("book_id", "chapter_id", "claim_id", "rank", (F.count(F.lit(1)).over(Window.partitionBy("book_id", "chapter_id")) < 3).alias("too_few"))


def children_all_match(spark, sf):
    """Owners all of whose refs name a page of a known block."""
    refs = _refs(spark, sf).where("ref_type = 'book'")
    known = table(spark, sf, "blocks").select("book_id", "block_id", "page").distinct().withColumn("there", F.lit(True))
    return rules.all_of(refs.join(known, ["book_id", "block_id", "page"], "left"), ["owner_kind", "owner_id"], F.col("there"))


def rejection_reasons_array(spark, sf):
    """Angles with all reasons against them, in the order of the rules."""
    a = table(spark, sf, "angles").select("angle_id", "title", "thesis", "core_claim_ids", "evidence_ids", "evidence_strength", "overclaim_penalty").distinct()
    n = F.coalesce(F.size(F.array_distinct(F.filter("core_claim_ids", lambda x: x.isNotNull()))), F.lit(0))
    tests = {
        "NO_TITLE": F.coalesce(F.trim("title"), F.lit("")) == "",
        "NO_THESIS": F.coalesce(F.trim("thesis"), F.lit("")) == "",
        "NO_CLAIMS": F.greatest(n, F.lit(0)) == 0,
        "ONE_CLAIM": n == 1,
        "REPEATED_CLAIM": F.coalesce(F.size(F.filter("core_claim_ids", lambda x: x.isNotNull())) > n, F.lit(False)),
        "NO_EVIDENCE": F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0,
        "WEAK_EVIDENCE": F.col("evidence_strength") < 40,
        "OVERCLAIM": F.col("overclaim_penalty") > 15,
        "TITLE_IS_THESIS": T.collapse("title") == T.collapse("thesis"),
    }
    reasons = F.filter(F.array(*[F.when(c, k) for k, c in tests.items()]), lambda x: x.isNotNull())
    return a.withColumn("r", reasons).where(F.size("r") > 0).select("angle_id", F.array_join("r", ",").alias("reasons")).distinct()


def evidence_strength_mean(spark, sf):
    """Angles' strength of evidence: the mean of their claims' grades of 100;
    0 if a claim is unknown or there is none."""
    value = F.element_at(F.create_map(*[F.lit(x) for x in ("strong", 1.0, "partial", 0.6, "weak", 0.3, "unsupported", 0.0)]), F.col("evidence_support"))
    c = _claims(spark, sf).select("claim_id", F.coalesce(value, F.lit(0.0)).alias("v"))
    ids = table(spark, sf, "angles").select("angle_id", F.explode_outer("core_claim_ids").alias("claim_id")).distinct()
    j = ids.join(c, "claim_id", "left").groupBy("angle_id").agg(F.count("claim_id").alias("n"), F.count("v").alias("known"), F.avg("v").alias("m"))
    return j.select("angle_id", F.when((F.col("n") > 0) & (F.col("n") == F.col("known")), T.half_up(F.col("m") * 100 + 1e-9)).otherwise(0).cast("int").alias("strength"))


def critique_counts(spark, sf):
    """Per book: claims by what is open about them."""
    c = _claims(spark, sf)
    return c.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("verification_status") == "needs_external_check").alias("to_check"),
        F.count_if((F.col("claim_type") == "causal") & F.col("evidence_support").isin("weak", "unsupported")).alias("causal_unsupported"),
        F.sum(F.greatest(F.coalesce(F.size("does_not_apply_to"), F.lit(0)), F.lit(0))).alias("limits"),
        F.count_if(F.col("importance.score") >= 80).alias("important"),
    )


def content_fingerprint_cache(spark, sf):
    """Claims as in the records against their table: what a store of results
    keyed by content could reuse. The records are the store: of each book and
    claim the latest statement there."""
    kinds = "claims array<struct<claimId:string,statement:string,type:string>>"
    store = table(spark, sf, "chapter_records").select("record_id", F.explode(F.from_json("payload", kinds)["claims"]).alias("c")).where("c.claimId is not null")
    latest = store.groupBy(F.col("c.claimId").alias("claim_id")).agg(F.max_by("c.statement", "record_id").alias("statement"))
    from quirefold.operators import cache

    now = _claims(spark, sf).select("claim_id", cache.fingerprint(F.lit("claim/1"), F.col("statement")).alias("input_hash"))
    done = latest.select("claim_id", cache.fingerprint(F.lit("claim/1"), F.col("statement")).alias("input_hash"))
    return cache.reuse(now, done, "claim_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_R = "(select distinct ref_id, book_id, owner_kind, owner_id, ref_type, chapter_id, page, block_id from source_refs)"
_CL = """(select claim_id, r.* from (select claim_id, arg_min({'book_id': book_id, 'chapter_id': chapter_id, 'claim_type': claim_type, 'statement': statement, 'importance': importance, 'verification_status': verification_status,
 'evidence_support': evidence_support, 'ord': ord, 'applies_to': applies_to, 'does_not_apply_to': does_not_apply_to}, {'a': ingested_at, 'b': chapter_id, 'c': statement}) as r from claims where claim_id is not null group by 1))"""
_AC = "(select distinct * from (select book_id, angle_id, unnest(core_claim_ids) as claim_id from angles) where claim_id is not null)"
_RULE_VALUES = ", ".join(f"('{r.code}', '{r.severity}', {str(r.blocking).lower()}, '{r.retry}')" for r in RULES)

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "ref_graph_violations_union": f"""with refs as {_R}, book as (select * from refs where ref_type = 'book'), c as {_CL}, core as {_AC},
blk as (select distinct book_id, chapter_id, page, block_id from blocks), rel as (select distinct relation_id, from_claim_id, to_claim_id from claim_relations),
v(code, artifact, item, detail) as (
select 'CLAIM_REF_BLOCK', 'source_refs', owner_id, block_id from (select distinct owner_id, book_id, chapter_id, page, block_id from book where owner_kind = 'claim' and book_id is not null and chapter_id is not null and page is not null and block_id is not null) anti join blk using (book_id, chapter_id, page, block_id)
union all select 'EVIDENCE_REF_BLOCK', 'source_refs', cast(ref_id as varchar), block_id from (select * from book where owner_kind = 'evidence' and book_id is not null and chapter_id is not null and page is not null and block_id is not null) anti join blk using (book_id, chapter_id, page, block_id)
union all select 'REF_CHAPTER', 'source_refs', cast(ref_id as varchar), chapter_id from book where chapter_id is not null and not exists (select 1 from chapters h where h.book_id = book.book_id and h.chapter_id = book.chapter_id)
union all select 'REF_OWNER', 'source_refs', cast(ref_id as varchar), owner_id from refs where (owner_kind = 'claim' and owner_id not in (select claim_id from c)) or (owner_kind = 'angle' and owner_id not in (select angle_id from angles where angle_id is not null))
union all select 'ANGLE_CLAIM', 'angles', angle_id, claim_id from core where claim_id not in (select claim_id from c)
union all select 'ANGLE_EVIDENCE', 'angles', angle_id, e from (select distinct angle_id, unnest(evidence_ids) as e from angles) where e is not null and e not in (select owner_id from refs where owner_kind = 'evidence' and owner_id is not null)
union all select 'ANGLE_CLAIM_UNUSABLE', 'angles', angle_id, claim_id from core where angle_id in (select angle_id from angles where eligible) and claim_id in (select claim_id from c where evidence_support = 'unsupported' or verification_status = 'needs_external_check')
union all select 'RELATION_CLAIM', 'claim_relations', cast(relation_id as varchar), k from (select distinct relation_id, unnest([from_claim_id, to_claim_id]) as k from rel) where k is not null and k not in (select claim_id from c)
union all select 'RELATION_SELF', 'claim_relations', cast(relation_id as varchar), from_claim_id from rel where from_claim_id = to_claim_id
union all select 'CLAIM_ID_TWICE', 'claims', claim_id, cast(n as varchar) from (select claim_id, count(distinct case when book_id is not null and chapter_id is not null then book_id || '|' || chapter_id end) as n from claims where claim_id is not null group by 1) where n > 1)
select v.code, artifact, item, coalesce(detail, '') as detail, severity, blocking, retry_strategy from v join (values {_RULE_VALUES}) r(code, severity, blocking, retry_strategy) on r.code = v.code""",
    "refs_dangling_or_ineligible": f"""with low as (select distinct book_id, page from blocks where confidence < 0.5 and block_id is not null and page is not null),
k as (select b.book_id, b.block_id, bool_or(coalesce(confidence, 0) >= 0.85 and low.page is null) as good from blocks b left join low on low.book_id = b.book_id and low.page = b.page where b.block_id is not null group by all)
select * from (select r.owner_id as claim_id, r.book_id, r.block_id, case when good is null then 'dangling' when not good then 'ineligible' end as state from (select distinct book_id, owner_id, block_id from {_R} where ref_type = 'book' and owner_kind = 'claim' and block_id is not null) r left join k using (book_id, block_id)) where state is not null""",
    "constraint_checks": f"""with c as {_CL}, refs as {_R}, ch as (select distinct book_id, chapter_id, start_page, end_page from chapters), b as (select distinct book_id, block_id, page from blocks),
v(code, artifact, item, detail) as (
select 'PAGE_BEYOND_END', 'blocks', concat_ws('/', book_id, block_id), cast(page as varchar) from b join (select book_id, max(end_page) as m from ch group by 1) using (book_id) where page > m
union all select 'END_BEFORE_START', 'chapters', concat_ws('/', book_id, chapter_id), cast(end_page as varchar) from ch where end_page < start_page
union all select 'END_BEFORE_START', 'scenes', concat_ws('/', job_id, scene_id), cast(end_ms as varchar) from (select distinct job_id, scene_id, start_ms, end_ms from scenes) where end_ms <= start_ms
union all select 'IMPORTANT_WITHOUT_SOURCE', 'claims', claim_id, importance.level from c where importance.score >= 80 and claim_id not in (select owner_id from refs where owner_kind = 'claim' and owner_id is not null)
union all select 'ONE_KIND_ONLY', 'claims', book_id, cast(n as varchar) from (select book_id, count(distinct claim_type) as n from c group by 1) where n < 2
union all select 'PAGE_WITHOUT_BLOCKS', 'source_refs', cast(ref_id as varchar), cast(page as varchar) from refs where ref_type = 'book' and page is not null and book_id is not null and not exists (select 1 from b where b.book_id = refs.book_id and b.page = refs.page)
union all select 'ELIGIBLE_AGAINST_SCORE', 'angles', angle_id, cast(title_integrity_score as varchar) from (select distinct angle_id, eligible, overall_score, title_integrity_score from angles) where eligible and title_integrity_score < 50)
select code, artifact, item, coalesce(detail, '') as detail from v""",
    "scene_list_checks": """with d as (select distinct job_id, scene_id, ord, start_ms, end_ms, purpose, voice_text, transition, transition_ms, emphasis, on_screen_text from scenes),
s as (select *, end_ms - start_ms as n, lag(end_ms) over w as before, lag(end_ms - start_ms) over w as bn, lead(scene_id) over w is null as is_last,
 row_number() over (partition by job_id, scene_id order by ord, start_ms, coalesce(voice_text, '')) as nth, job_id || '/' || scene_id as item from d window w as (partition by job_id order by ord, scene_id, start_ms, coalesce(voice_text, ''))),
v(code, item, detail) as (
select 'SCENE_ID_TWICE', item, cast(nth as varchar) from s where nth > 1
union all select 'FIRST_NOT_AT_ZERO', item, cast(start_ms as varchar) from s where before is null and start_ms <> 0
union all select 'FIRST_NO_HOOK', item, purpose from s where before is null and purpose <> 'hook'
union all select 'LAST_NO_SUMMARY', item, purpose from s where is_last and purpose <> 'summary'
union all select 'SEAM', item, cast(start_ms - before as varchar) from s where before <> start_ms
union all select 'HOOK_TOO_LONG', item, cast(n as varchar) from s where purpose = 'hook' and n > 3000
union all select 'CUT_WITH_TIME', item, cast(transition_ms as varchar) from s where (transition = 'cut') <> (transition_ms = 0)
union all select 'TRANSITION_TOO_LONG', item, cast(transition_ms as varchar) from s where 2 * transition_ms >= least(n, bn)
union all select 'EMPHASIS_NOT_IN_TEXT', item, word from (select item, voice_text, unnest(emphasis) as word from s) where word <> '' and not coalesce(contains(voice_text, word), false)
union all select 'SHOWN_TWICE', item, line from (select item, unnest(on_screen_text) as line from s) where line is not null group by 1, 2, 3 having count(*) > 1)
select distinct code, 'scenes' as artifact, item, coalesce(detail, '') as detail from v""",
    "pacing_checks": """with s as (select *, greatest(start_ms - lag(end_ms) over (partition by job_id order by start_ms, scene_id), 0) as gap from (select distinct job_id, scene_id, ord, start_ms, end_ms from scenes)),
j as (select job_id, count(*) as scenes, min(end_ms - start_ms) as shortest, max(end_ms - start_ms) as longest, coalesce(max(gap), 0) as longest_gap, max(end_ms) - min(start_ms) as total from s group by 1)
select *, concat_ws(',', case when scenes < 5 then 'FEW' end, case when shortest < 3000 then 'SHORT' end, case when longest > 30000 then 'LONG' end, case when longest_gap > 6000 then 'GAP' end, case when total not between 60000 and 330000 then 'LENGTH' end) as flags from j""",
    "exact_id_set": """select a.angle_id, bool_and(k is null or exists (select 1 from claims c where c.book_id = a.book_id and c.claim_id = k)) as all_known, count(k) = count(distinct k) as no_repeats, count(k) as n
from (select distinct book_id, angle_id, core_claim_ids from angles where core_claim_ids is not null) a left join lateral (select unnest(a.core_claim_ids) as k) on true group by 1""",
    "angles_of_one_chapter": f"select angle_id, min(chapter_id) as chapter_id, count(*) as claims from {_AC} join (select claim_id, chapter_id from {_CL}) using (claim_id) where chapter_id is not null group by 1 having count(distinct chapter_id) = 1",
    "claims_on_unsure_pages_only": f"select owner_id as claim_id, count(*) as pages from (select distinct book_id, owner_id, page from {_R} where ref_type = 'book' and owner_kind = 'claim' and page is not null) r group by 1 having bool_and(exists (select 1 from blocks b where b.book_id = r.book_id and b.page = r.page and b.confidence < 0.8))",
    "angles_not_protected": f"""with i as (select angle_id, case when len(core_claim_ids) > 0 then core_claim_ids else [null] end as ids from angles), x as (select distinct angle_id, unnest(ids) as k from i)
select angle_id, count(k) as claims, count(s.claim_id) as verified from x left join (select claim_id from {_CL} where verification_status = 'verified') s on s.claim_id = x.k group by 1 having count(k) = 0 or count(k) > count(s.claim_id)""",
    "angles_kept": f"select angle_id, count(*) as claims from {_AC} where angle_id in (select angle_id from angles where eligible) group by 1 having bool_and(claim_id in (select claim_id from claims where claim_id is not null))",
    "angles_within_bundles": f"""with a as {_AC}, n as (select angle_id, count(*) as n from a group by 1)
select x.angle_id, y.angle_id as bundle_id, n from a x join a y on x.book_id = y.book_id and x.claim_id = y.claim_id and x.angle_id <> y.angle_id join n on n.angle_id = x.angle_id group by all having count(*) = n""",
    "evidence_owner_in_angle": f"""with r as (select * from {_R} where ref_type = 'book' and block_id is not null), f as (select book_id, block_id, arg_min(owner_id, ref_id) as claim_id from r where owner_kind = 'claim' group by all)
select x.angle_id, x.book_id, x.block_id, f.claim_id, (x.angle_id, f.claim_id) in (select (angle_id, claim_id) from {_AC}) as own from (select distinct book_id, block_id, owner_id as angle_id from r where owner_kind = 'angle') x join f using (book_id, block_id)""",
    "angle_refs_outside_claims": f"""with r as (select * from {_R} where ref_type = 'book' and block_id is not null)
select distinct owner_id as angle_id, book_id, block_id from r where owner_kind = 'angle' and owner_id in (select angle_id from angles where eligible) and not exists (select 1 from r q join {_AC} c on q.owner_id = c.claim_id where q.owner_kind = 'claim' and c.angle_id = r.owner_id and q.book_id = r.book_id and q.block_id = r.block_id)""",
    "relations_with_shared_source": f"""with r as (select distinct owner_id, book_id, block_id from {_R} where ref_type = 'book' and owner_kind = 'claim' and block_id is not null)
select relation_id, count(distinct a.book_id || '/' || a.block_id) as shared from (select distinct relation_id, from_claim_id, to_claim_id from claim_relations where from_claim_id <> to_claim_id) x join r a on a.owner_id = from_claim_id join r b on b.owner_id = to_claim_id and a.book_id = b.book_id and a.block_id = b.block_id group by 1""",
    "chapter_assembly": f"""with w as (select book_id, chapter_id, round(avg(importance.score) + 1e-9, 4) as importance, count(*) as claims from {_CL} where chapter_id is not null group by all)
select c.book_id, c.chapter_id, c.ord, c.start_page, coalesce(blocks, 0) as blocks, coalesce(importance, 0.0) as importance, coalesce(claims, 0) as claims, rank from (select book_id, chapter_id, min(ord) as ord, min(start_page) as start_page from chapters group by all) c
left join (select book_id, chapter_id, count(distinct block_id) as blocks from blocks where chapter_id is not null group by all) using (book_id, chapter_id)
left join (select *, row_number() over (partition by book_id order by importance desc nulls last, chapter_id) as rank from w) using (book_id, chapter_id)""",
    "top3_per_group": f"""select *, count(*) over (partition by book_id, chapter_id) < 3 as too_few from (select book_id, chapter_id, claim_id, row_number() over (partition by book_id, chapter_id order by importance.score desc nulls last, claim_id) as rank from {_CL} where chapter_id is not null) where rank <= 3""",
    "children_all_match": f"select owner_kind, owner_id from {_R} r where ref_type = 'book' group by all having bool_and(exists (select 1 from blocks b where b.book_id = r.book_id and b.block_id = r.block_id and b.page = r.page))",
    "rejection_reasons_array": r"""with a as (select *, list_filter(core_claim_ids, lambda x: x is not null) as ids from angles), r as (select angle_id, concat_ws(',', case when coalesce(trim(title, ' '), '') = '' then 'NO_TITLE' end, case when coalesce(trim(thesis, ' '), '') = '' then 'NO_THESIS' end,
case when coalesce(len(ids), 0) = 0 then 'NO_CLAIMS' end, case when len(list_distinct(ids)) = 1 then 'ONE_CLAIM' end, case when len(ids) > len(list_distinct(ids)) then 'REPEATED_CLAIM' end, case when coalesce(len(evidence_ids), 0) = 0 then 'NO_EVIDENCE' end,
case when evidence_strength < 40 then 'WEAK_EVIDENCE' end, case when overclaim_penalty > 15 then 'OVERCLAIM' end, case when trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) = trim(regexp_replace(thesis, '[\s\p{Z}]+', ' ', 'g')) then 'TITLE_IS_THESIS' end) as reasons from a)
select distinct angle_id, reasons from r where reasons <> ''""",
    "evidence_strength_mean": f"""with i as (select angle_id, case when len(core_claim_ids) > 0 then core_claim_ids else [null] end as ids from angles), x as (select distinct angle_id, unnest(ids) as claim_id from i),
c as (select claim_id, case evidence_support when 'strong' then 1.0 when 'partial' then 0.6 when 'weak' then 0.3 else 0.0 end as v from {_CL})
select angle_id, cast(case when count(x.claim_id) > 0 and count(x.claim_id) = count(v) then floor(avg(v) * 100 + 1e-9 + 0.5) else 0 end as int) as strength from x left join c using (claim_id) group by 1""",
    "critique_counts": f"""select book_id, count(*) as claims, count_if(verification_status = 'needs_external_check') as to_check, count_if(claim_type = 'causal' and evidence_support in ('weak', 'unsupported')) as causal_unsupported,
cast(sum(coalesce(len(does_not_apply_to), 0)) as bigint) as limits, count_if(importance.score >= 80) as important from {_CL} group by 1""",
    "content_fingerprint_cache": f"""with s as (select record_id, unnest(cast(json_extract(payload, '$.claims') as json[])) as c from (select record_id, payload from chapter_records where json_valid(payload)) where json_type(payload, '$.claims') = 'ARRAY'),
l as (select c->>'$.claimId' as claim_id, arg_max(coalesce(c->>'$.statement', ''), record_id) as st from s where c->>'$.claimId' is not null group by 1)
select case when l.claim_id is null then 'miss' when coalesce(l.st, '') = coalesce(c.statement, '') then 'hit' else 'stale' end as state, count(*) as n from {_CL} c left join l using (claim_id) group by 1""",
}

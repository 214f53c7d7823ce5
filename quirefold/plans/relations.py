"""Queries of rules, joins, aggregates, ranking and reuse, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import timeline as G
from quirefold.operators import ranking, rules, windows
from quirefold.session import table


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chapters").select("book_id", "chapter_id", "title", "start_page", "end_page", "ord").distinct()


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "blocks").select("book_id", "block_id", "page", "chapter_id", "block_type", "language", "confidence", "ord", "pdf_kind", "original_text").distinct()


def page_to_chapter_range_join(spark, sf):
    """The chapter whose page range holds a block's page."""
    pages = _blocks(spark, sf).select("book_id", "page").where("page is not null").distinct()
    ranges = _chapters(spark, sf).select("book_id", "start_page", "end_page", F.col("chapter_id").alias("found")).dropDuplicates(["book_id", "start_page"])
    return windows.in_ranges(pages, ranges, ["book_id"], "page", "start_page", "end_page", ["found"])


def block_outside_chapter(spark, sf):
    """Blocks whose chapter is unknown, or doesn't cover their page; the first
    excludes the second."""
    b, c = _blocks(spark, sf).where("chapter_id is not null"), _chapters(spark, sf).select("book_id", "chapter_id", "start_page", "end_page")
    j = b.select("book_id", "block_id", "chapter_id", "page").distinct().join(c, ["book_id", "chapter_id"], "left")
    unknown = F.col("start_page").isNull()
    item = F.concat_ws("/", "book_id", "block_id")
    return rules.union_all(
        [
            rules.check(j, unknown, "UNKNOWN_CHAPTER", "blocks", item, "page"),
            rules.check(j, ~unknown & ~F.col("page").between(F.col("start_page"), F.col("end_page")), "OUTSIDE_CHAPTER", "blocks", item, "page"),
        ]
    ).distinct()


def range_overlap_running_max(spark, sf):
    rows = windows.ranges_from_starts(_chapters(spark, sf), ["book_id"], "start_page", "end_page")
    return rules.overlapping(_chapters(spark, sf), ["book_id"], "start_page", "end_page").select("book_id", "chapter_id", "end_before").join(rows.select("book_id", "chapter_id", "range_end"), ["book_id", "chapter_id"], "left")


def chapter_ranges_lead(spark, sf):
    starts = _chapters(spark, sf).groupBy("book_id", "start_page").agg(F.min("chapter_id").alias("chapter_id"), F.max("end_page").alias("end_page"))
    return windows.ranges_from_starts(starts, ["book_id"], "start_page", "end_page").select("book_id", "chapter_id", "start_page", "range_end")


def page_set_complete(spark, sf):
    return rules.missing_numbers(_blocks(spark, sf), ["book_id"], "page")


def duplicate_ids_later_rows(spark, sf):
    b = table(spark, sf, "blocks").select("book_id", "block_id", "ingested_at", "extracted_at", "original_text")
    late = rules.later_duplicates(b, ["book_id", "block_id"], ["ingested_at", "extracted_at", "original_text"])
    return late.groupBy("book_id", "block_id").agg(F.count(F.lit(1)).alias("later_rows"))


def id_prefix_check(spark, sf):
    """Block ids that don't begin with their page, and page numbers under 1."""
    b = _blocks(spark, sf).select("book_id", "block_id", "page").distinct()
    wrong = rules.check(b, ~F.col("block_id").startswith(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-"))), "ID_PREFIX", "blocks", F.concat_ws("/", "book_id", "block_id"), "page")
    low = rules.check(b, F.col("page") < 1, "PAGE_RANGE", "blocks", F.concat_ws("/", "book_id", "block_id"), "page")
    return rules.union_all([wrong, low]).distinct()


def missing_refs_anti_join(spark, sf):
    refs = table(spark, sf, "source_refs").where("ref_type = 'book'").select("ref_id", "book_id", "block_id").distinct()
    return rules.dangling(refs, table(spark, sf, "blocks"), ["book_id", "block_id"]).select("ref_id", "book_id", "block_id")


def full_outer_coverage_diff(spark, sf):
    """Chapters as listed against chapters as the blocks show them."""
    listed = _chapters(spark, sf).groupBy("book_id", "chapter_id").agg(F.min("start_page").alias("first_page"))
    seen = _blocks(spark, sf).where("chapter_id is not null").groupBy("book_id", "chapter_id").agg(F.min("page").alias("first_page"))
    return rules.coverage_difference(listed, seen, ["book_id", "chapter_id"], ["first_page"])


def dangling_distinct_ids(spark, sf):
    ids = table(spark, sf, "angles").select(F.explode("core_claim_ids").alias("claim_id")).unionByName(table(spark, sf, "claim_relations").select(F.explode(F.array("from_claim_id", "to_claim_id")).alias("claim_id")))
    return rules.dangling(ids.distinct(), table(spark, sf, "claims"), ["claim_id"])


def dominant_language_first_seen(spark, sf):
    """Languages of a book in the order in which they appear."""
    b = _blocks(spark, sf).withColumn("lang", T.detect_script_language("original_text")).where("lang <> 'und'")
    first = b.groupBy("book_id", "lang").agg(F.min(F.struct("page", "ord", "block_id")).alias("at"))
    return first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("at", "lang"))).alias("l")).select("book_id", F.array_join(F.transform("l", lambda x: x["lang"]), ",").alias("languages"), F.col("l")[0]["lang"].alias("dominant"))


def page_confidence_two_level(spark, sf):
    """Confidence of a book as the mean of its pages' means."""
    pages = _blocks(spark, sf).groupBy("book_id", "page").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("c"))
    return pages.groupBy("book_id").agg(F.round(F.avg("c") + 1e-9, 6).alias("confidence"), F.count(F.lit(1)).alias("pages"))


def pdf_kind_counts(spark, sf):
    """Kind of a book by its share of scanned blocks."""
    n = F.count_if(F.col("pdf_kind") == "scanned")
    kind = F.when(F.col("scanned") == 0, "digital").when(F.col("scanned") == F.col("n"), "scanned").otherwise("mixed")
    return _blocks(spark, sf).groupBy("book_id").agg(n.alias("scanned"), F.count(F.lit(1)).alias("n")).select("book_id", kind.alias("kind"), "scanned", "n")


def low_confidence_anti_join(spark, sf):
    """Blocks of sure confidence on pages without a low one, in known chapters."""
    b = _blocks(spark, sf)
    low = b.where("confidence < 0.8").select("book_id", "page").distinct()
    good = b.where("confidence >= 0.85").join(low, ["book_id", "page"], "left_anti").join(_chapters(spark, sf).select("book_id", "chapter_id").distinct(), ["book_id", "chapter_id"], "left_semi")
    return good.select("book_id", "block_id", "page").distinct()


def evidence_pack(spark, sf):
    """Per chapter the number and length of its usable blocks, and their span."""
    b = _blocks(spark, sf).where("confidence >= 0.85 and chapter_id is not null and original_text is not null")
    return b.groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("original_text")).alias("chars"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def box_union(spark, sf):
    """The rectangle around all blocks of a page."""
    b = table(spark, sf, "blocks").where("bbox is not null").select("book_id", "page", "block_id", "bbox").distinct()
    r = b.groupBy("book_id", "page").agg(F.min("bbox.x").alias("x1"), F.min("bbox.y").alias("y1"), F.max(F.col("bbox.x") + F.col("bbox.w")).alias("x2"), F.max(F.col("bbox.y") + F.col("bbox.h")).alias("y2"))
    return r.select("book_id", "page", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def nearest_box(spark, sf):
    """For each caption the nearest other block of its page, by the distance
    of their rectangles; ties go to the lesser id."""
    b = table(spark, sf, "blocks").where("bbox is not null and page is not null").groupBy("book_id", "page", "block_id", "block_type").agg(F.min("bbox").alias("bbox"))
    caps = b.where("block_type = 'caption'").select("book_id", "page", F.col("block_id").alias("caption_id"), F.col("bbox").alias("cb"))
    j = caps.join(b.where("block_type <> 'caption'"), ["book_id", "page"]).withColumn("d", G.box_distance(F.col("bbox"), F.col("cb")))
    best = j.where("d <= 60").groupBy("book_id", "caption_id").agg(F.min(F.struct("d", "block_id")).alias("m"))
    return best.select("book_id", "caption_id", F.col("m.block_id").alias("block_id"), F.round("m.d", 6).alias("distance"))


def page_list_note(spark, sf):
    refs = table(spark, sf, "source_refs").where("page is not null").groupBy("book_id", "owner_id").agg(F.collect_set("page").alias("pages"))
    return refs.select("book_id", "owner_id", T.page_list(F.col("pages")).alias("note"))


def distinct_counts(spark, sf):
    return table(spark, sf, "claim_relations").groupBy("book_id").agg(F.count_distinct("relation").alias("relations"), F.count_distinct("from_claim_id").alias("sources"))


def evenly_spaced_sample(spark, sf):
    b = _blocks(spark, sf).where("chapter_id is not null").select("book_id", "chapter_id", "block_id", "page", "ord").distinct()
    return ranking.evenly_spaced(b, ["book_id", "chapter_id"], ["page", "ord", "block_id"], 5).select("book_id", "chapter_id", "block_id", "position")


def budgeted_fill(spark, sf):
    """Blocks of a chapter in order until 1,000 characters, none beyond 1,200."""
    b = _blocks(spark, sf).where("chapter_id is not null and original_text is not null").select("book_id", "chapter_id", F.struct("page", "ord", "block_id", F.char_length("original_text").alias("size")).alias("x")).distinct()
    arrays = b.groupBy("book_id", "chapter_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    items = F.transform("xs", lambda x, i: F.struct(i.alias("ord"), x["size"].alias("size")))
    filled = arrays.withColumn("f", ranking.greedy_fill(items, lambda x: x["size"], 1200, 1000))
    return filled.select("book_id", "chapter_id", F.col("f.total").alias("total"), F.size("f.taken").alias("taken"))


def weighted_penalised_score(spark, sf):
    """The angles' scores: weighted parts less penalties, clamped to 0..100."""
    a = table(spark, sf, "angles").select("angle_id", *_PARTS, *_PENALTIES).distinct()
    plus = sum((F.col(c) * w for c, w in _PARTS.items()), F.lit(0.0))
    minus = sum((F.col(c) * w for c, w in _PENALTIES.items()), F.lit(0.0))
    return a.select("angle_id", T.half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), plus - minus)) + 1e-9).cast("int").alias("score"))


_PARTS = {"audience_relevance": 0.2, "practical_value": 0.15, "counter_intuitive_score": 0.1, "evidence_strength": 0.2, "narrative_potential": 0.1, "save_value": 0.1, "original_insight": 0.1, "title_integrity_score": 0.05}
_PENALTIES = {"faithfulness_penalty": 1.0, "overclaim_penalty": 1.0, "evidence_penalty": 1.0}


def last_value_first_position(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "event_id")
    return ranking.first_place_last_value(e, ["user_id", "event_type"], "at", "event_id").select("user_id", "event_type", F.col("place.event_id").alias("first_event"), F.col("event_id").alias("last_event"))


def support_bundles(spark, sf):
    """Sets of claims that angles rest on together."""
    a = table(spark, sf, "angles").select("angle_id", F.explode("core_claim_ids").alias("claim_id"))
    return ranking.set_bundles(a, ["angle_id"], "claim_id").select(F.array_join("members", ",").alias("members"), "groups")


def group_status(spark, sf):
    """A book's status by rounded mean confidence: at 75 and 85 of 100."""
    b = _blocks(spark, sf).groupBy("book_id").agg(F.avg("confidence").alias("c"))
    score = T.half_up(F.col("c") * 100 + 1e-9).cast("int")
    return b.where("c is not null").select("book_id", score.alias("score"), F.when(score < 75, "low").when(score < 85, "medium").otherwise("high").alias("status"))


_CH = "(select distinct book_id, chapter_id, title, start_page, end_page, ord from chapters)"
_B = "(select distinct book_id, block_id, page, chapter_id, block_type, language, confidence, ord, pdf_kind, original_text from blocks)"
_ENDS = "(select distinct relation_id, unnest([from_claim_id, to_claim_id]) as claim_id from claim_relations)"
_ANG = "(select distinct angle_id, unnest(core_claim_ids) as claim_id from angles)"


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "page_to_chapter_range_join": f"""select p.book_id, p.page, max(case when p.page <= c.end_page then c.chapter_id end) as found from (select distinct book_id, page from blocks where page is not null) p
left join lateral (select chapter_id, end_page from (select book_id, start_page, max(end_page) as end_page, min(chapter_id) as chapter_id from {_CH} group by all) c where c.book_id = p.book_id and c.start_page <= p.page order by start_page desc limit 1) c on true group by all""",
    "block_outside_chapter": f"""select distinct case when c.start_page is null then 'UNKNOWN_CHAPTER' else 'OUTSIDE_CHAPTER' end as code, 'blocks' as artifact, b.book_id || '/' || b.block_id as item, coalesce(cast(b.page as varchar), '') as detail from {_B} b left join {_CH} c using (book_id, chapter_id)
where b.chapter_id is not null and (c.start_page is null or b.page not between c.start_page and c.end_page)""",
    "chapter_ranges_lead": f"""select book_id, chapter_id, start_page, coalesce(lead(start_page) over (partition by book_id order by start_page) - 1, end_page) as range_end
from (select book_id, start_page, min(chapter_id) as chapter_id, max(end_page) as end_page from {_CH} group by all)""",
    "page_set_complete": "select book_id, page from (select book_id, unnest(range(1, max(page) + 1)) as page from blocks group by book_id) except select book_id, page from blocks",
    "duplicate_ids_later_rows": "select book_id, block_id, count(*) - 1 as later_rows from blocks group by all having count(*) > 1",
    "id_prefix_check": """select distinct 'ID_PREFIX' as code, 'blocks' as artifact, book_id || '/' || block_id as item, cast(page as varchar) as detail from blocks where not starts_with(block_id, 'p' || page || '-')
union all select distinct 'PAGE_RANGE', 'blocks', book_id || '/' || block_id, cast(page as varchar) from blocks where page < 1""",
    "missing_refs_anti_join": "select distinct ref_id, book_id, block_id from source_refs r where ref_type = 'book' and block_id is not null and not exists (select 1 from blocks b where b.book_id = r.book_id and b.block_id = r.block_id)",
    "full_outer_coverage_diff": f"""with l as (select book_id, chapter_id, min(start_page) as p from {_CH} group by all), s as (select book_id, chapter_id, min(page) as p from blocks where chapter_id is not null group by all)
select book_id, chapter_id, state from (select coalesce(l.book_id, s.book_id) as book_id, coalesce(l.chapter_id, s.chapter_id) as chapter_id,
case when s.book_id is null then 'only_left' when l.book_id is null then 'only_right' when l.p is distinct from s.p then 'differs' end as state from l full outer join s on l.book_id = s.book_id and l.chapter_id = s.chapter_id) where state is not null""",
    "dangling_distinct_ids": f"select distinct claim_id from (select claim_id from {_ANG} union all select claim_id from {_ENDS}) where claim_id is not null and claim_id not in (select claim_id from claims where claim_id is not null)",
    "dominant_language_first_seen": rf"""with b as (select book_id, page, ord, block_id, case when regexp_matches(original_text, '[\x{{3040}}-\x{{30ff}}]') then 'ja' when regexp_matches(original_text, '\p{{Han}}') then 'zh-CN' when regexp_matches(original_text, '\p{{Latin}}') then 'en' else 'und' end as lang from blocks where original_text is not null),
f as (select book_id, lang, min({{'page': page, 'ord': ord, 'id': block_id}}) as p from b where lang <> 'und' group by all)
select book_id, string_agg(lang, ',' order by p, lang) as languages, arg_min(lang, {{'p': p, 'l': lang}}) as dominant from f group by 1""",
    "page_confidence_two_level": f"select book_id, round(avg(c) + 1e-9, 6) as confidence, count(*) as pages from (select book_id, page, coalesce(avg(confidence), 0) as c from {_B} group by all) group by 1",
    "pdf_kind_counts": f"""select book_id, case when s = 0 then 'digital' when s = n then 'scanned' else 'mixed' end as kind, s as scanned, n from (select book_id, count(*) filter (where pdf_kind = 'scanned') as s, count(*) as n from {_B} group by 1)""",
    "low_confidence_anti_join": f"""select distinct book_id, block_id, page from {_B} b where confidence >= 0.85 and not exists (select 1 from blocks l where l.confidence < 0.8 and l.book_id = b.book_id and l.page = b.page)
and exists (select 1 from chapters c where c.book_id = b.book_id and c.chapter_id = b.chapter_id)""",
    "evidence_pack": f"select book_id, chapter_id, count(*) as blocks, sum(length(original_text)) as chars, min(page) as first_page, max(page) as last_page from {_B} where confidence >= 0.85 and chapter_id is not null and original_text is not null group by all",
    "box_union": "select book_id, page, round(min(bbox.x), 6) as x1, round(min(bbox.y), 6) as y1, round(max(bbox.x + bbox.w), 6) as x2, round(max(bbox.y + bbox.h), 6) as y2 from blocks where bbox is not null group by all",
    "nearest_box": """with b as (select book_id, page, block_id, block_type, min(bbox) as q from blocks where bbox is not null and page is not null group by all),
d as (select c.book_id, c.block_id as caption_id, b.block_id, sqrt(pow(greatest(0, b.q.x - (c.q.x + c.q.w), c.q.x - (b.q.x + b.q.w)), 2) + pow(greatest(0, b.q.y - (c.q.y + c.q.h), c.q.y - (b.q.y + b.q.h)), 2)) as d
from b c join b on c.book_id = b.book_id and c.page = b.page where c.block_type = 'caption' and b.block_type <> 'caption')
select book_id, caption_id, block_id, round(d, 6) as distance from d where d <= 60 qualify row_number() over (partition by book_id, caption_id order by d, block_id) = 1""",
    "page_list_note": """select book_id, owner_id, case when len(p) <= 4 then array_to_string(p, '、') else p[1] || '—' || p[len(p)] || '（共' || len(p) || '页）' end as note
from (select book_id, owner_id, list_sort(list(distinct page)) as p from source_refs where page is not null group by all)""",
    "distinct_counts": "select book_id, count(distinct relation) as relations, count(distinct from_claim_id) as sources from claim_relations group by 1",
    "evenly_spaced_sample": """with b as (select distinct book_id, chapter_id, block_id, page, ord from blocks where chapter_id is not null),
r as (select *, row_number() over (partition by book_id, chapter_id order by page, ord, block_id) - 1 as position, count(*) over (partition by book_id, chapter_id) as n from b),
w as (select book_id, chapter_id, cast(floor(i * (n - 1) / 4.0 + 0.5) as bigint) as position from (select distinct book_id, chapter_id, n from r where n > 5), range(5) t(i))
select book_id, chapter_id, block_id, position from r where n <= 5 union all select r.book_id, r.chapter_id, r.block_id, r.position from r join w using (book_id, chapter_id, position)""",
    "weighted_penalised_score": "select distinct angle_id, cast(floor(greatest(0.0, least(100.0, "
    + " + ".join(f"{c} * {w}::double" for c, w in _PARTS.items())
    + " - "
    + " - ".join(f"{c} * {w}::double" for c, w in _PENALTIES.items())
    + ")) + 1e-9 + 0.5) as int) as score from angles",
    "last_value_first_position": "select user_id, event_type, arg_min(event_id, {'t': ts, 'e': event_id}) as first_event, arg_max(event_id, {'t': ts, 'e': event_id}) as last_event from events group by all",
    "support_bundles": "select members, count(*) as groups from (select angle_id, array_to_string(list_sort(list(distinct claim_id)), ',') as members, count(distinct claim_id) as n from (select angle_id, unnest(core_claim_ids) as claim_id from angles) where claim_id is not null group by 1) where n >= 2 group by 1",
    "group_status": f"""select book_id, s as score, case when s < 75 then 'low' when s < 85 then 'medium' else 'high' end as status from (select book_id, cast(floor(avg(confidence) * 100 + 1e-9 + 0.5) as int) as s from {_B} group by 1) where s is not null""",
    "range_overlap_running_max": f"""with c as (select *, max(end_page) over (partition by book_id order by start_page, end_page rows between unbounded preceding and 1 preceding) as end_before from {_CH}),
s as (select *, lag(start_page) over (partition by book_id order by start_page) as b from {_CH}), e as (select book_id, chapter_id, coalesce(lead(start_page) over (partition by book_id order by start_page) - 1, end_page) as range_end from s where b is null or b <> start_page)
select c.book_id, c.chapter_id, c.end_before, e.range_end from c left join e using (book_id, chapter_id) where start_page <= end_before""",
}

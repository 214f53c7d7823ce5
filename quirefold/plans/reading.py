"""Queries of samples, reshaping, alignment and page layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import timeline as G
from quirefold.operators import alignment, ranking
from quirefold.plans.graph import _CL, _R, _angle_claims, _claims, _refs
from quirefold.session import table


def _body(spark: SparkSession, sf: str) -> DataFrame:
    """One row per block of a chapter, the least of its versions."""
    b = table(spark, sf, "blocks").where("chapter_id is not null and block_id is not null")
    return b.groupBy("book_id", "chapter_id", "block_id").agg(F.min(F.struct("page", "ord", "block_type", "original_text", "confidence")).alias("r")).select("book_id", "chapter_id", "block_id", "r.*")


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scenes")
    return s.groupBy("job_id", "scene_id").agg(F.min(F.struct("ord", "start_ms", "end_ms", "purpose", "voice_text", "visual_type", "transition", "transition_ms")).alias("r")).select("job_id", "scene_id", "r.*")


def required_and_spaced_sample(spark, sf):
    """Of each chapter the blocks that claims cite, and of the others as many,
    evenly spaced, as make 8."""
    cited = _refs(spark, sf).where("ref_type = 'book' and owner_kind = 'claim'").select("book_id", "chapter_id", "block_id").distinct().withColumn("cited", F.lit(True))
    b = _body(spark, sf).join(cited, ["book_id", "chapter_id", "block_id"], "left")
    out = ranking.fill_up(b, ["book_id", "chapter_id"], ["page", "ord", "block_id"], F.col("cited"), 8)
    return out.select("book_id", "chapter_id", "block_id", "required")


def refs_by_need(spark, sf):
    """Of a claim's refs as many, evenly spaced, as it has scopes and one, six
    at most."""
    n = F.least(F.lit(6), 1 + F.greatest(F.coalesce(F.size("applies_to"), F.lit(0)), F.lit(0)))
    need = _claims(spark, sf).select("claim_id", n.alias("k"))
    refs = _refs(spark, sf).where("owner_kind = 'claim'").select("ref_id", F.col("owner_id").alias("claim_id")).distinct().join(need, "claim_id")
    return ranking.evenly_spaced(refs, ["claim_id"], ["ref_id"], F.col("k")).select("claim_id", "ref_id", "k")


def budgeted_chapter_sample(spark, sf):
    """Chapters' blocks within 1,500 characters: headings always, the others
    evenly spaced."""
    b = _body(spark, sf).withColumn("size", F.coalesce(F.char_length("original_text"), F.lit(0)))
    return ranking.budgeted_sample(b, ["book_id", "chapter_id"], ["page", "ord", "block_id"], "size", 1500, F.col("block_type") == "heading").select("book_id", "chapter_id", "block_id", "size")


def reading_order(spark, sf):
    """Blocks of a page from top to bottom in steps of 10 points, then from
    left to right."""
    b = table(spark, sf, "blocks").where("bbox is not null and page is not null").groupBy("book_id", "page", "block_id").agg(F.min("bbox").alias("q"))
    w = Window.partitionBy("book_id", "page").orderBy(F.desc(F.floor(F.col("q.y") / 10 + 0.5)), "q.x", "block_id")
    return b.select("book_id", "page", "block_id", F.row_number().over(w).alias("nth"))


def front_matter_inserted(spark, sf):
    """Chapters' first pages as the blocks show them; books that don't begin
    with page 1 get a row for what comes before."""
    starts = _body(spark, sf).where("page is not null").groupBy("book_id", "chapter_id").agg(F.min("page").alias("start_page"))
    before = starts.groupBy("book_id").agg(F.min("start_page").alias("m")).where("m > 1").select("book_id", F.lit("front-matter").alias("chapter_id"), F.lit(1).alias("start_page"))
    return starts.unionByName(before.withColumn("start_page", F.col("start_page").cast(starts.schema["start_page"].dataType)))


def targets_within_opening(spark, sf):
    """Books whose three chapters of most importance are their first three."""
    weight = _claims(spark, sf).where("chapter_id is not null").groupBy("book_id", "chapter_id").agg(F.avg("importance.score").alias("w"))
    ch = table(spark, sf, "chapters").groupBy("book_id", "chapter_id").agg(F.min("ord").alias("ord")).join(weight, ["book_id", "chapter_id"])
    ch = ch.withColumn("nth", F.row_number().over(Window.partitionBy("book_id").orderBy("ord", "chapter_id")))
    top = ranking.top_k(ch, ["book_id"], [F.desc_nulls_last("w"), F.col("chapter_id")], 3)
    return top.groupBy("book_id").agg(F.count(F.lit(1)).alias("targets"), F.max("nth").alias("furthest")).withColumn("only_opening", F.col("furthest") <= 3)


def concept_chapters_supported(spark, sf):
    """Angles with those chapters of their claims that they also cite, if two
    are left."""
    of = _angle_claims(spark, sf).join(_claims(spark, sf).select("claim_id", "chapter_id"), "claim_id").where("chapter_id is not null").select("angle_id", "chapter_id").distinct()
    cited = _refs(spark, sf).where("owner_kind = 'angle' and ref_type = 'book'").select(F.col("owner_id").alias("angle_id"), "chapter_id").distinct()
    return of.join(cited, ["angle_id", "chapter_id"]).groupBy("angle_id").agg(F.count(F.lit(1)).alias("n"), F.min("chapter_id").alias("first")).where("n >= 2")


def flattened_refs(spark, sf):
    """Every reference of every table as one long table."""
    r = _refs(spark, sf).select(F.col("owner_kind").alias("from_kind"), F.col("owner_id").alias("from_id"), F.lit("block").alias("to_kind"), F.concat_ws("/", "book_id", "block_id").alias("to_id")).where("to_id like '%/%'")
    a = _angle_claims(spark, sf).select(F.lit("angle").alias("from_kind"), F.col("angle_id").alias("from_id"), F.lit("claim").alias("to_kind"), F.col("claim_id").alias("to_id"))
    ends = F.explode(F.array("from_claim_id", "to_claim_id"))
    c = table(spark, sf, "claim_relations").select(F.lit("relation").alias("from_kind"), F.col("relation_id").cast("string").alias("from_id"), F.lit("claim").alias("to_kind"), ends.alias("to_id")).where("to_id is not null")
    return r.unionByName(a).unionByName(c).distinct().groupBy("from_kind", "to_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("to_id").alias("targets"))


def title_fallback(spark, sf):
    """Chapter titles without outer blanks, the id in their stead if empty."""
    ch = table(spark, sf, "chapters").select("book_id", "chapter_id", "title").distinct()
    t = F.nullif(T.collapse("title"), F.lit(""))
    return ch.select("book_id", "chapter_id", F.coalesce(t, F.col("chapter_id")).alias("shown"), t.isNull().alias("warned"))


def boundary_cascade(spark, sf):
    """Where chapters of a book begin: at headings that name a chapter in
    Chinese, else at those that do in another way, else as listed; of
    neighbours on one page the first counts."""
    b = table(spark, sf, "blocks").where("page is not null and original_text is not null").select("book_id", "page", "ord", "block_id", "block_type", "original_text")
    line = T.collapse(F.substring_index("original_text", "\n", 1))
    heads = b.where("block_type = 'heading'").withColumn("line", line)
    zh = heads.where(F.col("line").rlike("^第[一二三四五六七八九十百千万零〇0-9]+章")).select("book_id", F.lit(1).alias("rule"), "page", F.struct("ord", "block_id", "line").alias("x"))
    other = heads.where(F.col("line").rlike("(?i)^(?:\\d+[ .:]|chapter|kapitel|chapitre|capítulo|глава)")).select("book_id", F.lit(2).alias("rule"), "page", F.struct("ord", "block_id", "line").alias("x"))
    listed = table(spark, sf, "chapters").select("book_id", F.lit(3).alias("rule"), F.col("start_page").alias("page"), F.struct(F.col("ord"), F.col("chapter_id").alias("block_id"), F.coalesce("title", F.lit("")).alias("line")).alias("x"))
    every = zh.unionByName(other).unionByName(listed)
    best = every.groupBy("book_id").agg(F.min("rule").alias("rule"))
    starts = every.join(best, ["book_id", "rule"]).groupBy("book_id", "rule", "page").agg(F.min("x").alias("x"))
    return starts.select("book_id", "rule", "page", F.col("x.line").alias("title"))


def comparable_titles(spark, sf):
    """Titles as a table of contents writes them - leaders and page - and as
    they compare: without them, marks and blanks."""
    ch = table(spark, sf, "chapters").where("title is not null").select("book_id", "chapter_id", F.concat("title", F.lit(" ...... "), F.col("start_page").cast("string")).alias("listed")).distinct()
    bare = F.regexp_replace("listed", "\\s*(?:\\.{2,}|…+|·{2,})\\s*\\d+\\s*$", "")
    return ch.select("book_id", "chapter_id", bare.alias("title"), F.regexp_replace(F.lower(bare), "(?U)[\\s\\p{P}\\p{S}]", "").alias("compared"))


def scaled_boxes(spark, sf):
    """Boxes of scanned blocks as pixels of a page of 1240 x 1754 back in
    points, with the y axis turned and three decimals; their confidence in
    0..1."""
    b = table(spark, sf, "blocks").where("bbox is not null and pdf_kind = 'scanned'").groupBy("book_id", "block_id").agg(F.min("bbox").alias("q"), F.min("confidence").alias("c"))
    box = G.flip_scaled(F.col("q"), 1240.0, 1754.0, 595.0, 842.0)
    return b.select("book_id", "block_id", box.alias("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) * 110 / 100)).alias("confidence")).select("book_id", "block_id", "b.*", "confidence")


def transformed_bounds(spark, sf):
    """Bounds of blocks under a turn by 90 degrees after a scale, and which are
    large enough and no whole page."""
    b = table(spark, sf, "blocks").where("bbox is not null").groupBy("book_id", "block_id").agg(F.min("bbox").alias("q"))
    m = G.matrix_product((0.0, 1.0, -1.0, 0.0, 842.0, 0.0), (0.5, 0.0, 0.0, 0.5, 10.0, 20.0))
    j = b.withColumn("t", G.transform_bounds(m, F.col("q")))
    return j.select("book_id", "block_id", *[F.round(f"t.{k}", 6).alias(k) for k in "xywh"], G.is_visual(F.col("t"), 595.0, 842.0).alias("eligible"))


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scenes' texts as parts of their job; the times of its scenes, with what
    is said of them, as boundaries."""
    s = _scenes(spark, sf)
    parts = s.select("job_id", "ord", F.col("voice_text").alias("text"))
    boundaries = s.select("job_id", "ord", F.concat_ws("", "purpose", "visual_type", "transition").alias("text"), F.col("start_ms").alias("offset_ms"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return parts, boundaries


def duration_weighted_times(spark, sf):
    return alignment.by_weight(*_parts(spark, sf), ["job_id"]).select("job_id", "ord", "start_ms", "end_ms")


def boundary_anchored_times(spark, sf):
    return alignment.anchored(*_parts(spark, sf), ["job_id"]).select("job_id", "ord", "start_ms", "end_ms")


def assigned_boundaries(spark, sf):
    """Times of scenes by the words of their own text, as spoken one after
    another at 150 ms a letter, where these agree; else anchored."""
    s = _scenes(spark, sf).where("voice_text is not null")
    words = s.select("job_id", "ord", F.posexplode(F.regexp_extract_all("voice_text", F.lit("[^\\s，。！？；：、,.!?;:]+"), F.lit(0))).alias("pos", "text"))
    w = Window.partitionBy("job_id").orderBy("ord", "pos")
    ms = F.greatest(F.coalesce(T.readable_count("text"), F.lit(0)), F.lit(1)) * 150
    b = words.withColumns({"n": F.row_number().over(w), "duration_ms": ms.cast("long")})
    b = b.withColumn("offset_ms", F.sum("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("duration_ms"))
    out = alignment.assign(s.select("job_id", "ord", F.col("voice_text").alias("text")), b.select("job_id", F.col("n").alias("ord"), "text", "offset_ms", "duration_ms"), ["job_id"])
    return out.select("job_id", "ord", "start_ms", "end_ms", "source")


def reliable_boundaries(spark, sf):
    s = _scenes(spark, sf)
    whole = s.groupBy("job_id").agg(F.max("end_ms").alias("length"), F.array_join(F.sort_array(F.collect_list("purpose")), "").alias("said"))
    return alignment.reliable(_parts(spark, sf)[1], whole, ["job_id"], "length", "said").select("job_id", "length", "reliable")


def phrase_offsets(spark, sf):
    """Scenes of a job spoken one after another, with 70 ms between them."""
    s = _scenes(spark, sf).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    w = Window.partitionBy("job_id").orderBy("ord", "scene_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("job_id", "scene_id", F.coalesce(F.sum(F.col("d") + 70).over(w), F.lit(0)).alias("offset_ms"), F.col("d").alias("duration_ms"))


def speaking_rates(spark, sf):
    """Letters a second of a job, or the usual 4.53 if that lies outside
    3.8..5.2; with the letters for 285, 300 and 315 seconds."""
    s = _scenes(spark, sf).groupBy("job_id").agg(F.sum(F.coalesce(T.readable_count("voice_text"), F.lit(0))).alias("letters"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    seen = F.col("letters") * 1000 / F.nullif("ms", F.lit(0))
    rate = F.when(seen.between(3.8, 5.2), seen).otherwise(4.53)
    return s.select("job_id", F.round(rate, 6).alias("rate"), *[F.floor(rate * n + 0.5).cast("int").alias(f"for_{n}") for n in (285, 300, 315)])


def shot_edges(spark, sf):
    """A job's time in 30 to 45 shots of about seven seconds, and its beats."""
    j = _scenes(spark, sf).groupBy("job_id").agg(F.max("end_ms").alias("d"))
    n = F.greatest(F.lit(30), F.least(F.lit(45), F.floor(F.col("d") / 7000 + 0.5))).cast("int")
    e = j.select("job_id", "d", n.alias("n")).select("job_id", "d", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    edge = lambda i: F.floor(i * F.col("d") / F.col("n") + 0.5).cast("long")
    return e.select("job_id", "i", edge(F.col("i")).alias("start_ms"), edge(F.col("i") + 1).alias("end_ms"), F.col("n").alias("shots"))


def beat_frames(spark, sf):
    """Frames of a scene's beats, as many as it has lines on screen, four at
    most, spread between its begin and end."""
    s = table(spark, sf, "scenes").groupBy("job_id", "scene_id").agg(F.min(F.col("end_ms") - F.col("start_ms")).alias("d"), F.max(F.size("on_screen_text")).alias("k"))
    s = s.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce("k", F.lit(0))))).withColumn("frames", G.frames(F.col("d")))
    return s.select("job_id", "scene_id", F.posexplode(G.beat_frames(F.col("frames"), 30, F.col("k"))).alias("beat", "frame"))


def caption_fade(spark, sf):
    """Opacity and shift of a caption at a third of a scene, and three frames
    before its end."""
    s = _scenes(spark, sf).withColumn("n", G.frames(F.col("end_ms") - F.col("start_ms")))
    both = s.select("job_id", "scene_id", "n", F.explode(F.array(F.floor(F.col("n") / 3), F.col("n") - 3)).alias("frame"))
    return both.select("job_id", "scene_id", "frame", F.round(G.fade(F.col("frame"), F.col("n"))["opacity"], 6).alias("opacity"), F.round(G.fade(F.col("frame"), F.col("n"))["shift"], 6).alias("shift"))


def facts_preserved(spark, sf):
    """Scenes whose numbers, percentages and amounts are the same in the same
    order after the text was made ready to be spoken."""
    s = _scenes(spark, sf).where("voice_text is not null").withColumn("spoken", T.connectives("voice_text"))
    a, b = T.facts("voice_text"), T.facts("spoken")
    return s.select("job_id", "scene_id", F.size(a).alias("facts"), a.eqNullSafe(b).alias("preserved"), (F.col("voice_text") != F.col("spoken")).alias("changed"))


def question_forms(spark, sf):
    """Scene texts that ask, that ask without need, that fill; as a bubble of
    ten letters; with an end mark."""
    s = _scenes(spark, sf).where("voice_text is not null").select("job_id", "scene_id", F.trim("voice_text").alias("t"))
    return s.select(
        "job_id",
        "scene_id",
        F.col("t").rlike("[?？]\\z").alias("asks"),
        F.col("t").rlike("^(?:为什么|那么|所以呢|难道)").alias("mechanical"),
        F.col("t").rlike("(?:总的来说|值得注意的是|不难发现|众所周知)").alias("filler"),
        F.when(F.char_length("t") > 10, F.concat(F.substring("t", 1, 10), F.lit("…"))).otherwise(F.col("t")).alias("bubble"),
        F.when(F.col("t").rlike("[。！？]\\z"), F.col("t")).otherwise(F.concat("t", F.lit("。"))).alias("ended"),
    )


def derived_views(spark, sf):
    """A job's scenes as the views that are made of them - source, script,
    captions, assets - put together as one table of keys and values."""
    s = _scenes(spark, sf)
    view = lambda name, key, value, rows=s: rows.select(F.lit(name).alias("view"), "job_id", key.cast("string").alias("key"), value.cast("string").alias("value"))
    return (
        view("source", F.col("scene_id"), F.md5(F.coalesce("voice_text", F.lit(""))))
        .unionByName(view("script", F.lpad(F.col("ord").cast("string"), 4, "0"), F.col("voice_text"), s.where("voice_text is not null")))
        .unionByName(view("captions", F.col("start_ms"), F.col("end_ms") - F.col("start_ms")))
        .unionByName(view("assets", F.col("visual_type"), F.lit(1)).groupBy("view", "job_id", "key").agg(F.count(F.lit(1)).cast("string").alias("value")))
    )


def upgraded_scenes(spark, sf):
    """Scenes of the older form brought to the newer one: lines on screen from
    emphasis if there are none, six at most; a transition as a cut if it takes
    no time; narration as the text or nothing."""
    cols = ["job_id", "scene_id", "ord", "voice_text", "transition", "transition_ms", "on_screen_text", "emphasis"]
    s = table(spark, sf, "scenes").select(*cols).distinct()
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    lines = F.slice(F.when(F.size(some(F.col("on_screen_text"))) > 0, some(F.col("on_screen_text"))).otherwise(some(F.col("emphasis"))), 1, 6)
    return s.select(
        "job_id",
        "scene_id",
        F.array_join(lines, "|").alias("lines"),
        F.when(F.coalesce("transition_ms", F.lit(0)) == 0, "cut").otherwise(F.coalesce("transition", F.lit("fade"))).alias("kind"),
        F.coalesce("voice_text", F.lit("")).alias("narration"),
        F.when(F.coalesce("voice_text", F.lit("")) == "", "silent").otherwise("spoken").alias("mode"),
    ).distinct()


def listed_metrics(spark, sf):
    """The first numbers of a scene with unit and the label of their place."""
    s = _scenes(spark, sf).where("voice_text is not null")
    m = s.select("job_id", "scene_id", F.posexplode(T.metrics("voice_text")).alias("pos", "m"))
    label = F.element_at(F.array(F.lit("main"), F.lit("second"), F.lit("third")), F.col("pos") + 1)
    return m.select("job_id", "scene_id", label.alias("label"), "m.value", "m.decimals", "m.suffix", T.metric_text(F.col("m.value"), F.col("m.decimals"), F.col("m.suffix")).alias("shown"))


_BODY = "(select book_id, chapter_id, block_id, r.* from (select book_id, chapter_id, block_id, min({'page': page, 'ord': ord, 'block_type': block_type, 'original_text': original_text, 'confidence': confidence}) as r from blocks where chapter_id is not null and block_id is not null group by all))"
_SC = "(select job_id, scene_id, r.* from (select job_id, scene_id, min({'ord': ord, 'start_ms': start_ms, 'end_ms': end_ms, 'purpose': purpose, 'voice_text': voice_text, 'visual_type': visual_type, 'transition': transition, 'transition_ms': transition_ms}) as r from scenes group by all))"
_LET = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_WT = "greatest(coalesce(" + _LET + ", 0), 1)"
_PB = f"p as (select job_id, ord, voice_text as text, {_WT.format('voice_text')} as w from {_SC}), b as (select job_id, ord, start_ms as t0, end_ms as t1, {_WT.format('concat(purpose, visual_type, transition)')} as w from {_SC})"
_PICK = "case when n <= k then true when k <= 1 then position = 0 else position in (select floor(i * (n - 1) / (k - 1) + 0.5) from range(0, cast(k as bigint)) t(i)) end"

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "required_and_spaced_sample": f"""with b as (select *, (book_id, chapter_id, block_id) in (select (book_id, chapter_id, block_id) from {_R} where ref_type = 'book' and owner_kind = 'claim' and block_id is not null and chapter_id is not null) as required from {_BODY}),
r as (select *, greatest(8 - count_if(required) over (partition by book_id, chapter_id), 0) as k from b), x as (select *, row_number() over (partition by book_id, chapter_id order by page nulls first, ord, block_id) - 1 as position, count(*) over (partition by book_id, chapter_id) as n from r where not required and k > 0)
select book_id, chapter_id, block_id, true as required from b where required union all select book_id, chapter_id, block_id, false from x where {_PICK}""",
    "refs_by_need": f"""with x as (select claim_id, ref_id, k, row_number() over (partition by claim_id order by ref_id) - 1 as position, count(*) over (partition by claim_id) as n from (select distinct ref_id, owner_id as claim_id from {_R} where owner_kind = 'claim') join (select claim_id, least(6, 1 + coalesce(len(applies_to), 0)) as k from {_CL}) using (claim_id))
select claim_id, ref_id, k from x where {_PICK}""",
    "budgeted_chapter_sample": f"""with b as (select *, coalesce(length(original_text), 0) as size, coalesce(block_type = 'heading', false) as keep from {_BODY}), s as (select book_id, chapter_id, sum(size) as total, coalesce(sum(size) filter (keep), 0) as kept, cast(count_if(not keep) as bigint) as n from b group by all),
l as (select *, greatest(1, 1500 - kept) as room, cast(least(n, greatest(2, floor(n * greatest(1, 1500 - kept) / greatest(total - kept, 1)))) as bigint) as k from s where total > 1500),
body as (select *, row_number() over (partition by book_id, chapter_id order by page nulls first, ord, block_id) - 1 as pos from b where not keep),
t as (select *, unnest(range(least(k, 2), k + 1)) as try from l), a as (select book_id, chapter_id, try, room, unnest(list_transform(range(0, try), lambda i: floor(i * (n - 1) / greatest(try - 1, 1) + 0.5))) as pos from t where try > 0),
g as (select book_id, chapter_id, try, room, sum(size) as s from a join body using (book_id, chapter_id, pos) group by all), m as (select book_id, chapter_id, max(try) as try from g where s <= room or try <= 2 group by all)
select book_id, chapter_id, block_id, size from b where keep or (book_id, chapter_id) not in (select (book_id, chapter_id) from l)
union all select book_id, chapter_id, block_id, size from body where (book_id, chapter_id, pos) in (select (book_id, chapter_id, pos) from a join m using (book_id, chapter_id, try))""",
    "reading_order": "select book_id, page, block_id, row_number() over (partition by book_id, page order by floor(q.y / 10 + 0.5) desc, q.x, block_id) as nth from (select book_id, page, block_id, min(bbox) as q from blocks where bbox is not null and page is not null group by all)",
    "front_matter_inserted": f"with s as (select book_id, chapter_id, min(page) as start_page from {_BODY} where page is not null group by all) select * from s union all select book_id, 'front-matter', 1 from s group by 1 having min(start_page) > 1",
    "targets_within_opening": f"""with w as (select book_id, chapter_id, avg(importance.score) as w from {_CL} where chapter_id is not null group by all), c as (select *, row_number() over (partition by book_id order by ord, chapter_id) as nth from (select book_id, chapter_id, min(ord) as ord from chapters group by all) join w using (book_id, chapter_id)),
t as (select *, row_number() over (partition by book_id order by w desc nulls last, chapter_id) as rank from c) select book_id, count(*) as targets, max(nth) as furthest, max(nth) <= 3 as only_opening from t where rank <= 3 group by 1""",
    "concept_chapters_supported": f"""select angle_id, count(*) as n, min(chapter_id) as first from (select distinct angle_id, chapter_id from (select angle_id, unnest(core_claim_ids) as claim_id from angles) join (select claim_id, chapter_id from {_CL}) using (claim_id) where chapter_id is not null
intersect select owner_id, chapter_id from {_R} where owner_kind = 'angle' and ref_type = 'book') group by 1 having count(*) >= 2""",
    "flattened_refs": f"""with x as (select owner_kind as from_kind, owner_id as from_id, 'block' as to_kind, concat_ws('/', book_id, block_id) as to_id from {_R} where book_id is not null and block_id is not null
union select 'angle', angle_id, 'claim', c from (select angle_id, unnest(core_claim_ids) as c from angles) where c is not null union select 'relation', cast(relation_id as varchar), 'claim', c from (select relation_id, unnest([from_claim_id, to_claim_id]) as c from claim_relations) where c is not null)
select from_kind, to_kind, count(*) as n, count(distinct to_id) as targets from x group by all""",
    "title_fallback": r"with c as (select distinct book_id, chapter_id, nullif(trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')), '') as t from chapters) select book_id, chapter_id, coalesce(t, chapter_id) as shown, t is null as warned from c",
    "boundary_cascade": r"""with h as (select book_id, page, ord, block_id, trim(regexp_replace(split_part(original_text, chr(10), 1), '[\s\p{Z}]+', ' ', 'g')) as line from blocks where block_type = 'heading' and page is not null and original_text is not null),
e as (select book_id, 1 as rule, page, {'a': ord, 'b': block_id, 'line': line} as x from h where regexp_matches(line, '^第[一二三四五六七八九十百千万零〇0-9]+章')
union all select book_id, 2, page, {'a': ord, 'b': block_id, 'line': line} from h where regexp_matches(line, '(?i)^(?:\d+[ .:]|chapter|kapitel|chapitre|capítulo|глава)')
union all select book_id, 3, start_page, {'a': ord, 'b': chapter_id, 'line': coalesce(title, '')} from chapters)
select book_id, rule, page, min(x).line as title from e where (book_id, rule) in (select (book_id, min(rule)) from e group by book_id) group by book_id, rule, page""",
    "comparable_titles": r"select distinct book_id, chapter_id, title, regexp_replace(lower(title), '[\s\p{Z}\p{P}\p{S}]', '', 'g') as compared from chapters where title is not null",
    "scaled_boxes": """with b as (select book_id, block_id, min(bbox) as q, min(confidence) as c from blocks where bbox is not null and pdf_kind = 'scanned' group by all)
select book_id, block_id, floor(q.x * (595.0::double / 1240.0) * 1000 + 0.5) / 1000 as x, floor((842.0::double - (q.y + q.h) * (842.0::double / 1754.0)) * 1000 + 0.5) / 1000 as y, floor(q.w * (595.0::double / 1240.0) * 1000 + 0.5) / 1000 as w, floor(q.h * (842.0::double / 1754.0) * 1000 + 0.5) / 1000 as h, case when c is null then 0.0 else greatest(0.0, least(1.0, c * 110 / 100)) end as confidence from b""",
    "transformed_bounds": """with b as (select book_id, block_id, min(bbox) as q from blocks where bbox is not null group by all),
t as (select book_id, block_id, 842.0 - (0.5 * q.y + 20.0 + 0.5 * q.h) as x, 0.5 * q.x + 10.0 as y, 0.5 * q.h as w, 0.5 * q.w as h from b)
select book_id, block_id, round(x, 6) as x, round(y, 6) as y, round(w, 6) as w, round(h, 6) as h, w > 0 and h > 0 and w * h >= 400 and w * h < 0.8 * 595.0 * 842.0 as eligible from t""",
    "duration_weighted_times": f"""with {_PB}, s as (select job_id, arg_min(t0, ord) as a, arg_max(t1, ord) as z from b group by 1), q as (select p.*, a, z, cast(floor((z - a) * w / sum(w) over (partition by p.job_id) + 0.5) as bigint) as step from p join s using (job_id)),
r as (select *, sum(step) over (partition by job_id order by ord rows unbounded preceding) as upto, ord = max(ord) over (partition by job_id) as is_last from q) select job_id, ord, cast(a + upto - step as bigint) as start_ms, cast(case when is_last then z else a + upto end as bigint) as end_ms from r""",
    "boundary_anchored_times": f"""with {_PB}, c as (select *, sum(w) over (partition by job_id order by ord rows unbounded preceding)::double as hi from b), k as (select *, hi - w as lo, max(hi) over (partition by job_id) as every from c),
d as (select job_id, any_value(every) as every, arg_min(t0, ord) as a, arg_max(t1, ord) as z from k group by 1), u as (select *, sum(w) over (partition by job_id order by ord rows unbounded preceding) as p1, sum(w) over (partition by job_id) as total from p),
x as (select u.job_id, u.ord, (p1 - u.w) / total * every as s0, p1 / total * every as s1, every, a, z from u join d using (job_id)),
y as (select x.*, arg_min(floor(f.t0 + (f.t1 - f.t0) * greatest(0.0, least(1.0, (s0 - f.lo) / greatest(1.0, f.hi - f.lo))) + 0.5), f.hi) as m from x left join k f on f.job_id = x.job_id and s0 < f.hi group by all),
v as (select y.*, arg_min(floor(g.t0 + (g.t1 - g.t0) * greatest(0.0, least(1.0, (s1 - g.lo) / greatest(1.0, g.hi - g.lo))) + 0.5), g.hi) as n from y left join k g on g.job_id = y.job_id and s1 <= g.hi group by all),
o as (select job_id, ord, cast(case when s0 <= 0 then a when s0 >= every then z else m end as bigint) as start_ms, cast(case when s1 <= 0 then a when s1 >= every then z else n end as bigint) as e from v) select job_id, ord, start_ms, greatest(start_ms + 1, e) as end_ms from o""",
    "reliable_boundaries": f"""with s as (select *, coalesce(lag(end_ms) over (partition by job_id order by ord), -1) as before from {_SC}), g as (select job_id, max(end_ms) as length, bool_or(start_ms < 0 or end_ms <= start_ms or start_ms < before - 80) as bad, sum({_LET.format("concat(purpose, visual_type, transition)")}) as n, sum(coalesce({_LET.format("purpose")}, 0)) as said from s group by 1)
select job_id, length, coalesce(not bad and said > 0 and n / said >= 0.72, false) as reliable from g""",
    "phrase_offsets": f"select job_id, scene_id, cast(coalesce(sum(end_ms - start_ms + 70) over (partition by job_id order by ord, scene_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ms, end_ms - start_ms as duration_ms from {_SC}",
    "speaking_rates": f"""with s as (select job_id, sum(coalesce({_LET.format("voice_text")}, 0)) * 1000 / nullif(sum(end_ms - start_ms), 0) as seen from {_SC} group by 1), r as (select job_id, case when seen between 3.8 and 5.2 then seen else 4.53::double end as rate from s)
select job_id, round(rate, 6) as rate, cast(floor(rate * 285 + 0.5) as int) as for_285, cast(floor(rate * 300 + 0.5) as int) as for_300, cast(floor(rate * 315 + 0.5) as int) as for_315 from r""",
    "shot_edges": f"""with j as (select job_id, max(end_ms) as d, greatest(30, least(45, cast(floor(max(end_ms) / 7000 + 0.5) as int))) as n from {_SC} group by 1), e as (select *, unnest(range(0, n)) as i from j)
select job_id, i, cast(floor(i * d / n + 0.5) as bigint) as start_ms, cast(floor((i + 1) * d / n + 0.5) as bigint) as end_ms, n as shots from e""",
    "beat_frames": """with s as (select job_id, scene_id, cast(floor(min(end_ms - start_ms) * 30 / 1000 + 0.5) as bigint) as n, greatest(1, least(4, coalesce(max(len(on_screen_text)), 0))) as k from scenes group by all), f as (select *, greatest(k, n) as m from s),
g as (select *, least(11, cast(floor(m / (k + 1)) as bigint)) as a from f), h as (select *, greatest(a, m - least(24, cast(floor(m / (k + 1)) as bigint))) as z from g), e as (select *, unnest(range(0, k)) as beat from h)
select job_id, scene_id, beat, cast(case when k = 1 then a else floor(a + (z - a) * beat / (k - 1) + 0.5) end as bigint) as frame from e""",
    "caption_fade": f"""with s as (select job_id, scene_id, cast(floor((end_ms - start_ms) * 30 / 1000 + 0.5) as bigint) as n from {_SC}), e as (select *, unnest([cast(floor(n / 3) as bigint), n - 3]) as frame from s)
select job_id, scene_id, frame, round(least(greatest(0.0, least(1.0, frame / 8)), greatest(0.0, least(1.0, (n - frame - 1) / 6))), 6) as opacity, round(24 * (1 - greatest(0.0, least(1.0, frame / 8))), 6) as shift from e""",
    "facts_preserved": f"""with s as (select job_id, scene_id, voice_text as t, replace(replace(replace(voice_text, '因此', '所以'), '此外', '另外'), '然而', '但') as p from {_SC} where voice_text is not null),
f as (select *, regexp_extract_all(t, '[¥￥$€]?[0-9]+(?:[.,][0-9]+)*(?:%|万元|亿元|元|万|亿)?') as a, regexp_extract_all(p, '[¥￥$€]?[0-9]+(?:[.,][0-9]+)*(?:%|万元|亿元|元|万|亿)?') as b from s) select job_id, scene_id, len(a) as facts, a = b as preserved, t <> p as changed from f""",
    "question_forms": f"""with s as (select job_id, scene_id, trim(voice_text, ' ') as t from {_SC} where voice_text is not null) select job_id, scene_id, regexp_matches(t, '[?？]$') as asks, regexp_matches(t, '^(?:为什么|那么|所以呢|难道)') as mechanical, regexp_matches(t, '(?:总的来说|值得注意的是|不难发现|众所周知)') as filler,
case when length(t) > 10 then substr(t, 1, 10) || '…' else t end as bubble, case when regexp_matches(t, '[。！？]$') then t else t || '。' end as ended from s""",
    "derived_views": f"""with s as (select * from {_SC}) select 'source' as view, job_id, scene_id as key, md5(coalesce(voice_text, '')) as value from s union all select 'script', job_id, lpad(cast(ord as varchar), 4, '0'), voice_text from s where voice_text is not null
union all select 'captions', job_id, cast(start_ms as varchar), cast(end_ms - start_ms as varchar) from s union all select 'assets', job_id, visual_type, cast(count(*) as varchar) from s group by job_id, visual_type""",
    "upgraded_scenes": """with s as (select *, list_filter(coalesce(on_screen_text, []), lambda x: x is not null and x <> '') as o, list_filter(coalesce(emphasis, []), lambda x: x is not null and x <> '') as m from scenes)
select distinct job_id, scene_id, coalesce(array_to_string(list_slice(case when len(o) > 0 then o else m end, 1, 6), '|'), '') as lines, case when coalesce(transition_ms, 0) = 0 then 'cut' else coalesce(transition, 'fade') end as kind, coalesce(voice_text, '') as narration, case when coalesce(voice_text, '') = '' then 'silent' else 'spoken' end as mode from s""",
}

"""Queries of the text functions and similarity operators, with their SQL.

Names of texts used below: claims, blocks and scenes of the test tables;
redelivered rows are made distinct first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.layout import lines_from_items
from quirefold.operators.ranking import best_per_key
from quirefold.operators.similarity import best_match, greedy_novelty, near_pairs, with_features
from quirefold.session import table


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("book_id", "claim_id", "chapter_id", "statement", "applies_to", "does_not_apply_to").where("statement is not null and claim_id is not null").dropDuplicates(["claim_id", "statement"])


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "blocks").select("book_id", "block_id", "chapter_id", "page", "ord", "block_type", "pdf_kind", "original_text", "confidence").where("original_text is not null").distinct()


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scenes").select("job_id", "scene_id", "ord", "purpose", "voice_text").where("voice_text is not null").distinct()


def language_script_detect(spark, sf):
    b = _blocks(spark, sf)
    return b.select(T.detect_script_language("original_text").alias("script_language")).groupBy("script_language").agg(F.count(F.lit(1)).alias("n"))


def native_text_reliability(spark, sf):
    b = _blocks(spark, sf)
    return b.select("book_id", "block_id", T.readable_count("original_text").alias("readable"), T.invalid_count("original_text").alias("invalid"), T.is_reliable("original_text").alias("reliable"))


def blocks_classified(spark, sf):
    b = _blocks(spark, sf)
    return b.groupBy("block_type", T.block_kind("original_text").alias("kind"), F.coalesce(T.caption_kind("original_text"), F.lit("none")).alias("caption")).agg(F.count(F.lit(1)).alias("n"))


def text_normalize(spark, sf):
    return _claims(spark, sf).select("claim_id", "statement", T.normalize("statement").alias("normalized"))


def numeric_tokens(spark, sf):
    c = _claims(spark, sf).withColumn("numbers", T.numeric_tokens("statement"))
    return c.where(F.size("numbers") > 0).select("claim_id", F.array_join("numbers", "|").alias("numbers"), F.size("numbers").alias("n"))


def bigram_features(spark, sf):
    c = with_features(_claims(spark, sf), "statement")
    return c.select("claim_id", F.explode("grams").alias("gram")).distinct()


def _cited(spark, sf):
    """Claims with the blocks that they cite."""
    refs = table(spark, sf, "source_refs").where("ref_type = 'book' and owner_kind = 'claim'").select("book_id", F.col("owner_id").alias("claim_id"), "block_id").distinct()
    c = _claims(spark, sf).select("book_id", "claim_id", "statement", T.features("statement").alias("grams"))
    b = _blocks(spark, sf).select("book_id", "block_id", "original_text", T.features("original_text").alias("block_grams"))
    return c.join(refs, ["book_id", "claim_id"]).join(b, ["book_id", "block_id"])


def claim_evidence_coverage(spark, sf):
    return _cited(spark, sf).groupBy("claim_id").agg(F.round(F.max(T.coverage("grams", "block_grams")), 6).alias("best"), F.count(F.lit(1)).alias("cited"))


def support_grade(spark, sf):
    pairs = _cited(spark, sf)
    mismatch = (T.collapse("original_text") == "") | T.numbers_missing("statement", "original_text") | T.negation_differs("statement", "original_text")
    graded = pairs.select("claim_id", "statement", "block_id", "original_text", T.grade(T.coverage("grams", "block_grams"), mismatch).alias("grade"))
    return graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def best_evidence_block(spark, sf):
    """For every claim the block of its chapter that covers most of it."""
    c = with_features(_claims(spark, sf), "statement").withColumn("cid", F.concat_ws("~", "claim_id", F.md5("statement")))
    b = table(spark, sf, "blocks").select("book_id", "chapter_id", "block_id", "original_text").where("original_text is not null")
    b = with_features(b, "original_text").withColumn("bid", F.concat_ws("~", "block_id", F.md5("original_text")))
    best = best_match(c.where("chapter_id is not null"), b.where("chapter_id is not null"), ["book_id", "chapter_id"], "cid", "bid")
    return best.select("book_id", "chapter_id", F.split("cid", "~")[0].alias("claim_id"), F.split("bid", "~")[0].alias("block_id"), F.round("score", 6).alias("score"))


def dice_near_duplicates(spark, sf):
    """Statements of one book with a Dice value of 0.8 or more, by distinct
    normalised statement."""
    c = _claims(spark, sf).withColumn("key", T.normalize("statement")).where("char_length(key) >= 2").select("book_id", "key").distinct()
    pairs = near_pairs(c.withColumn("grams", T.bigrams("key")), ["book_id"], "key", 0.8)
    return pairs.select("book_id", "key_a", "key_b", F.round("dice", 6).alias("dice"))


def causal_relations(spark, sf):
    r = _claims(spark, sf).withColumn("r", T.causal_relation("statement"))
    return r.select("claim_id", "statement", F.col("statement").rlike(T.CAUSAL).alias("is_causal"), F.col("r.cause").alias("cause"), F.col("r.effect").alias("effect"))


def scope_predicates(spark, sf):
    c = _claims(spark, sf)
    some = lambda a, p: F.exists(F.coalesce(F.col(a), F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(p), F.lit(False)))
    lacks = F.exists(F.coalesce("does_not_apply_to", F.array().cast("array<string>")), lambda x: F.coalesce(~x.rlike(T.BOUNDARY), F.lit(False)))
    return c.select("claim_id", "statement", T.is_fragment("statement").alias("fragment"), F.col("statement").rlike(T.HEDGES).alias("hedged"), some("applies_to", T.UNIVERSAL).alias("universal"), lacks.alias("boundary_unclear")).distinct()


def chapter_numbers(spark, sf):
    """Numbers parsed from titles that begin with a chapter's number, in
    digits or in Chinese numerals up to 999, by turns."""
    ch = table(spark, sf, "chapters").select("book_id", "chapter_id", "ord", "title").distinct()
    n = F.col("ord") * 37 % 999 + 1
    digit = lambda x: F.substring(F.lit("一二三四五六七八九"), x.cast("int"), F.lit(1))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    tens = F.when((t == 1) & (h == 0), "十").when(t > 0, F.concat(digit(t), F.lit("十"))).when((h > 0) & (u > 0), "零").otherwise("")
    words = F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), tens, F.when(u > 0, digit(u)).otherwise(""))
    named = F.when(F.col("ord") % 3 == 0, n.cast("string")).otherwise(words)
    marked = ch.withColumn("marked", F.concat(F.lit("第"), named, F.lit("章 "), F.coalesce("title", F.lit(""))))
    return marked.withColumn("p", T.chapter_prefix("marked")).select("book_id", "chapter_id", "title", F.col("p.marker").alias("marker"), F.col("p.number").alias("number"), F.col("p.suffix").alias("suffix"))


def whitespace_collapse(spark, sf):
    return _scenes(spark, sf).select("job_id", "scene_id", T.collapse("voice_text").alias("text"))


def caption_segmentation(spark, sf):
    s = _scenes(spark, sf)
    return s.select("job_id", "scene_id", F.posexplode(T.caption_segments("voice_text")).alias("seg_no", "segment")).distinct()


def visual_beats(spark, sf):
    """Texts cut at marks from 10 letters on, or at 16; a rest without letters
    joins the piece before."""
    s = _scenes(spark, sf).withColumn("f", T.fold_pieces("voice_text", "[，。！？；：]", 16, None, 10))
    joins = (F.col("f.n") == 0) & (F.size("f.done") > 0)
    last = F.concat(F.element_at("f.done", -1), F.col("f.rest"))
    head = F.slice("f.done", 1, F.greatest(F.size("f.done") - 1, F.lit(0)))
    pieces = F.when(F.col("f.rest") == "", F.col("f.done")).when(joins, F.concat(head, F.array(last))).otherwise(F.concat("f.done", F.array("f.rest")))
    return s.select("job_id", "scene_id", F.posexplode(pieces).alias("beat_no", "beat")).distinct()


def caption_two_line_layout(spark, sf):
    t = table(spark, sf, "chapters").select("title").where("title is not null").distinct()
    lines = t.withColumn("l", T.two_lines("title")).where("l is not null")
    return lines.select("title", F.element_at("l", 1).alias("line_1"), F.when(F.size("l") > 1, F.element_at("l", 2)).otherwise("").alias("line_2"))


def metric_extraction(spark, sf):
    return _claims(spark, sf).select("claim_id", "statement", F.posexplode(T.metrics("statement")).alias("pos", "m")).select("claim_id", "pos", "m.value", "m.decimals", "m.suffix").distinct()


def visual_terms(spark, sf):
    s = _scenes(spark, sf)
    return s.select("job_id", "scene_id", F.array_join(T.visual_terms("voice_text", 3), "|").alias("terms")).distinct()


def spoken_text(spark, sf):
    return _scenes(spark, sf).select("job_id", "scene_id", T.spoken("voice_text").alias("spoken")).distinct()


def slug_ids(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.slug("s_name").alias("slug"))


def repeated_statement_owner(spark, sf):
    """Statements said before in another chapter, with the chapter that said
    them first."""
    c = _claims(spark, sf).withColumn("norm", T.normalize("statement")).where("norm <> ''")
    first = c.groupBy("norm").agg(F.min(F.struct("book_id", "chapter_id", "claim_id")).alias("first"))
    return c.join(first, "norm").where(~F.col("first.chapter_id").eqNullSafe(F.col("chapter_id"))).select("claim_id", "statement", "chapter_id", F.col("first.chapter_id").alias("owner")).distinct()


def best_statement_per_key(spark, sf):
    """Of equal normalised statements the one of the least claim."""
    c = _claims(spark, sf).withColumn("norm", T.normalize("statement")).where("norm <> ''")
    return best_per_key(c, ["norm"], [F.col("claim_id")]).select("norm", "claim_id")


def short_hooks(spark, sf):
    s = _scenes(spark, sf).select("job_id", "scene_id", "voice_text", T.short_hook("voice_text").alias("h"))
    return s.select("job_id", "scene_id", F.element_at("h", 1).alias("head"), F.element_at("h", 2).alias("rest")).distinct()


def emphasis_tokens(spark, sf):
    """Scene texts cut at their emphasised words."""
    s = table(spark, sf, "scenes").select("job_id", "scene_id", "voice_text", "emphasis").where("voice_text is not null and emphasis is not null").distinct()
    words = F.filter("emphasis", lambda x: x.isNotNull() & (x != ""))
    return s.select("job_id", "scene_id", F.posexplode(T.emphasis_tokens("voice_text", words)).alias("pos", "t")).select("job_id", "scene_id", "pos", "t.text", "t.strong").distinct()


def spoken_lists(spark, sf):
    return _blocks(spark, sf).where("block_type = 'list'").select("book_id", "block_id", T.spoken_list("original_text").alias("spoken")).distinct()


def greedy_novelty_filter(spark, sf):
    """Statements of a book without those much like one kept before."""
    c = _claims(spark, sf).withColumn("norm", T.normalize("statement")).where("char_length(norm) >= 2").groupBy("book_id", "norm").agg(F.min("claim_id").alias("first_id"))
    nodes = c.withColumn("key", F.concat_ws("/", "book_id", "norm"))
    pairs = near_pairs(nodes.withColumn("grams", T.bigrams("norm")), ["book_id"], "key", 0.8)
    return greedy_novelty(nodes, pairs, "key", "first_id").select("book_id", "norm", "first_id")


def page_lines(spark, sf):
    """Blocks of a page whose tops lie within two points as one line."""
    b = table(spark, sf, "blocks").where("bbox is not null").groupBy("book_id", "page", "block_id").agg(F.min("bbox").alias("q"))
    items = b.select("book_id", "page", F.col("block_id").alias("text"), F.col("q.x").alias("x"), F.col("q.y").alias("y"), F.col("q.w").alias("width"), F.col("q.h").alias("height"))
    return lines_from_items(items, ["book_id", "page"]).select("book_id", "page", "line_no", "text", F.round("x2", 6).alias("x2"))


_C = "(select distinct book_id, claim_id, chapter_id, statement from claims where statement is not null and claim_id is not null)"
_B = "(select distinct book_id, block_id, chapter_id, page, ord, block_type, pdf_kind, original_text, confidence from blocks where original_text is not null)"
_S = "(select distinct job_id, scene_id, ord, purpose, voice_text from scenes where voice_text is not null)"
_H = "translate(replace(replace({0}, '…', '...'), chr(3635), chr(3661) || chr(3634)), '！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～　', '!\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{{|}}~ ')"
_N = "regexp_replace(lower(" + _H + r"), '[\s\p{{Z}}\p{{P}}\p{{S}}\x{{1c}}-\x{{1f}}\x{{85}}]', '', 'g')"
_G = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"


def _norm(c: str) -> str:
    return _N.format(c)


_NUM = "regexp_extract_all(" + _H + r", '[0-9]+(?:\.[0-9]+)?%?')"
_WORDS = "regexp_extract_all(lower(" + _H + r"), '[a-z]{{3,}}|[0-9]+(?:\.[0-9]+)?%?')"
_CITED = f"""
with c as (select book_id, claim_id, statement, list_distinct(list_concat({_G.format("n")}, {_WORDS.format("statement")})) as g from (select *, {_norm("statement")} as n from {_C})),
b as (select book_id, block_id, original_text, list_distinct(list_concat({_G.format("n")}, {_WORDS.format("original_text")})) as h from (select *, {_norm("original_text")} as n from {_B})),
r as (select distinct book_id, owner_id as claim_id, block_id from source_refs where ref_type = 'book' and owner_kind = 'claim'),
p as (select c.claim_id, c.statement, b.block_id, b.original_text,
  case when len(g) > 0 then len(list_intersect(g, h)) / len(g) else 0.0 end as score from c join r using (book_id, claim_id) join b using (book_id, block_id))
"""

QUERIES = {
    f.__name__: f
    for f in (
        language_script_detect,
        native_text_reliability,
        blocks_classified,
        text_normalize,
        numeric_tokens,
        bigram_features,
        claim_evidence_coverage,
        support_grade,
        best_evidence_block,
        dice_near_duplicates,
        causal_relations,
        scope_predicates,
        chapter_numbers,
        whitespace_collapse,
        caption_segmentation,
        visual_beats,
        caption_two_line_layout,
        metric_extraction,
        visual_terms,
        spoken_text,
        slug_ids,
        repeated_statement_owner,
        best_statement_per_key,
        short_hooks,
        emphasis_tokens,
        spoken_lists,
        greedy_novelty_filter,
        page_lines,
    )
}
SQL = {
    "language_script_detect": rf"""select case when regexp_matches(original_text, '[\x{{3040}}-\x{{30ff}}]') then 'ja' when regexp_matches(original_text, '\p{{Han}}') then 'zh-CN'
when regexp_matches(original_text, '\p{{Latin}}') then 'en' else 'und' end as script_language, count(*) as n from {_B} group by all""",
    "native_text_reliability": rf"""select book_id, block_id, length(regexp_replace(original_text, '[^\p{{L}}\p{{N}}]', '', 'g')) as readable,
length(regexp_replace(original_text, '[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{fffd}}]', '', 'g')) as invalid,
length(regexp_replace(original_text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 4 and length(regexp_replace(original_text, '[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{fffd}}]', '', 'g')) / greatest(length(original_text), 1) <= 0.1 as reliable from {_B}""",
    "blocks_classified": rf"""select block_type, case when regexp_matches(original_text, '(?i)^(?:chapter\s+(?:\d+|[ivxlcdm]+)\b|第[一二三四五六七八九十百千万零〇0-9]+章)') then 'heading'
when regexp_matches(original_text, '^(?:[-*•]|\d+[.)])\s+') then 'list' else 'paragraph' end as kind,
case when regexp_matches(original_text, '(?i)^(?:table\b|表(?:格|\s|\d)|表格)') then 'table' when regexp_matches(original_text, '(?i)^(?:chart\b|graph\b|图表|グラフ)') then 'chart'
when regexp_matches(original_text, '(?i)^(?:diagram\b|流程图|示意图|ダイアグラム)') then 'diagram' else 'none' end as caption, count(*) as n from {_B} group by all""",
    "text_normalize": f"select claim_id, statement, {_norm('statement')} as normalized from {_C}",
    "numeric_tokens": f"select claim_id, array_to_string(t, '|') as numbers, len(t) as n from (select claim_id, {_NUM.format('statement')} as t from {_C}) where len(t) > 0",
    "bigram_features": f"select distinct claim_id, unnest({_G.format('n')}) as gram from (select claim_id, {_norm('statement')} as n from {_C})",
    "claim_evidence_coverage": _CITED + "select claim_id, round(max(score), 6) as best, count(*) as cited from p group by 1",
    "support_grade": _CITED
    + f"""select case when exists_missing or neg then 'unsupported' when score >= 0.28 then 'strong' when score >= 0.16 then 'partial' when score >= 0.07 then 'weak' else 'unsupported' end as grade, count(*) as n
from (select *, len(list_filter({_NUM.format('statement')}, lambda x: not list_contains({_NUM.format('original_text')}, x))) > 0 as exists_missing,
regexp_matches(statement, '{T.NEGATION}') <> regexp_matches(original_text, '{T.NEGATION}') as neg from p) group by 1""",
    "best_evidence_block": f"""with c as (select distinct book_id, chapter_id, claim_id || '~' || md5(statement) as cid, {_G.format("n")} as g from (select *, {_norm("statement")} as n from {_C}) where chapter_id is not null),
b as (select distinct book_id, chapter_id, block_id || '~' || md5(original_text) as bid, {_G.format("n")} as h from (select *, {_norm("original_text")} as n from {_B}) where chapter_id is not null),
e as (select book_id, chapter_id, cid, len(g) as size, unnest(g) as gram from c), f as (select book_id, chapter_id, bid, unnest(h) as gram from b),
s as (select book_id, chapter_id, cid, bid, count(*) / max(size) as score from e join f using (book_id, chapter_id, gram) group by all)
select book_id, chapter_id, split_part(cid, '~', 1) as claim_id, split_part(bid, '~', 1) as block_id, round(score, 6) as score from s
qualify row_number() over (partition by book_id, chapter_id, cid order by score desc, bid) = 1""",
    "dice_near_duplicates": f"""with c as (select distinct book_id, {_norm("statement")} as k from {_C}), d as (select book_id, k, {_G.format("k")} as g from c where length(k) >= 2)
select a.book_id, a.k as key_a, b.k as key_b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) as dice from d a join d b on a.book_id = b.book_id and a.k < b.k
where 2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.8 - 1e-12""",
    "causal_relations": f"""select claim_id, statement, regexp_matches(statement, '{T.CAUSAL}') as is_causal,
case when regexp_matches(statement, '{"^(.{2,120}?)(?:" + T.CAUSES + ")(.{2,120})$"}') then regexp_extract(statement, '{"^(.{2,120}?)(?:" + T.CAUSES + ")(.{2,120})$"}', 1)
 when regexp_matches(statement, '{"^(.{2,120}?)(?:" + T.CAUSED_BY + ")(.{2,120})$"}') then regexp_extract(statement, '{"^(.{2,120}?)(?:" + T.CAUSED_BY + ")(.{2,120})$"}', 2)
 when regexp_matches(statement, '{"(?:" + T.BECAUSE + ")(.{2,120}?)(?:" + T.THEREFORE + ")(.{2,120})$"}') then regexp_extract(statement, '{"(?:" + T.BECAUSE + ")(.{2,120}?)(?:" + T.THEREFORE + ")(.{2,120})$"}', 1) end as cause,
case when regexp_matches(statement, '{"^(.{2,120}?)(?:" + T.CAUSES + ")(.{2,120})$"}') then regexp_extract(statement, '{"^(.{2,120}?)(?:" + T.CAUSES + ")(.{2,120})$"}', 2)
 when regexp_matches(statement, '{"^(.{2,120}?)(?:" + T.CAUSED_BY + ")(.{2,120})$"}') then regexp_extract(statement, '{"^(.{2,120}?)(?:" + T.CAUSED_BY + ")(.{2,120})$"}', 1)
 when regexp_matches(statement, '{"(?:" + T.BECAUSE + ")(.{2,120}?)(?:" + T.THEREFORE + ")(.{2,120})$"}') then regexp_extract(statement, '{"(?:" + T.BECAUSE + ")(.{2,120}?)(?:" + T.THEREFORE + ")(.{2,120})$"}', 2) end as effect from {_C}""",
    "scope_predicates": f"""select distinct claim_id, statement, length(trim(statement)) < 8 or regexp_matches(trim(statement), '{T.FRAGMENT_START}') or regexp_matches(trim(statement), '{T.FRAGMENT_END}') as fragment,
regexp_matches(statement, '{T.HEDGES}') as hedged, len(list_filter(coalesce(applies_to, []), lambda x: regexp_matches(x, '{T.UNIVERSAL}'))) > 0 as universal,
len(list_filter(coalesce(does_not_apply_to, []), lambda x: not regexp_matches(x, '{T.BOUNDARY}'))) > 0 as boundary_unclear from claims where statement is not null and claim_id is not null""",
    "chapter_numbers": r"""select book_id, chapter_id, title, '第' || case when ord % 3 = 0 then cast(ord * 37 % 999 + 1 as varchar) else case when h > 0 then substr(d, h, 1) || '百' else '' end ||
case when t = 1 and h = 0 then '十' when t > 0 then substr(d, t, 1) || '十' when h > 0 and u > 0 then '零' else '' end || case when u > 0 then substr(d, u, 1) else '' end end || '章' as marker, ord * 37 % 999 + 1 as number, trim(regexp_replace(coalesce(title, ''), '[\s\p{Z}]+', ' ', 'g')) as suffix
from (select *, (ord * 37 % 999 + 1) // 100 as h, (ord * 37 % 999 + 1) // 10 % 10 as t, (ord * 37 % 999 + 1) % 10 as u, '一二三四五六七八九' as d from (select distinct book_id, chapter_id, ord, title from chapters))""",
    "whitespace_collapse": rf"select job_id, scene_id, trim(regexp_replace(voice_text, '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+', ' ', 'g')) as text from {_S}",
    "caption_two_line_layout": r"""with t as (select distinct title, trim(title) as x from chapters where title is not null),
c as (select title, x, length(x) as n, list_filter(range(3, 11), lambda i: i <= length(x) and regexp_matches(substr(x, i, 1), '[，。！？；：、]') and length(x) - i <= 10) as cuts from t where length(x) <= 20),
d as (select *, case when len(cuts) > 0 then list_sort(list_transform(cuts, lambda i: {'d': abs(i - n / 2), 'i': i}))[1].i else 10 end as cut from c)
select title, case when n <= 10 then x else substr(x, 1, cut) end as line_1, case when n <= 10 then '' else substr(x, cut + 1) end as line_2 from d""",
    "metric_extraction": rf"""with m as (select distinct claim_id, statement, regexp_extract_all(statement, '([0-9]+(?:\.[0-9]+)?)\s*(万元|万|%|元)?')[1:3] as hits from {_C}),
e as (select claim_id, unnest(hits) as hit, generate_subscripts(hits, 1) - 1 as pos from m)
select distinct claim_id, pos, cast(regexp_extract(hit, '([0-9]+(?:\.[0-9]+)?)', 1) as double) as value, least(2, length(regexp_extract(hit, '\.([0-9]+)', 1))) as decimals, regexp_extract(hit, '(万元|万|%|元)$', 1) as suffix from e""",
    "slug_ids": "select s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from supplier",
    "repeated_statement_owner": f"""select distinct claim_id, statement, chapter_id, owner from (select *, first_value(chapter_id) over (partition by n order by book_id nulls first, chapter_id nulls first, claim_id) as owner
from (select *, {_norm("statement")} as n from {_C}) where n <> '') where owner is distinct from chapter_id""",
    "best_statement_per_key": f"select {_norm('statement')} as norm, min(claim_id) as claim_id from {_C} where {_norm('statement')} <> '' group by 1",
    "short_hooks": rf"""with s as (select distinct job_id, scene_id, voice_text as t from {_S}), k as (select *, length(regexp_extract(substr(t, 1, 10), '^((?s).*[，。！？；：])', 1)) as m from s),
c as (select *, case when m > 0 then m else least(8, length(t)) end as cut from k) select distinct job_id, scene_id, substr(t, 1, cut) as head, substr(t, cut + 1) as rest from c""",
    "page_lines": """with b as (select book_id, page, block_id, min(bbox) as q from blocks where bbox is not null group by all),
f as (select *, case when coalesce(lag(q.y) over w - q.y, 1e18) > 2 then 1 else 0 end as fresh from b window w as (partition by book_id, page order by q.y desc, q.x, block_id)),
l as (select *, sum(fresh) over (partition by book_id, page order by q.y desc, q.x, block_id) - 1 as line_no from f)
select book_id, page, line_no, string_agg(block_id, ' ' order by q.x, block_id) as text, round(max(q.x + q.w), 6) as x2 from l group by all""",
    "visual_terms": rf"""with s as (select distinct job_id, scene_id, voice_text as t from {_S}),
u as (select *, list_transform(list_filter(list_transform(regexp_split_to_array(t, '[，。！？；：、]'), lambda x: regexp_replace(regexp_replace(x, '{T.LEAD_WORDS}', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: length(x) >= 2), lambda x: substr(x, 1, 14)) as raw from s),
v as (select *, list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda z: list_position(raw, z[1]) = z[2]), lambda z: z[1]) as d from u)
select distinct job_id, scene_id, array_to_string(case when len(d) = 0 then list_transform([1, 2, 3], lambda k: substr(regexp_replace(t, '[，。！？；：、]', '', 'g'), 1, 14)) else list_concat(d, [d[len(d)], d[len(d)], d[len(d)]])[1:3] end, '|') as terms from v""",
}

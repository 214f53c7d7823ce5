"""The queries of the problems on texts, with their SQL where there is one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.llm.langid import LANGUAGES, by_script, identify
from quirefold.llm.leakage import find_leaks
from quirefold.llm.lookalike import one_form, same_look
from quirefold.llm.mixing import balance, token_counts
from quirefold.llm.scanned import find_damage, paragraphs, running
from quirefold.llm.segmentation import split_sentences
from quirefold.llm.splitting import split_oversized
from quirefold.session import cut_lineage, spread, table

#: The public vocabulary whose tokens sizes are counted in.
VOCABULARY = "byte_bpe_50k.tiktoken"

_IDS = ["source_table", "owner_id", "record_id"]


def _blocks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    df = table(spark, sf, "blocks")
    return df.select(F.lit("blocks").alias("source_table"), F.col("book_id").alias("owner_id"), F.col("block_id").alias("record_id"), F.col("original_text").alias("text"), *more)


def _scenes(spark: SparkSession, sf: str, *more) -> DataFrame:
    df = table(spark, sf, "scenes")
    return df.select(F.lit("scenes").alias("source_table"), F.col("job_id").alias("owner_id"), F.col("scene_id").alias("record_id"), F.col("voice_text").alias("text"), *more)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of digital running text and of scenes."""
    blocks = _blocks(spark, sf, "pdf_kind", "block_type").where((F.col("pdf_kind") == "digital") & F.col("block_type").isin("paragraph", "quote", "footnote"))
    rows = blocks.drop("pdf_kind", "block_type").unionByName(_scenes(spark, sf))
    return split_sentences(spread(rows), "text", _IDS).distinct()


def _scanned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scanned blocks with the headers of their chapter, by title or by place; all clean texts."""
    blocks = spread(table(spark, sf, "blocks"))
    kinds = F.col("pdf_kind").isin("scanned", "mixed") & F.col("block_type").isin("paragraph", "quote", "footnote", "list")
    pages = blocks.where(kinds).select("book_id", "block_id", "chapter_id", "page", "original_text")
    heads = (
        table(spark, sf, "chapters")
        .select("book_id", "chapter_id", F.explode(F.array("title", "book_title")).alias("head"))
        .where(F.col("head").isNotNull())
        .unionByName(running(pages, "original_text", "page", ["book_id", "chapter_id"]))
        .groupBy("book_id", "chapter_id")
        .agg(F.sort_array(F.collect_set("head")).alias("heads"))
    )
    clean = blocks.where(F.col("pdf_kind") == "digital").select(F.col("original_text").alias("text")).unionByName(table(spark, sf, "scenes").select(F.col("voice_text").alias("text")))
    return pages.join(heads, ["book_id", "chapter_id"], "left"), clean


def _damage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages, clean = _scanned(spark, sf)
    text_key = F.xxhash64("original_text").alias("text_key")
    pages = pages.select("*", text_key)
    return pages, find_damage(pages, "original_text", "page", "heads", ["book_id", "block_id", "text_key"], clean, "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture, broken and misread words of scanned blocks."""
    return _damage(spark, sf)[1].select("book_id", "block_id", "line_no", "defect", "repaired").distinct()


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The scanned blocks as continuous paragraphs."""
    pages, damage = _damage(spark, sf)
    keys = ["book_id", "block_id", "text_key"]
    per_block = damage.distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "defect", "seen", "repaired"))).alias("damage"))

    @F.pandas_udf(StringType())
    def put(texts: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else paragraphs(t, [(d["line_no"], d["defect"], d["seen"], d["repaired"]) for d in (r if r is not None else ())]) for t, r in zip(texts, rows, strict=True)])

    texts = pages.where(F.col("original_text").isNotNull()).select(*keys, "original_text").distinct()
    return texts.join(per_block, keys, "left").select("book_id", "block_id", put("original_text", "damage").alias("repaired_text")).distinct()


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    """book_id, block_id, label_lang and segments of every block with letters;
    blocks that are too short, or that the models hardly tell apart, are one
    segment in the language of most of their book's text; in a book without
    any sure text, of most of its labels, else of the script, else und."""
    blocks = table(spark, sf, "blocks").select("book_id", "block_id", "language", "original_text", by_script("original_text").alias("script"))
    found = cut_lineage(identify(spread(blocks), "original_text", "language", ["book_id", "block_id", "script"]).where("has_letters"))
    sizes = found.select("book_id", F.inline("segments")).groupBy("book_id", "lang").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n"))
    texts = sizes.groupBy("book_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("text_lang"))
    counts = found.where(F.col("label_lang").isin(*LANGUAGES)).groupBy("book_id", "label_lang").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy("book_id").agg(F.max_by("label_lang", F.struct("n", "label_lang")).alias("most_labels"))
    books = labels.join(texts, "book_id", "full_outer")
    one = F.array(F.struct(F.lit(0).alias("start_pos"), F.lit(None).cast("int").alias("end_pos"), F.col("book_lang").alias("lang"), F.lit(0.0).cast("double").alias("confidence")))
    unsure = F.size("segments") == 0
    rows = found.join(books, "book_id", "left").withColumn("book_lang", F.coalesce("text_lang", "most_labels", "script"))
    return rows.withColumn("segments", F.when(unsure, one).otherwise(F.col("segments")))


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every block's segments with language and confidence."""
    return _languages(spark, sf).select("book_id", "block_id", F.posexplode("segments").alias("seg_ord", "s")).select("book_id", "block_id", "seg_ord", "s.*").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks without or with a wrong label, and mixed ones."""
    rows = _languages(spark, sf).where((F.size("segments") > 1) | F.col("label_lang").isNull() | ~F.col("label_lang").isin(*LANGUAGES) | (F.col("label_lang") != F.get("segments", 0)["lang"]))
    return rows.select("book_id", "block_id", F.posexplode("segments").alias("seg_ord", "s")).select("book_id", "block_id", "seg_ord", F.col("s.lang").alias("seg_lang")).distinct()


def _limited(spark: SparkSession, sf: str) -> DataFrame:
    items = _blocks(spark, sf, F.col("block_type").alias("item_kind")).unionByName(_scenes(spark, sf, F.col("purpose").alias("item_kind")))
    limits = table(spark, sf, "split_limits").groupBy("source_table", "item_kind").agg(F.min("size_limit").alias("size_limit"), F.max("overlap_chars").alias("overlap_chars"))
    return items.join(limits, ["source_table", "item_kind"])


def p5_split(spark: SparkSession, sf: str) -> DataFrame:
    """The oversized items with their pieces."""
    return split_oversized(_limited(spark, sf), "text", "size_limit", "overlap_chars", _IDS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items above their limit, and those of them whose hard cuts part a
    stretch that is longer than the limit."""
    reasons = F.when(F.col("cut_stretch") > F.col("size_limit"), F.array(F.lit("oversize"), F.lit("no_boundary"))).otherwise(F.array(F.lit("oversize")))
    return p5_split(spark, sf).select(*_IDS, F.explode(reasons).alias("reason")).distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """One row per piece of an oversized item."""
    return p5_split(spark, sf).select(*_IDS, F.posexplode("pieces").alias("piece_no", "p")).select(*_IDS, "piece_no", "p.start_pos", "p.end_pos", "p.cut").distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a test passage, wholly or in large part."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return find_leaks(docs, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _mix(spark: SparkSession, sf: str, vocabulary: str | None = None):
    import public_tokenizers

    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    sized = token_counts(docs, "text", ["doc_id", "source"], vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return balance(sized, "doc_id", table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached per source."""
    return _mix(spark, sf)[1]


def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix, each with its number of copies."""
    return _mix(spark, sf)[0]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that differ in characters but look the same."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return same_look(docs, "doc_id", "text").select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its consistent form, with the key by which it
    compares: equal for texts that look the same."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return one_form(docs, "text", ["doc_id"]).select("doc_id", "form", F.hex("look_key").alias("look_key")).distinct()


_P5_ITEMS = """
with items as (
  select 'blocks' as source_table, book_id as owner_id, block_id as record_id, original_text as t, block_type as item_kind from blocks
  union all
  select 'scenes', job_id, scene_id, voice_text, purpose from scenes
), large as (
  select i.*, l.size_limit from items i join split_limits l on l.source_table = i.source_table and l.item_kind = i.item_kind where length(i.t) > l.size_limit
)
"""

QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_texts": p3_texts,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p7_found": p7_found,
    "p8_shares": p8_shares,
    "p8_copies": p8_copies,
    "p9_found": p9_found,
    "p9_forms": p9_forms,
}
SQL = {
    "p5_found": _P5_ITEMS
    + r"""select distinct source_table, owner_id, record_id, 'oversize' as reason from large
union all
select distinct source_table, owner_id, record_id, 'no_boundary' from large
where list_max(list_transform(regexp_split_to_array(t, '[\s\p{Z}\p{P}\x{1c}-\x{1f}\x{85}]+'), lambda x: length(x))) > size_limit""",
}

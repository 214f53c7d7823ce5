"""Pages: lines from positioned pieces of text, chapters from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import chapter_prefix, collapse

# What begins a table of contents, and its leaders.
TOC_MARKER = "(?i)^(?:contents|table of contents|目录|目次)$"
TOC_LEADER = "(?:\\.{2,}|…{2,}|·{2,})"


def lines_from_items(items: DataFrame, page: list[str], tolerance: float = 2.0) -> DataFrame:
    """Pieces of text (text, x, y, width, height; y grows upwards) as lines.

    Pieces belong to one line as long as each lies at most ``tolerance`` below
    the one before in order of height. Result: ``page``, line_no from the top,
    text (pieces from left to right), x1, y1, x2, y2. Pieces without a place
    are left out. One shuffle by page.
    """
    w = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "text")
    placed = items.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    fresh = F.when(F.coalesce(F.lag("y").over(w) - F.col("y"), F.lit(1e18)) > tolerance, 1).otherwise(0)
    numbered = placed.withColumn("__f", fresh).withColumn("line_no", F.sum("__f").over(w) - 1)
    grouped = numbered.groupBy(*page, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x", F.coalesce("text", F.lit("")).alias("text")))).alias("__t"),
        F.min("x").alias("x1"),
        F.min("y").alias("y1"),
        F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x2"),
        F.max(F.col("y") + F.coalesce("height", F.lit(0.0))).alias("y2"),
    )
    return grouped.select(*page, "line_no", collapse(F.array_join(F.transform("__t", lambda t: t["text"]), " ")).alias("text"), "x1", "y1", "x2", "y2")


def detect_chapters(lines: DataFrame, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Chapters that begin 第…章: doc, number, title, page.

    ``lines``: doc, order, page, text, y, height. A heading is prominent (12
    high, or a quarter above its page's median) or has the title that the
    table of contents gives; it goes on over the next two lines while these
    are as large and close. Lines of the table of contents - from its marker
    to the first prominent heading - are none. Of a number the first heading
    counts, and a title of the contents goes before the one found.
    """
    p = Window.partitionBy(doc)
    w = p.orderBy(order)
    rows = lines.withColumn("c", chapter_prefix("text"))
    median = F.percentile("height", F.lit(0.5)).over(Window.partitionBy(doc, "page"))
    rows = rows.withColumn("big", (F.col("height") >= 12) | (F.col("height") >= F.coalesce(median, F.lit(0.0)) * 1.25))
    rows = rows.withColumn("toc", F.min(F.when(F.col("text").rlike(TOC_MARKER), F.col(order))).over(p))
    sure = F.col("c").isNotNull() & F.col("big") & (F.col(order) > F.coalesce("toc", F.lit(-1)))
    rows = rows.withColumn("toc_end", F.coalesce(F.min(F.when(sure, F.col(order))).over(p), F.max(order).over(p) + 1))
    for k in (1, 2):
        rows = rows.withColumn(f"n{k}", F.lead(F.struct("page", "text", "y", "height", F.col("c").isNotNull().alias("head")), k).over(w))
    bare = lambda c: F.trim(F.split(c, TOC_LEADER)[0])
    leads, n1, n2 = F.col("text").rlike(TOC_LEADER), F.col("n1"), F.col("n2")
    goes_on = ~leads & (n1["page"] == F.col("page")) & ~n1["head"] & n1["text"].rlike(TOC_LEADER)
    in_toc = F.col("c").isNotNull() & ~F.col("big") & F.col("toc").isNotNull() & F.col(order).between(F.col("toc") + 1, F.col("toc_end") - 1)
    named = F.trim(F.concat_ws(" ", F.nullif(bare(F.col("c.suffix")), F.lit("")), F.when(goes_on, bare(n1["text"]))))
    titles = rows.where(in_toc & (leads | F.coalesce(goes_on, F.lit(False)))).groupBy(doc, F.col("c.number").alias("number")).agg(F.max_by(named, order).alias("toc_title"))

    def follows(n, before_y):
        gap = before_y - n["y"]
        return F.coalesce((n["page"] == F.col("page")) & ~n["head"] & (n["height"] >= F.greatest(F.lit(10.0), F.col("height") * 0.75)) & (gap > 0) & (gap <= F.greatest(F.lit(30.0), F.col("height") * 2.25)), F.lit(False))

    one = follows(n1, F.col("y"))
    two = one & follows(n2, n1["y"])
    found = F.concat_ws(" ", F.nullif(F.col("c.suffix"), F.lit("")), F.when(one, collapse(n1["text"])), F.when(two, collapse(n2["text"])))
    heads = rows.where(F.col("c").isNotNull() & (F.col("toc").isNull() | (F.col(order) >= F.col("toc_end")))).select(doc, order, "page", "big", F.col("c.number").alias("number"), F.col("c.marker").alias("marker"), found.alias("found"))
    plain = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    judged = heads.join(titles, [doc, "number"], "left").where(F.col("big") | F.coalesce(plain(F.col("found")) == plain(F.col("toc_title")), F.lit(False)))
    judged = judged.withColumn("title", F.coalesce("toc_title", "found")).where("title <> ''")
    first = judged.groupBy(doc, "number").agg(F.min_by(F.struct("marker", "title", "page"), order).alias("f"))
    return first.select(doc, "number", F.concat_ws(" ", "f.marker", "f.title").alias("title"), F.col("f.page").alias("page"))

"""Queries of the problems on records and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.nested import label_nodes, with_ancestor, with_own_field
from quirefold.operators.orphans import child_keys, find_orphans, orphan_report, parent_keys, utc_month
from quirefold.session import spread, table

_RECORD = ("record_table", "record_id")
_NAMES = ("claims", "appliesTo", "bookEvidenceRefs", "page", "visualElements", "elementId")


def record_nodes(spark: SparkSession, sf: str, names=_NAMES) -> DataFrame:
    """The labelled nodes of both record tables."""
    both = [table(spark, sf, t).select(F.lit(t).alias("record_table"), "record_id", "payload") for t in ("chapter_records", "page_records")]
    return label_nodes(spread(both[0].unionByName(both[1])), "payload", _RECORD, names)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The flat rows of TESTDATA.md, problem 2. One Python pass labels the
    nodes; three windows over the same partitioning link them."""
    nodes = record_nodes(spark, sf)
    nodes = with_ancestor(nodes, _RECORD, "claims", "claim")
    nodes = with_own_field(nodes, _RECORD, "bookEvidenceRefs", "page", "page")
    nodes = with_own_field(nodes, _RECORD, "visualElements", "elementId", "element")
    blank = r"(?U)^\s*$"
    number = F.expr("try_cast(try_cast(trim(page) as double) as bigint)").cast("string")
    name, there = F.col("name"), ~F.coalesce(F.col("value"), F.lit("")).rlike(blank)
    item = (name == "appliesto") & F.col("claim").isNotNull() & there
    ref = (name == "bookevidencerefs") & F.col("claim").isNotNull() & (there | ~F.col("is_leaf"))
    visual = (name == "visualelements") & ~F.coalesce(F.col("element"), F.lit("")).rlike(blank)
    return (
        nodes.where(item | ref | visual)
        .select(
            *_RECORD,
            F.when(item, "applies_to").when(ref, "evidence_ref").otherwise("visual_element").alias("child_kind"),
            F.when(visual, F.lit(0)).otherwise(F.col("claim.ord")).alias("parent_ord"),
            F.col("ord").alias("child_ord"),
            F.when(item, F.col("value")).when(ref, F.coalesce(number, F.lit(""))).otherwise(F.col("element")).alias("child_value"),
        )
        .dropDuplicates()
    )


def p6_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """All orphan references of the three referring tables."""
    parents = [parent_keys(table(spark, sf, "blocks"), "blocks", "block_id"), parent_keys(table(spark, sf, "claims"), "claims", "claim_id")]
    refs = table(spark, sf, "source_refs").where(F.col("ref_type") == "book")
    angles = table(spark, sf, "angles").select("angle_id", "book_id", "created_at", F.explode("core_claim_ids").alias("claim_id"))
    children = [
        child_keys(refs, "source_refs", "blocks", "ref_id", "block_id", "ref_at"),
        child_keys(angles, "angles", "claims", "angle_id", "claim_id", "created_at"),
        child_keys(table(spark, sf, "claim_relations"), "claim_relations", "claims", "relation_id", "from_claim_id", "created_at"),
    ]
    return find_orphans(parents, children)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The orphan references of TESTDATA.md, problem 6."""
    return (
        p6_orphans(spark, sf)
        .select("ref_table", F.col("owner").alias("owner_key"), F.col("key").alias("target_id"), utc_month(F.col("at")).alias("period"), "reason")
        .dropDuplicates()
    )


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return orphan_report(p6_orphans(spark, sf))


_P6_REFS = """
with refs as (
  select 'source_refs' as ref_table, 'blocks' as target, book_id, lower(trim(block_id, ' \t\n\r')) as key, cast(ref_id as varchar) as owner, ref_at as moment
  from source_refs where ref_type = 'book'
  union all
  select 'angles', 'claims', book_id, lower(trim(c, ' \t\n\r')), angle_id, created_at from (select *, unnest(core_claim_ids) as c from angles)
  union all
  select 'claim_relations', 'claims', book_id, lower(trim(from_claim_id, ' \t\n\r')), cast(relation_id as varchar), created_at from claim_relations
), kids as (select distinct * from refs where key <> '' and moment is not null),
parents as (
  select 'blocks' as target, book_id, lower(trim(block_id, ' \t\n\r')) as key, ingested_at, deleted_at from blocks
  union all
  select 'claims', book_id, lower(trim(claim_id, ' \t\n\r')), ingested_at, deleted_at from claims
), judged as (
  select k.ref_table, k.owner, k.book_id, k.key, k.moment, count(p.key) as n_rows,
    count(*) filter (where p.ingested_at <= k.moment) as n_before,
    count(*) filter (where p.ingested_at <= k.moment and (p.deleted_at is null or p.deleted_at > k.moment)) as n_there
  from kids k left join parents p on p.target = k.target and p.book_id = k.book_id and p.key = k.key
  group by all
), orphans as (
  select ref_table, owner, book_id, key, moment,
    case when n_rows = 0 then 'missing' when n_before = 0 then 'late' else 'deleted' end as reason
  from judged where n_there = 0
)
"""

# p2_found has no SQL: the payloads' nesting and encoding vary; the tests compare it with a recursive reading.
QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": _P6_REFS + "select distinct ref_table, owner as owner_key, key as target_id, strftime(moment at time zone 'UTC', '%Y-%m') as period, reason from orphans",
    "p6_report": _P6_REFS
    + "select ref_table, strftime(moment at time zone 'UTC', '%Y-%m') as period, reason, count(*) as orphans, count(distinct (book_id, key)) as orphan_targets from orphans group by all",
}

"""Statements measured against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.session import cut_lineage

#: Least cover of a scope by the evidence, and of each side of a causal relation.
LEAST_SCOPE, LEAST_CAUSE = 0.07, 0.16
#: Codes for which a claim is dropped by :func:`enforce`.
FATAL = ("UNSUPPORTED_CLAIM", "WEAK_CLAIM_REQUIRES_REVISION", "PARTIAL_SUPPORT_SCOPE_OVERCLAIM", "SCOPE_OVERCLAIM", "CAUSAL_OVERCLAIM", "FRAGMENTARY_CLAIM")
_NO_TEXTS = "array<string>"


def lexical_grade(statement: str, excerpt: str, statement_features: str, excerpt_features: str) -> Column:
    """unsupported, weak, partial or strong: how an excerpt supports a
    statement; unsupported if it is blank, lacks a number, or negates."""
    mismatch = (T.collapse(excerpt) == "") | T.numbers_missing(statement, excerpt) | T.negation_differs(statement, excerpt)
    return T.grade(T.coverage(statement_features, excerpt_features), mismatch)


def _relation(df: DataFrame, text: str, cause: str, effect: str) -> DataFrame:
    """Adds the features of both sides of the causal relation in a text, null without one."""
    return df.withColumn("__r", T.causal_relation(text)).withColumns({cause: F.when(F.col("__r").isNotNull(), T.features(F.col("__r.cause"))), effect: F.when(F.col("__r").isNotNull(), T.features(F.col("__r.effect")))}).drop("__r")


def calibrate(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues of claims, and the claims with their support corrected.

    ``claims``: claim_id (unique), statement, evidence_support, applies_to,
    does_not_apply_to; other columns stay. ``evidence``: claim_id,
    evidence_id, n (its order), excerpt, summary; distinct pairs. Nulls in
    arrays are left out, null arrays are empty, a null summary isn't judged, a
    null statement is unsupported. First result: code, claim_id, evidence_id
    (null but for issues of pairs). Second: ``claims`` with evidence_support,
    never above what is measured. Empty tables give empty results.

    The evidence of a claim that supports it, put together, decides. It is not
    brought into one text: what it covers is counted by distinct features of
    the claim, so a claim may have any amount of evidence; features over the
    seam of two excerpts are added.
    """
    c, scopes, pairs = _measure(claims, evidence)
    j = _judge(c, scopes, pairs)
    of_pairs = F.filter(
        F.array(
            F.when(F.col("grade") == T.GRADES[0], "SEVERE_EXCERPT_MISMATCH"),
            F.when(F.col("grade") == T.GRADES[0], "EVIDENCE_CLAIM_MISMATCH"),
            F.when(F.col("off"), "EVIDENCE_SUMMARY_EXCERPT_MISMATCH"),
        ),
        lambda x: x.isNotNull(),
    )
    issues = j.select(F.explode("codes").alias("code"), "claim_id", F.lit(None).cast("string").alias("evidence_id")).unionByName(pairs.select(F.explode(of_pairs).alias("code"), "claim_id", F.col("evidence_id").cast("string").alias("evidence_id")))
    return issues, _regraded(claims, j)


def _regraded(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """The claims that are judged, with their support corrected."""
    return claims.drop("evidence_support").join(judged.select("claim_id", F.col("support").alias("evidence_support")).hint("merge"), "claim_id")


def _measure(claims: DataFrame, evidence: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, their scopes, and their pairs with evidence, with all that is
    needed of their texts to judge them; ``keep``: more columns of claims."""
    c = claims.select("claim_id", *keep, "statement", "evidence_support", F.coalesce("applies_to", F.array().cast(_NO_TEXTS)).alias("applies_to"), F.coalesce("does_not_apply_to", F.array().cast(_NO_TEXTS)).alias("limits"), T.features("statement").alias("sf"))
    c = cut_lineage(c)
    scopes = c.select("claim_id", F.explode(F.array_distinct(F.filter("applies_to", lambda x: x.isNotNull()))).alias("scope")).withColumns({"scope_norm": T.normalize("scope"), "f": T.features("scope")})
    scopes = cut_lineage(scopes.withColumns({"size": F.size("f"), "long": F.char_length("scope_norm") >= 8}))
    # Texts meet by claim, once, and their features are taken there; of an
    # excerpt's only those are written that the claim or its scopes ask for.
    wanted = scopes.where("long").groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("qf"))
    texts = c.select("claim_id", "statement").hint("merge").join(wanted.hint("merge"), "claim_id", "left")
    pairs = evidence.select("claim_id", "evidence_id", "n", "excerpt", "summary").repartition("claim_id").distinct().join(texts.hint("merge"), "claim_id")
    pairs = pairs.withColumns({"norm": T.normalize("excerpt"), "sf": T.features("statement"), "ef": T.features("excerpt"), "mf": T.features("summary")})
    pairs = _relation(_relation(pairs, "statement", "sc", "se"), "excerpt", "ec", "ee")
    both = (T.coverage("sc", "ec") >= LEAST_CAUSE) & (T.coverage("se", "ee") >= LEAST_CAUSE)
    pairs = pairs.select(
        "claim_id",
        "evidence_id",
        "n",
        F.left("norm", F.lit(1)).alias("head"),
        F.right("norm", F.lit(1)).alias("tail"),
        (F.col("summary").isNotNull() & (lexical_grade("summary", "excerpt", "mf", "ef") != "strong")).alias("off"),
        lexical_grade("statement", "excerpt", "sf", "ef").alias("grade"),
        F.coalesce(both, F.lit(False)).alias("causes"),
        F.coalesce(F.col("excerpt").rlike(T.UNIVERSAL), F.lit(False)).alias("universal"),
        F.array_intersect("sf", "ef").alias("cover"),
        F.array_intersect("qf", "ef").alias("asked"),
    )
    return c, scopes, cut_lineage(pairs)


def _judge(c: DataFrame, scopes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The support of claims and the codes against them, by :func:`_measure`."""
    used = pairs.where(F.col("grade") != T.GRADES[0])
    before = F.lag("tail").over(Window.partitionBy("claim_id").orderBy("n", "evidence_id"))
    seams = used.withColumn("seam", F.concat(before, "head")).where("char_length(seam) = 2").select("claim_id", "seam").distinct()
    covered = used.select("claim_id", F.explode("cover").alias("f")).unionByName(seams.join(c.select("claim_id", "sf").hint("merge"), "claim_id").where(F.array_contains("sf", F.col("seam"))).select("claim_id", F.col("seam").alias("f")))
    covered = covered.distinct().groupBy("claim_id").agg(F.count(F.lit(1)).alias("covered"))
    sums = pairs.groupBy("claim_id").agg(F.count(F.lit(1)).alias("pairs"), F.max(F.col("grade") != T.GRADES[0]).alias("used"), F.max((F.col("grade") != T.GRADES[0]) & F.col("causes")).alias("causes"), F.max((F.col("grade") != T.GRADES[0]) & F.col("universal")).alias("universal"))
    # scopes: distinct features that the evidence covers; merged by key, as by
    # the size of their file a claim's features look small enough for the driver
    asked = scopes.where("long").select("claim_id", "scope", F.explode("f").alias("f"))
    met = asked.join(used.select("claim_id", F.explode("asked").alias("f")).unionByName(seams.select("claim_id", F.col("seam").alias("f"))).distinct().hint("merge"), ["claim_id", "f"]).groupBy("claim_id", "scope").agg(F.count(F.lit(1)).alias("met"))
    specific = F.col("long") & ~T.collapse("scope").rlike(T.GENERIC_SCOPE)
    per_scope = scopes.join(met.hint("merge"), ["claim_id", "scope"], "left").groupBy("claim_id").agg(
        F.max(specific).alias("specific"), F.max(F.col("scope").rlike(T.UNIVERSAL)).alias("asks_universal"), F.max(F.col("long") & (F.coalesce("met", F.lit(0)) / F.greatest("size", F.lit(1)) < LEAST_SCOPE)).alias("unmet")
    )
    j = c.join(sums.hint("merge"), "claim_id", "left").join(covered.hint("merge"), "claim_id", "left").join(per_scope.hint("merge"), "claim_id", "left")
    no = lambda name: F.coalesce(name, F.lit(False))
    measured = F.when(no("used"), T.grade(F.coalesce("covered", F.lit(0)) / F.greatest(F.size("sf"), F.lit(1)), F.lit(False))).otherwise(T.GRADES[0])
    j = j.withColumn("measured", measured).withColumn("support", T.lower_grade(F.coalesce("evidence_support", "measured"), F.col("measured")))
    loose = F.exists("limits", lambda x: F.coalesce(x.rlike(T.UNIVERSAL) | ~x.rlike(T.BOUNDARY), F.lit(False)))
    narrowed = no(F.col("statement").rlike(T.HEDGES)) | no("specific")
    single = {
        "CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE": F.col("pairs").isNull(),
        "UNSUPPORTED_CLAIM": F.col("support") == "unsupported",
        "WEAK_CLAIM_REQUIRES_REVISION": F.col("support") == "weak",
        "PARTIAL_SUPPORT_SCOPE_OVERCLAIM": (F.col("support") == "partial") & ~narrowed,
        "CAUSAL_OVERCLAIM": no(F.col("statement").rlike(T.CAUSAL)) & ~no("causes"),
        "SCOPE_OVERCLAIM": (no("asks_universal") & ~no("universal")) | no("unmet") | loose,
        "FRAGMENTARY_CLAIM": no(T.is_fragment("statement")),
    }
    return cut_lineage(j.select("claim_id", "support", F.filter(F.array(*[F.when(k, code) for code, k in single.items()]), lambda x: x.isNotNull()).alias("codes")))


def enforce(claims: DataFrame, evidence: DataFrame, group: str, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence without what :func:`calibrate` objects to.

    In a pass, claims with a code of FATAL go, and pairs that don't match;
    then the rest is calibrated again. Groups (a chapter) that lose support by
    that take another pass, up to ``passes``; others are done. Each pass cuts
    its lineage; it stops when no group is left. Texts are measured once: a
    pass drops claims and pairs and changes grades, but no text.
    """
    evidence = cut_lineage(evidence)
    first, scopes, measured = _measure(claims, evidence, group)
    apart = (F.col("grade") == T.GRADES[0]) | F.col("off")
    having = lambda *codes: F.arrays_overlap("codes", F.array(*map(F.lit, codes)))
    of = lambda df, some: df.join(some.select("claim_id").hint("merge"), "claim_id", "left_semi")
    left, pairs, open_groups = first, measured, None
    for _ in range(passes):
        mine = left if open_groups is None else left.join(open_groups.hint("merge"), group, "left_semi").select(*left.columns)
        rest = None if open_groups is None else left.join(open_groups.hint("merge"), group, "left_anti").select(*left.columns)
        judged = _judge(mine, scopes, pairs) if rest is None else _judge(mine, of(scopes, mine), of(pairs, mine))
        kept = cut_lineage(_regraded(mine, judged.where(~having(*FATAL))).select(*left.columns))
        pairs = measured.where(~apart)
        judged = _judge(kept, of(scopes, kept), of(pairs, kept))
        lost = judged.where(having("UNSUPPORTED_CLAIM", "CORE_CLAIM_WITHOUT_DIRECT_EVIDENCE"))
        open_groups = cut_lineage(of(kept, lost).select(group).distinct())
        graded = _regraded(kept, judged).select(*left.columns)
        left = cut_lineage(graded if rest is None else graded.unionByName(rest))
        if open_groups.isEmpty():
            break
    gone = first.select("claim_id").join(left.select("claim_id").hint("merge"), "claim_id", "left_anti")
    bad = measured.where(apart).select("claim_id", "evidence_id")
    evidence = evidence.join(gone.hint("merge"), "claim_id", "left_anti").join(bad.hint("merge"), ["claim_id", "evidence_id"], "left_anti")
    return _regraded(claims, left.withColumnRenamed("evidence_support", "support")).select(*claims.columns), evidence

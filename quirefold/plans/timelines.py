"""Queries of timelines, runs and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import timeline as G
from quirefold.operators import ranking, rules, windows
from quirefold.sources.documents import assemble_chunks
from quirefold.session import table
from quirefold.streaming import events as E


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scenes").select("job_id", "scene_id", "ord", "start_ms", "end_ms", "purpose", "voice_text", "transition", "transition_ms").distinct()


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as spans of time in milliseconds."""
    start = _ms("ts")
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", start.alias("start_ms"), (start + F.floor(F.col("value") * 60000)).alias("end_ms"))


def _ms(c: str):
    """Milliseconds since 1970 of a time without zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz)) div 1000")


def boundary_gap_stats(spark, sf):
    g = windows.gaps(_spans(spark, sf), ["user_id"], "start_ms", "end_ms").where("gap is not null")
    g = windows.middle(g, ["user_id"], ["gap", "event_id"])
    return g.groupBy("user_id").agg(F.max(F.when(F.col("is_middle"), F.col("gap"))).alias("median_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") >= 700).alias("long_gaps"))


def trim_window(spark, sf):
    s = _spans(spark, sf).groupBy("user_id").agg(F.min("start_ms").alias("a"), F.max_by("end_ms", F.struct("start_ms", "event_id")).alias("b"), F.max("end_ms").alias("d"))
    base = F.col("a") - 1000
    return s.withColumn("w", G.trim_window(F.col("a") - base, F.col("b") - base, F.col("d") - base)).select("user_id", "w.start_ms", "w.end_ms")


def cumulative_timeline(spark, sf):
    """Scenes one after another, with a pause that depends on the next purpose."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", "purpose", (F.col("end_ms") - F.col("start_ms")).alias("d")).distinct()
    nxt = F.lead("purpose").over(Window.partitionBy("job_id").orderBy("ord", "scene_id"))
    pause = F.when(nxt.isNull(), 0).when(nxt != F.col("purpose"), 420).otherwise(180)
    t = windows.timeline(s.withColumn("pause", pause), ["job_id"], ["ord", "scene_id"], F.col("d"), F.col("pause"), 60)
    return t.select("job_id", "scene_id", "start_at", "end_at")


def proportional_allocation_residual(spark, sf):
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", F.coalesce(T.readable_count("voice_text"), F.lit(0)).alias("w")).distinct()
    return windows.allocate(s, ["job_id"], ["ord", "scene_id"], "w", F.lit(300000)).select("job_id", "scene_id", "share")


def caption_allocation_clamped(spark, sf):
    """Sentences' lines of a scene within its time, by their letters."""
    s = _scenes(spark, sf).where("voice_text is not null").select("job_id", "scene_id", "start_ms", "end_ms", F.posexplode(F.split("voice_text", "[。！？!?]")).alias("pos", "line")).distinct()
    s = s.withColumn("w", T.readable_count("line")).where("w > 0")
    out = windows.allocate_times(s, ["job_id", "scene_id", "start_ms"], ["pos"], "w", F.col("start_ms"), F.col("end_ms"))
    return out.select("job_id", "scene_id", "pos", "start_at", "end_at")


def interval_bucket_overlap(spark, sf):
    b = windows.bucket_overlap(_scenes(spark, sf).select("job_id", "scene_id", "start_ms", "end_ms").distinct(), "start_ms", "end_ms", 7000)
    return b.groupBy("job_id", "bucket").agg(F.count(F.lit(1)).alias("scenes"), F.sum("shared").alias("shared"))


def active_interval_asof(spark, sf):
    """For every purchase the last view of its user before it."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return windows.as_of(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, ["user_id"], "ts", "ts", ["view_id"]).select("user_id", "event_id", "view_id")


def share_by_kind(spark, sf):
    """Characters and shares by purpose, in tenths of a percent."""
    s = _scenes(spark, sf).groupBy("job_id", "purpose").agg(F.sum(F.coalesce(T.readable_count("voice_text"), F.lit(0))).alias("chars"))
    total = F.sum("chars").over(Window.partitionBy("job_id"))
    share = F.when(total > 0, F.floor(F.col("chars") / total * 1000 + 0.5) / 10).otherwise(F.lit(0.0))
    return s.withColumn("share", share)


def runs_islands(spark, sf):
    """Runs of equal event types of a user: length and time."""
    r = windows.runs(_spans(spark, sf), ["user_id"], ["start_ms", "event_id"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), (F.max("end_ms") - F.min("start_ms")).alias("ms"))


def long_runs(spark, sf):
    """One row per event beyond the second of a run."""
    r = windows.runs(_spans(spark, sf), ["user_id"], ["start_ms", "event_id"], "event_type")
    nth = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("start_ms", "event_id"))
    return r.withColumn("nth", nth).where("nth > 2").select("user_id", "event_id", "nth")


def hopping_row_window_check(spark, sf):
    """Windows of five scenes, every four, that lack a summary."""
    h = windows.hopping_rows(_scenes(spark, sf).select("job_id", "scene_id", "ord", "purpose").distinct(), ["job_id"], ["ord", "scene_id"], 5, 4)
    return h.groupBy("job_id", "window_no").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("purpose") == "summary").alias("has")).where("n >= 4 and not has").select("job_id", "window_no", "n")


def question_answer_adjacency(spark, sf):
    """Scenes that end with a question and whose next one is a summary."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", "purpose", F.trim("voice_text").alias("t")).distinct()
    nxt = F.lead("purpose").over(Window.partitionBy("job_id").orderBy("ord", "scene_id", "t"))
    q = s.withColumn("nxt", nxt).where(F.col("t").rlike("[?？]\\z"))
    return q.groupBy("job_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("nxt") == "summary").alias("answered"))


def contiguity_check(spark, sf):
    """Where the next scene doesn't begin as one ends, as violations, with the
    other rules on a scene list: first at 0, hook first, summary last, a cut
    has no transition time, times in order."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", "start_ms", "end_ms", "purpose", "transition", "transition_ms").distinct()
    w = Window.partitionBy("job_id").orderBy("ord", "scene_id")
    s = s.withColumn("nxt", F.lead("start_ms").over(w)).withColumn("nth", F.row_number().over(w))
    item = F.concat_ws("/", "job_id", "scene_id")
    return rules.union_all(
        [
            rules.check(s, F.col("nxt") != F.col("end_ms"), "NOT_CONTIGUOUS", "scenes", item, F.col("nxt") - F.col("end_ms")),
            rules.check(s, (F.col("nth") == 1) & (F.col("start_ms") != 0), "START_NOT_ZERO", "scenes", item, "start_ms"),
            rules.check(s, (F.col("nth") == 1) & (F.col("purpose") != "hook"), "FIRST_NOT_HOOK", "scenes", item, "purpose"),
            rules.check(s, F.col("nxt").isNull() & (F.col("purpose") != "summary"), "LAST_NOT_SUMMARY", "scenes", item, "purpose"),
            rules.check(s, (F.col("transition") == "cut") != (F.col("transition_ms") == 0), "CUT_TIME", "scenes", item, "transition_ms"),
            rules.check(s, F.col("end_ms") < F.col("start_ms"), "NEGATIVE_TIME", "scenes", item, "end_ms"),
        ]
    )


def emphasis_in_text(spark, sf):
    """Emphasised words that don't stand in their scene's text."""
    s = table(spark, sf, "scenes").select("job_id", "scene_id", "voice_text", F.explode("emphasis").alias("word")).distinct()
    return s.where(F.col("word").isNotNull() & (F.instr(F.coalesce("voice_text", F.lit("")), F.col("word")) == 0)).select("job_id", "scene_id", "word").distinct()


def frames_from_ms(spark, sf):
    s = _scenes(spark, sf)
    return s.groupBy("job_id").agg(F.sum(G.frames(F.col("end_ms") - F.col("start_ms"))).alias("frames"), G.frames(F.max("end_ms"), up=True).alias("total"))


def boundary_interpolation(spark, sf):
    """Scene ends moved onto the time of the job's text, by the share of
    letters up to them."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", "start_ms", "end_ms", F.coalesce(T.readable_count("voice_text"), F.lit(0)).alias("w")).distinct()
    p = Window.partitionBy("job_id")
    upto = F.sum("w").over(p.orderBy("ord", "scene_id", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total, a, b = F.sum("w").over(p), F.min("start_ms").over(p), F.max("end_ms").over(p)
    return s.withColumn("at", F.when(total > 0, a + F.floor((b - a) * upto / total + 0.5)).otherwise(b)).select("job_id", "scene_id", F.col("at").alias("moved_to"))


def positional_zip(spark, sf):
    """Scenes put side by side with the job's scenes in order of length."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord", (F.col("end_ms") - F.col("start_ms")).alias("d")).distinct()
    a = s.withColumn("nth", F.row_number().over(Window.partitionBy("job_id").orderBy("ord", "scene_id")))
    b = s.withColumn("nth", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("d"), "scene_id"))).select("job_id", "nth", F.col("scene_id").alias("by_length"))
    return a.join(b, ["job_id", "nth"]).select("job_id", "nth", "scene_id", "by_length")


def stable_ordinals(spark, sf):
    """Padded ids by order, and the rotating window each belongs to."""
    s = _scenes(spark, sf).select("job_id", "scene_id", "ord").distinct()
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("ord", "scene_id"))
    return s.withColumn("n", nth).select("job_id", "scene_id", F.concat(F.lit("bundle-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("stable_id"), ranking.window_of(F.col("n"), 4).alias("window"))


def chunk_assembly(spark, sf):
    """Event properties put together per user as line-delimited chunks."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("at"), "props")
    return assemble_chunks(e, ["user_id"], "at", "props", "$.k", "$.error")


def event_windows(spark, sf):
    """Beyond the reference: tumbling windows, as on a stream."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = E.windowed_counts(e, "ts", ["event_type"])
    return w.select(_ms("window_start").alias("window_ms"), "event_type", "n")


def event_sessions(spark, sf):
    """Beyond the reference: sessions per user, as on a stream."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    s = E.sessions(e, "ts", ["user_id"])
    return s.select("user_id", _ms("session_start").alias("session_ms"), "n")


_S = "(select distinct job_id, scene_id, ord, start_ms, end_ms, purpose, voice_text, transition, transition_ms from scenes)"
_E = "(select user_id, event_id, event_type, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + cast(floor(value * 60000) as bigint) as end_ms from events)"
_W = r"length(regexp_replace(coalesce(voice_text, ''), '[^\p{L}\p{N}]', '', 'g'))"
_RUNS = f"""with x as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as fresh from {_E} window w as (partition by user_id order by start_ms, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by start_ms, event_id) as run from x) """
_NX = f"(select *, lead(start_ms) over w as nxt, row_number() over w as nth from (select distinct job_id, scene_id, ord, start_ms, end_ms, purpose, transition, transition_ms from scenes) window w as (partition by job_id order by ord, scene_id))"


def _v(code: str, bad: str, detail: str) -> str:
    return f"select '{code}' as code, 'scenes' as artifact, job_id || '/' || scene_id as item, coalesce(cast({detail} as varchar), '') as detail from {_NX} where {bad}"


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "boundary_gap_stats": f"""with g as (select user_id, greatest(0, start_ms - lag(end_ms) over (partition by user_id order by start_ms, end_ms)) as gap, lag(end_ms) over (partition by user_id order by start_ms, end_ms) as b from {_E})
select user_id, list_sort(list(gap))[cast(floor(count(*) / 2) as int) + 1] as median_gap, max(gap) as max_gap, count(*) filter (where gap >= 700) as long_gaps from g where b is not null group by 1""",
    "trim_window": f"""with s as (select user_id, min(start_ms) as a, arg_max(end_ms, {{'s': start_ms, 'e': event_id}}) as b, max(end_ms) as d from {_E} group by 1),
w as (select user_id, greatest(0, 1000 - 60) as s, least(d - a + 1000, b - a + 1000 + 90) as e, d - a + 1000 as d from s) select user_id, case when e > s then s else 0 end as start_ms, case when e > s then e else d end as end_ms from w""",
    "cumulative_timeline": f"""with s as (select distinct job_id, scene_id, ord, purpose, end_ms - start_ms as d from {_S}), p as (select *, lead(purpose) over (partition by job_id order by ord, scene_id) as nxt from s),
q as (select *, case when nxt is null then 0 when nxt <> purpose then 420 else 180 end as pause from p), t as (select *, 60 + sum(d + pause) over (partition by job_id order by ord, scene_id rows unbounded preceding) - pause as end_at from q)
select job_id, scene_id, end_at - d as start_at, end_at from t""",
    "proportional_allocation_residual": f"""with s as (select distinct job_id, scene_id, ord, {_W} as w from {_S}), p as (select *, cast(floor(coalesce(300000 * w / nullif(sum(w) over (partition by job_id), 0), 0) + 0.5) as bigint) as part,
row_number() over (partition by job_id order by ord desc, scene_id desc) as r from s), q as (select *, coalesce(sum(part) over (partition by job_id order by ord, scene_id rows between unbounded preceding and 1 preceding), 0) as b from p)
select job_id, scene_id, case when r = 1 then 300000 - b else part end as share from q""",
    "caption_allocation_clamped": rf"""with l as (select distinct job_id, scene_id, start_ms, end_ms, regexp_split_to_array(voice_text, '[。！？!?]') as a from {_S} where voice_text is not null),
e as (select job_id, scene_id, start_ms, end_ms, unnest(a) as line, generate_subscripts(a, 1) - 1 as pos from l), s as (select *, length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) as w from e), f as (select * from s where w > 0),
p as (select *, greatest(1, cast(floor((end_ms - start_ms) * w / greatest(sum(w) over k, 1) + 0.5) as bigint)) as step, row_number() over (partition by job_id, scene_id, start_ms order by pos desc) as r from f window k as (partition by job_id, scene_id, start_ms)),
c as (select *, sum(step) over (partition by job_id, scene_id, start_ms order by pos rows unbounded preceding) as upto from p)
select job_id, scene_id, pos, least(end_ms, start_ms + upto - step) as start_at, case when r = 1 then end_ms else least(end_ms, start_ms + upto) end as end_at from c""",
    "interval_bucket_overlap": f"""with s as (select distinct job_id, scene_id, start_ms, end_ms from {_S}), b as (select *, unnest(range(start_ms // 7000, greatest(end_ms - 1, start_ms) // 7000 + 1)) as bucket from s)
select job_id, bucket, count(*) as scenes, sum(greatest(0, least(end_ms, bucket * 7000 + 7000) - greatest(start_ms, bucket * 7000))) as shared from b group by all""",
    "active_interval_asof": """select p.user_id, p.event_id, (select v.event_id from events v where v.event_type = 'view' and v.user_id = p.user_id and v.ts <= p.ts order by v.ts desc, v.event_id desc limit 1) as view_id from events p where p.event_type = 'purchase'""",
    "share_by_kind": f"""with s as (select job_id, purpose, sum({_W}) as chars from {_S} group by all) select job_id, purpose, chars, case when sum(chars) over (partition by job_id) > 0 then floor(chars / sum(chars) over (partition by job_id) * 1000 + 0.5) / 10 else 0 end as share from s""",
    "runs_islands": _RUNS + "select user_id, run, event_type, count(*) as n, max(end_ms) - min(start_ms) as ms from r group by all",
    "long_runs": _RUNS + "select user_id, event_id, nth from (select *, row_number() over (partition by user_id, run order by start_ms, event_id) as nth from r) where nth > 2",
    "hopping_row_window_check": f"""with s as (select *, row_number() over (partition by job_id order by ord, scene_id) - 1 as i from (select distinct job_id, scene_id, ord, purpose from {_S})),
w as (select job_id, unnest(range(0, max(i) // 4 + 1)) as window_no from s group by 1) select w.job_id, w.window_no, count(*) as n from w join s on s.job_id = w.job_id and s.i between w.window_no * 4 and w.window_no * 4 + 4 group by all having count(*) >= 4 and not bool_or(purpose = 'summary')""",
    "question_answer_adjacency": f"""with s as (select *, lead(purpose) over (partition by job_id order by ord, scene_id, t) as nxt from (select distinct job_id, scene_id, ord, purpose, trim(voice_text) as t from {_S}))
select job_id, count(*) as questions, count(*) filter (where nxt = 'summary') as answered from s where regexp_matches(t, '[?？]\\z') group by 1""",
    "contiguity_check": " union all ".join(
        [
            _v("NOT_CONTIGUOUS", "nxt <> end_ms", "nxt - end_ms"),
            _v("START_NOT_ZERO", "nth = 1 and start_ms <> 0", "start_ms"),
            _v("FIRST_NOT_HOOK", "nth = 1 and purpose <> 'hook'", "purpose"),
            _v("LAST_NOT_SUMMARY", "nxt is null and purpose <> 'summary'", "purpose"),
            _v("CUT_TIME", "(transition = 'cut') <> (transition_ms = 0)", "transition_ms"),
            _v("NEGATIVE_TIME", "end_ms < start_ms", "end_ms"),
        ]
    ),
    "emphasis_in_text": "select distinct job_id, scene_id, word from (select distinct job_id, scene_id, voice_text, unnest(emphasis) as word from scenes) where word is not null and instr(coalesce(voice_text, ''), word) = 0",
    "frames_from_ms": f"select job_id, sum(cast(floor((end_ms - start_ms) * 30 / 1000.0 + 0.5) as bigint)) as frames, cast(ceil(max(end_ms) * 30 / 1000.0) as bigint) as total from {_S} group by 1",
    "boundary_interpolation": f"""with s as (select distinct job_id, scene_id, ord, start_ms, end_ms, {_W} as w from {_S}), t as (select *, sum(w) over (partition by job_id order by ord, scene_id, w rows unbounded preceding) as upto, sum(w) over p as total, min(start_ms) over p as a, max(end_ms) over p as b from s window p as (partition by job_id))
select job_id, scene_id, case when total > 0 then a + cast(floor((b - a) * upto / total + 0.5) as bigint) else b end as moved_to from t""",
    "positional_zip": f"""with s as (select distinct job_id, scene_id, ord, end_ms - start_ms as d from {_S}), a as (select *, row_number() over (partition by job_id order by ord, scene_id) as nth from s), b as (select job_id, scene_id as by_length, row_number() over (partition by job_id order by d desc, scene_id) as nth from s)
select job_id, nth, scene_id, by_length from a join b using (job_id, nth)""",
    "stable_ordinals": f"select job_id, scene_id, 'bundle-' || lpad(cast(n as varchar), 3, '0') as stable_id, (n - 1) // 4 as window from (select *, row_number() over (partition by job_id order by ord, scene_id) as n from (select distinct job_id, scene_id, ord from {_S}))",
    "chunk_assembly": "select user_id, string_agg(coalesce(json_extract_string(props, '$.k'), ''), '' order by event_id) as text, arg_min(json_extract_string(props, '$.error'), event_id) as error from events group by 1",
    "event_windows": "select epoch_ms(time_bucket(interval 1 hour, ts)) as window_ms, event_type, count(*) as n from events group by all",
    "event_sessions": "select user_id, min(ms) as session_ms, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ms) as s from (select user_id, epoch_us(ts) // 1000 as ms, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s",
}

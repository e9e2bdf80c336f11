"""Queries by name, and the SQL that each should agree with.

Numbers are rounded to six places, and a zero is added to them so that none is negative zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, noise, sheet, style, text
from .functions import timeline as tl
from .laws import catalogue as laws
from .laws import extensions, flash, impact, panels  # noqa: F401  their laws join the catalogue
from .laws.terms import ARGUMENTS
from .operators import catalog, determinism, envelopes, intervals, merkle, mutations, outcome, plain, projection, protocol, schema, tree
from .sources import builders, event_log, tables
from .streaming import authority, lease, sessions
from .streaming import outcome as streaming_outcome

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with frame, a frame number 0 to 120 in halves, derived from their id."""
    return tables.read(spark, sf_dir, "events").withColumn("frame", (F.col("event_id") * 7 % 241) / 2.0)


#: The same in SQL.
FRAMES = "(SELECT *, (event_id * 7 % 241) / 2.0::DOUBLE AS frame FROM events)"
KIND_SQL = """CASE event_type
  WHEN 'view' THEN 'compile.succeeded' WHEN 'click' THEN 'render.succeeded' WHEN 'signup' THEN 'neutral'
  WHEN 'error' THEN ['revision.corrected','revision.deleted','revision.reverted','render.failed','compile.failed'][(event_id % 5 + 1)::INT]
  ELSE ['workspace.exported','workspace.published','workspace.reused','workspace.next-task-unchanged'][(event_id % 4 + 1)::INT] END"""
NEGATIVE_SQL = ", ".join(f"'{x}'" for x in outcome.NEGATIVE)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    kind = (
        F.when(F.col("event_type") == "view", outcome.COMPILED)
        .when(F.col("event_type") == "click", outcome.RENDERED)
        .when(F.col("event_type") == "signup", "neutral")
        .when(F.col("event_type") == "error", pick([outcome.NEGATIVE[i] for i in (0, 1, 4, 5, 6)]))
        .otherwise(pick(outcome.SUCCESS))
    )
    return tables.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", kind.alias("type"))


@query(f"""
    WITH e AS (SELECT user_id, ts::DATE AS day, ts, event_id, {KIND_SQL} AS type FROM events),
    g AS (SELECT user_id, day, arg_min(type, (ts, event_id)) FILTER (type IN ({NEGATIVE_SQL})) AS neg,
                 bool_or(type = 'compile.succeeded') AS compiled, bool_or(type = 'render.succeeded') AS rendered,
                 CASE WHEN bool_or(type = 'workspace.exported') THEN 'workspace.exported'
                      WHEN bool_or(type = 'workspace.published') THEN 'workspace.published'
                      WHEN bool_or(type = 'workspace.reused') THEN 'workspace.reused'
                      WHEN bool_or(type = 'workspace.next-task-unchanged') THEN 'workspace.next-task-unchanged' END AS success
          FROM e GROUP BY ALL)
    SELECT user_id, day::VARCHAR AS day,
           CASE WHEN neg IS NOT NULL THEN 'discard' WHEN compiled AND rendered AND success IS NOT NULL THEN 'save' ELSE 'wait' END AS action,
           CASE WHEN neg IS NOT NULL THEN neg WHEN success IS NULL THEN 'no-success-signal'
                WHEN compiled AND rendered THEN success ELSE 'awaiting-compile-and-render' END AS reason
    FROM g""")
def revision_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.decide(revisions(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"]).withColumn("day", F.col("day").cast("string"))


@query("""SELECT doc_id AS id, lang AS style, source AS type FROM documents
          WHERE lang = 'en' AND source = 'src7' AND list_contains(string_split(text, ' '), 'the')""")
def catalog_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("style"), F.col("source").alias("type"), F.split("text", " ", -1).alias("use_when"))
    return catalog.find(entries, style="en", purpose="the", type="src7").select("id", "style", "type")


@query("""SELECT id, rule FROM (
            SELECT doc_id AS id, 'preserves' AS rule FROM documents WHERE len(string_split(text, ' ')) < 2
            UNION ALL SELECT doc_id, 'id_repeats' FROM documents GROUP BY doc_id HAVING count(*) > 1
            UNION ALL SELECT doc_id, 'type' FROM documents WHERE coalesce(lang NOT IN ('en', 'fr'), true))""")
def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "unit").when(F.col("lang") == "fr", "behaviour")
    return catalog.problems(docs.select(F.col("doc_id").alias("id"), kind.alias("type"), F.split("text", " ", -1).alias("preserves")))


@query("""SELECT c_custkey AS id FROM customer ANTI JOIN orders ON c_custkey = o_custkey""")
def catalog_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return catalog.unresolved(entries, tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("kind")))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
    SELECT s_nationkey::VARCHAR AS style, (place // 3)::INT AS page, string_agg(s_name || ' | ' || s_suppkey, chr(10) ORDER BY s_suppkey) AS text FROM r GROUP BY ALL""")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "supplier").withColumn("style", F.col("s_nationkey").cast("string"))
    return catalog.listing(rows, ["s_suppkey"], F.concat_ws(" | ", "s_name", F.col("s_suppkey").cast("string")), 3)


@query(f"""
    WITH s(shot_id, start, duration, premount) AS (VALUES (1::BIGINT, 0, 30, 0), (2, 20, 30, 10), (3, 60, 40, 15))
    SELECT event_id, shot_id, frame,
           CASE WHEN frame >= start AND frame < start + duration THEN 'active' ELSE 'premount' END AS phase,
           frame - start AS local_frame
    FROM {FRAMES} JOIN s ON frame >= start - premount AND frame < start + duration""")
def mount_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = tables.shots(spark, ((1, 0, 30, 0), (2, 20, 30, 10), (3, 60, 40, 15)))
    bounds = shots.withColumn("first", F.col("start") - F.col("premount")).withColumn("last", F.col("start") + F.col("duration"))
    rows = intervals.range_join(events(spark, sf_dir), bounds, "frame", "first", "last", 16, salts=8)
    phase = intervals.mount_phase(F.col("frame"), F.col("start"), F.col("duration"), F.col("premount"))
    return rows.select("event_id", "shot_id", "frame", phase.alias("phase"), (F.col("frame") - F.col("start")).alias("local_frame"))


@query(f"""
    WITH s(shot_id, start, duration) AS (VALUES (1::BIGINT, 0, 30), (2, 20, 30), (3, 60, 40)),
    e AS (SELECT event_id, frame, shot_id, frame - start AS x FROM {FRAMES} JOIN s ON frame >= start AND frame < start + duration)
    SELECT event_id, shot_id, round(x / 10.0, 6) + 0.0 AS opacity, round(x, 6) + 0.0 AS rotate FROM e WHERE x <= 10""")
def shot_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = tables.shots(spark, ((1, 0, 30, 0), (2, 20, 30, 0), (3, 60, 40, 0))).withColumn("last", F.col("start") + F.col("duration"))
    rows = intervals.range_join(events(spark, sf_dir), shots, "frame", "start", "last", 32, salts=8)
    local = F.col("frame") - F.col("start")
    return rows.filter(local <= 10).select("event_id", "shot_id", r6(tl.progress(local, 0, 10)).alias("opacity"), r6(local).alias("rotate"))


@query(f"""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS appear, l_partkey % 100 + l_quantity AS disappear FROM lineitem),
    f AS (SELECT DISTINCT frame FROM {FRAMES})
    SELECT frame, count(c.appear) AS n_visible FROM f LEFT JOIN c ON appear <= frame AND frame < disappear GROUP BY frame""")
def cue_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    appear = F.col("l_partkey") % 100
    cues = tables.read(spark, sf_dir, "lineitem").select(appear.alias("appear"), (appear + F.col("l_quantity")).alias("disappear"))
    frames = events(spark, sf_dir).select("frame").distinct()
    return intervals.presence(frames, cues, "frame", "appear", "disappear", 16).withColumnRenamed("n_present", "n_visible")


@query("""
    WITH c AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS idx, length(text) % 50 AS appear, 60 + turn * 3 AS disappear FROM conversations)
    SELECT conv_id, idx, (count(*) OVER (PARTITION BY conv_id, idx // 4))::INT AS group_size, (idx % 4)::INT AS slot,
           coalesce(appear < lag(appear) OVER o, false) AS ordered,
           disappear <> first_value(disappear) OVER (PARTITION BY conv_id, idx // 4 ORDER BY idx) AS shared_end,
           coalesce(idx % 4 = 0 AND lag(disappear) OVER o <> appear, false) AS handed_off
    FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY idx)""")
def cue_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("turn").over(intervals.Window.partitionBy("conv_id"))
    cues = tables.read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - first).alias("idx"), (F.length("text") % 50).alias("appear"), (60 + F.col("turn") * 3).alias("disappear"))
    return intervals.cue_violations(cues, ["conv_id"], "idx", "appear", "disappear").drop("appear", "disappear")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS e, coalesce(lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice), 0.0) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, floor(s / 1000 * 60 + 0.5)::BIGINT AS from_frame, floor(e / 1000 * 60 + 0.5)::BIGINT AS to_frame,
           floor(e / 1000 * 60 + 0.5)::BIGINT - floor(s / 1000 * 60 + 0.5)::BIGINT AS frames FROM s""")
def segment_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return intervals.segments_from_ends(rows, ["l_orderkey"], ["l_linenumber", "l_extendedprice"], "l_extendedprice", 60).drop("l_extendedprice")


@query("""SELECT event_id, floor(value / 1000 * 60 + 0.5)::BIGINT AS at_60, floor(value / 1000 * 30 + 0.5)::BIGINT AS at_30, round(30 * 60 / (60 + event_id % 90), 6) + 0.0 AS beat FROM events""")
def ms_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events")
    at = lambda fps: tl.milliseconds_to_frames(F.col("value"), fps).cast("long")
    return rows.select("event_id", at(60).alias("at_60"), at(30).alias("at_30"), r6(tl.frames_for_beat(30, 60 + F.col("event_id") % 90)).alias("beat"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS n FROM orders)
    SELECT o_custkey, o_orderkey, (n + 1)::INT AS rank, (n // 4)::INT AS page, (n % 4)::INT AS slot, (n % 4 * 6)::INT AS start, (72 - n % 4 * 6)::INT AS duration FROM r""")
def rank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return intervals.pages(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).drop("o_totalprice")


@query("""
    WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT o_custkey, ceil(n / 4)::BIGINT * 72 AS ranking, ceil(n / 4)::BIGINT * 72 - 20 AS transition, ceil(n / 4)::BIGINT * 72 + 40 AS duration FROM c""")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.read(spark, sf_dir, "orders").groupBy("o_custkey").count()
    return counts.select("o_custkey", intervals.page_totals(F.col("count")).alias("t")).select("o_custkey", "t.*")


@query(f"""SELECT floor(frame / 2)::BIGINT AS bucket, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM {FRAMES} GROUP BY 1""")
def frame_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(intervals.bucket(F.col("frame"), 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(f"""
    WITH b AS (SELECT event_id, frame, floor(frame / 22.3::DOUBLE)::BIGINT AS beat FROM {FRAMES})
    SELECT event_id, beat, round(frame - beat * 22.3::DOUBLE, 6) + 0.0 AS inside, beat % 4 AS variant,
           ['src0', 'src1', 'src2'][(beat % 3 + 1)::INT] AS source FROM b""")
def beat_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = intervals.bucket(F.col("frame"), 22.3)
    sources = F.array(F.lit("src0"), F.lit("src1"), F.lit("src2"))
    return events(spark, sf_dir).select("event_id", beat.alias("beat"), r6(F.col("frame") - beat * 22.3).alias("inside"), (beat % 4).alias("variant"), intervals.round_robin(sources, beat).alias("source"))


@query("""SELECT l_orderkey, l_linenumber, string_split(p_name, ' ')[((l_orderkey % len(string_split(p_name, ' '))) + 1)::INT] AS picked
          FROM lineitem JOIN part ON p_partkey = l_partkey""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = tables.read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ", -1).alias("names"))
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", intervals.round_robin(F.col("names"), F.col("l_orderkey")).alias("picked"))


def ladder(edge: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.col("value") / 10 - 3
        y = tl.interpolate(x, (0, 10, 20, 30), (0, 100, 50, 50), edge, edge, tl.ease_out_cubic if edge == "clamp" else tl.linear)
        return tables.read(spark, sf_dir, "events").select("event_id", r6(y).alias("y"))

    f.__name__ = f"interpolate_{edge}"
    return f


def ladder_sql(edge: str) -> str:
    cubic = "(1 - (1 - least(1, greatest(0, {0}))) * (1 - least(1, greatest(0, {0}))) * (1 - least(1, greatest(0, {0}))))" if edge == "clamp" else "({0})"
    value = {"extend": "x", "identity": "x", "clamp": "least(greatest(x, {a}), {b})", "wrap": "((((x - {a}) % 10) + 10) % 10 + {a})"}[edge]
    low, high = value.format(a=0, b=10), value.format(a=20, b=30)
    first = f"100 * {cubic.format(f'({low}) / 10')}"
    return f"""
    WITH v AS (SELECT event_id, value / 10 - 3 AS x FROM events)
    SELECT event_id, round(CASE WHEN x < 0 THEN {'x' if edge == 'identity' else first}
                                WHEN x <= 10 THEN 100 * {cubic.format('x / 10')}
                                WHEN x <= 20 THEN 100 + (50 - 100) * {cubic.format('(x - 10) / 10')}
                                WHEN x > 30 THEN {'x' if edge == 'identity' else '50'} ELSE 50 END, 6) + 0.0 AS y FROM v"""


for _edge in tl.EDGES:
    query(ladder_sql(_edge))(ladder(_edge))


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS x, least(1, greatest(0, l_discount * 12 - 0.1)) AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(1 - power(1 - c, 3), 6) + 0.0 AS cubic,
           round(1 + 2.70158 * power(c - 1, 3) + 1.70158 * power(c - 1, 2), 6) + 0.0 AS back,
           round(c * c * (3 - 2 * c), 6) + 0.0 AS smooth, round(x * x * (2.70158 * x - 1.70158), 6) + 0.0 AS ease_back,
           round(CASE WHEN x < 0.5 THEN (x * 2) * (x * 2) * (2.70158 * (x * 2) - 1.70158) / 2
                      ELSE 1 - ((1 - x) * 2) * ((1 - x) * 2) * (2.70158 * ((1 - x) * 2) - 1.70158) / 2 END, 6) + 0.0 AS in_out,
           round(-4 + (9 - -4) * x, 6) + 0.0 AS mixed FROM v""")
def easings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount") * 12 - 0.1
    outs = {"cubic": tl.ease_out_cubic(x), "back": tl.ease_out_back(x), "smooth": tl.smoothstep(x), "ease_back": tl.easing_back()(x), "in_out": tl.ease_in_out(tl.easing_back())(x), "mixed": tl.lerp(-4, 9, x)}
    return tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(r6(v).alias(k) for k, v in outs.items()))


@query("""
    WITH v AS (SELECT event_id, event_id % 97 AS f, user_id % 13 AS s FROM events),
    n AS (SELECT *, sin(f * 78.233 + s * 12.9898) * 43758.5453 AS a, sin(s * 12.9898 + floor(f / 2) * 78.233) * 43758.5453 AS b,
                 sin(s * 12.9898) * 43758.5453 AS c, sin(f * 127.1 + 311.7) * 43758.5453 AS d FROM v)
    SELECT event_id, round((a - floor(a)) * 2 - 1, 4) + 0.0 AS noise, round((b - floor(b) - 0.5) * 2 * 3, 4) + 0.0 AS boil,
           round((c - floor(c) - 0.5) * 2 * 5, 4) + 0.0 AS jitter, round(d - floor(d), 4) + 0.0 AS random FROM n""")
def noises(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = F.col("event_id") % 97, F.col("user_id") % 13
    r4 = lambda x: F.round(x, 4) + 0.0
    return tables.read(spark, sf_dir, "events").select("event_id", r4(noise.frame_noise(f, s)).alias("noise"), r4(noise.boil(s, f, 3)).alias("boil"), r4(noise.jitter(s, 5)).alias("jitter"), r4(noise.pseudo_random(f)).alias("random"))


@query("""
    WITH v AS (SELECT event_id, ((user_id * 7919 + (event_id % 1000 + 1) * 1831565813) % 4294967296)::HUGEINT AS s FROM events),
    a AS (SELECT event_id, (xor(s, s >> 15) * (s | 1)) % 4294967296 AS v FROM v),
    b AS (SELECT event_id, xor((v + (xor(v, v >> 7) * (v | 61)) % 4294967296) % 4294967296, v) AS v FROM a)
    SELECT event_id, xor(v, v >> 14)::DOUBLE / 4294967296.0 AS sample FROM b""")
def mulberry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", noise.mulberry(F.col("user_id") * 7919, F.col("event_id") % 1000).alias("sample"))


@query(f"""
    WITH p(p) AS (VALUES (0.0::DOUBLE), (310.0), (415.0), (1200.0), (1250.0)),
    t AS (SELECT event_id, frame / 30 * 1000 - p AS e FROM {FRAMES}, p)
    SELECT event_id, round(greatest(0, max(CASE WHEN e >= 0 AND e < 80 THEN 0.9 * (1 - e / 80) ELSE 0 END)), 6) + 0.0 AS exposure FROM t GROUP BY event_id""")
def exposure_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(*(F.lit(x) for x in (0.0, 310.0, 415.0, 1200.0, 1250.0)))
    return events(spark, sf_dir).select("event_id", r6(envelopes.exposure(F.col("frame") / 30 * 1000, points)).alias("exposure"))


@query(f"""
    WITH h(i, h) AS (VALUES (0, 0.0::DOUBLE), (1, 150.0), (2, 300.0), (3, 450.0), (4, 600.0)),
    t AS (SELECT event_id, i, frame - floor(h / 1000 * 60 + 0.5) AS e FROM {FRAMES}, h),
    d AS (SELECT *, e >= 0 AND e < 6 AS on, 1 - e / 6 AS left FROM t)
    SELECT event_id, round(sum(CASE WHEN on THEN sin((e + i * 13) * 5.7) * 34 * left ELSE 0 END), 6) + 0.0 AS x,
           round(sum(CASE WHEN on THEN cos((e + i * 7) * 6.3) * 34 * left ELSE 0 END), 6) + 0.0 AS y,
           round(sum(CASE WHEN on THEN sin((e + i * 5) * 7.1) * 1.4 * left ELSE 0 END), 6) + 0.0 AS rotate,
           round(greatest(0, max(CASE WHEN e < 0 THEN 0 WHEN e <= 1 THEN 0.85 + 0.05 * e WHEN e <= 5 THEN 0.9 * (1 - (e - 1) / 4) ELSE 0 END)), 6) + 0.0 AS burst
    FROM d GROUP BY event_id""".replace(" on,", ' "on",').replace("WHEN on ", 'WHEN "on" ').replace("AS left", 'AS "left"').replace("* left", '* "left"'))
def shake_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "frame", envelopes.shake(F.col("frame"), 60).alias("s"))
    return rows.select("event_id", *(r6(F.col(f"s.{c}")).alias(c) for c in ("x", "y", "rotate")), r6(envelopes.burst(F.col("frame"), 60)).alias("burst"))


@query("""
    WITH d AS (SELECT doc_id, text, length(text) AS n, doc_id % 60 - 10 + 1 AS steps FROM documents),
    c AS (SELECT *, CASE WHEN steps <= 0 THEN 0 ELSE least(n, (steps // 8) * 10 + coalesce(list_sum(list_slice([2, 1, 1, 0, 3, 1, 2, 0], 1, steps % 8)), 0)) END AS typed FROM d)
    SELECT doc_id, typed::INT AS typed, substr(text, 1, typed::INT) AS shown FROM c""")
def typing_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, frame = tables.read(spark, sf_dir, "documents"), F.col("doc_id") % 60
    return docs.select("doc_id", text.typed_count(frame, F.length("text")).alias("typed"), text.typed_text(F.col("text"), frame).alias("shown"))


@query("""
    WITH d AS (SELECT doc_id, doc_id % 90 AS f, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)
    SELECT doc_id, array_to_string(list_filter(ws, lambda w, i: f >= coalesce([0, 2, 3, 6, 7, 9, 13, 14, 18, 19, 23, 27][i], 27 + (i - 12) * 3)), ' ') AS shown FROM d""")
def word_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.reveal_words(F.col("text"), F.col("doc_id") % 90).alias("shown"))


@query("""
    SELECT l_orderkey, l_linenumber, floor(100 + l_linenumber + (4 + l_quantity) * (1 - power(1 - least(1, greatest(0, (l_partkey % 40 - 12) / 10.0::DOUBLE)), 3)) + 0.5)::BIGINT::VARCHAR AS score FROM lineitem""")
def score_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = tl.interpolate(F.col("l_partkey") % 40, (12, 22), (0, 1), "clamp", "clamp", tl.ease_out_cubic)
    return tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.score_text(100 + F.col("l_linenumber"), 4 + F.col("l_quantity"), tick).alias("score"))


@query("""
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    v AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - lo) / (hi - lo) AS v, count(*) OVER (PARTITION BY l_orderkey) AS n,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i FROM lineitem, b)
    SELECT l_orderkey, l_linenumber, round(110 + coalesce(i / nullif(n - 1, 0), 0) * 860, 6) + 0.0 AS x, round(420 + (1 - v) * 900, 6) + 0.0 AS y FROM v""")
def plot_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ends = lines.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    w = intervals.Window.partitionBy("l_orderkey")
    rows = lines.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("l_linenumber", "l_extendedprice")) - 1)
    rows = rows.join(F.broadcast(ends))  # one row
    x = 110 + F.coalesce(F.try_divide(F.col("i"), F.col("n") - 1), F.lit(0.0)) * 860
    y = 420 + (1 - (F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * 900
    return rows.select("l_orderkey", "l_linenumber", r6(x).alias("x"), r6(y).alias("y"))


@query("""SELECT doc_id, least(132, greatest(56, floor(CASE WHEN doc_id % 2 = 0 THEN 980 ELSE 500 END / (greatest(1, n_chars % 23) * 0.6::DOUBLE) + 0.5)))::DOUBLE AS size FROM documents""")
def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.greatest(F.lit(1), F.col("n_chars") % 23)
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.fitted_size(length, F.col("doc_id") % 2 == 0).alias("size"))


@query("""SELECT l_orderkey, count(l_suppkey) AS n, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY l_orderkey HAVING count(l_suppkey) <> count(DISTINCT l_suppkey)""")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.repeated_values(tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey")


TREE_SQL = """
    SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey AS ord, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS backend, r_regionkey <> 3 AS shown, r_regionkey * 5 AS start FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, n_nationkey % 7 <> 0, n_nationkey % 4 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey::INT, CASE WHEN c_custkey % 10 = 0 THEN c_name END, c_custkey % 11 <> 0, NULL FROM customer"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and their customers as one tree."""
    region, nation, customer = (tables.read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    top = region.select(name("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("ord"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("backend"), (F.col("r_regionkey") != 3).alias("shown"), (F.col("r_regionkey") * 5).alias("start"))
    mid = nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.col("n_nationkey") % 7 != 0, F.col("n_nationkey") % 4)
    low = customer.select(name("c", "c_custkey"), name("n", "c_nationkey"), F.col("c_custkey").cast("int"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")), F.col("c_custkey") % 11 != 0, F.lit(None).cast("int"))
    return top.union(mid).union(low)


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id, 0 AS depth, [ord] AS path FROM n WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, t.depth + 1, list_append(t.path, n.ord) FROM n JOIN t ON n.parent_id = t.node_id)
    SELECT node_id, depth, array_to_string(path, '/') AS path FROM t""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descend(nodes(spark, sf_dir)).select("node_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id, backend FROM n WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, coalesce(n.backend, t.backend) FROM n JOIN t ON n.parent_id = t.node_id)
    SELECT node_id, backend AS inherited_backend FROM t""")
def inherit_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.inherit(nodes(spark, sf_dir), ["backend"]).select("node_id", "inherited_backend")


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id FROM n WHERE parent_id IS NULL AND shown
      UNION ALL SELECT n.node_id FROM n JOIN t ON n.parent_id = t.node_id WHERE n.shown)
    SELECT node_id FROM t""")
def visibility_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.visible(nodes(spark, sf_dir), F.col("shown")).select("node_id")


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id, 40.0::DOUBLE AS local_frame, 40.0::DOUBLE - coalesce(start, 0) AS inside FROM n WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, t.inside, t.inside - coalesce(n.start, 0) FROM n JOIN t ON n.parent_id = t.node_id)
    SELECT node_id, local_frame FROM t""")
def tree_local_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.local_frames(nodes(spark, sf_dir), F.col("start"), F.lit(40.0)).select("node_id", "local_frame")


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id AS top, node_id FROM n UNION ALL SELECT t.top, n.node_id FROM n JOIN t ON n.parent_id = t.node_id)
    SELECT top AS node_id, count(*) AS size FROM t GROUP BY top""")
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_sizes(nodes(spark, sf_dir))


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), t AS (
      SELECT node_id, node_id AS top FROM n UNION ALL SELECT n.node_id, t.top FROM n JOIN t ON n.parent_id = t.node_id),
    o AS (SELECT 'n' || (o_custkey % 25) AS upper, 'c' || o_custkey AS lower, count(*) AS n FROM orders GROUP BY ALL)
    SELECT upper, lower, o.n::BIGINT AS orders, EXISTS (SELECT 1 FROM t WHERE t.node_id = o.lower AND t.top = o.upper) AS contained FROM o""")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders, and whether they are below the nation that their number names: pre-order ranges decide."""
    pairs = tables.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    pairs = pairs.select(name("n", F.col("o_custkey") % 25).alias("upper"), name("c", F.col("o_custkey")).alias("lower"), "orders")
    return tree.contains(tree.toured(nodes(spark, sf_dir)), pairs)


@query(f"""
    WITH RECURSIVE n AS ({TREE_SQL}), v AS (SELECT n.node_id, n.parent_id, coalesce(c.cents, 0) AS cents FROM n LEFT JOIN (SELECT 'c' || c_custkey AS node_id, round(c_acctbal * 100)::BIGINT AS cents FROM customer) c USING (node_id)),
    t AS (SELECT node_id, node_id AS top, cents FROM v UNION ALL SELECT v.node_id, t.top, v.cents FROM v JOIN t ON v.parent_id = t.node_id)
    SELECT top AS node_id, sum(cents)::BIGINT AS total FROM t GROUP BY top""")
def subtree_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all customers below each node of the tree have, in cents."""
    cents = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return tree.subtree_sums(tree.toured(nodes(spark, sf_dir).join(cents.hint("merge"), "node_id", "left")), "cents")


VERSION_SQL = """SELECT node_id, parent_id, CASE WHEN node_id LIKE 'c%7' OR node_id = 'n4' THEN coalesce(backend, '') || '!' ELSE backend END AS backend FROM n WHERE node_id NOT LIKE 'c%13' AND node_id <> 'n6' AND coalesce(parent_id, '') <> 'n6'
    UNION ALL SELECT 'x' || node_id, node_id, NULL FROM n WHERE node_id LIKE 'n%2' UNION ALL SELECT 'y' || node_id, 'x' || node_id, 'new' FROM n WHERE node_id LIKE 'n%2'"""


@query(f"""
    WITH n AS ({TREE_SQL}), v AS ({VERSION_SQL})
    SELECT node_id, 'changed' AS change FROM n JOIN v USING (node_id) WHERE n.backend IS DISTINCT FROM v.backend
    UNION ALL SELECT n.node_id, 'removed' FROM n WHERE node_id NOT IN (SELECT node_id FROM v) AND parent_id IN (SELECT node_id FROM v)
    UNION ALL SELECT v.node_id, 'added' FROM v WHERE node_id NOT IN (SELECT node_id FROM n) AND parent_id IN (SELECT node_id FROM n)""")
def changed_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second version of the tree has changed: digests say where to look."""
    own = tables.kept(nodes(spark, sf_dir).select("node_id", "parent_id", "ord", "backend"))
    touched = F.col("node_id").rlike("^c.*7$") | (F.col("node_id") == "n4")
    kept = own.filter(~F.col("node_id").rlike("^c.*13$") & (F.col("node_id") != "n6") & (F.coalesce("parent_id", F.lit("")) != "n6"))
    kept = kept.withColumn("backend", F.when(touched, F.concat(F.coalesce("backend", F.lit("")), F.lit("!"))).otherwise(F.col("backend")))
    grown = own.filter(F.col("node_id").rlike("^n.*2$"))
    new = grown.select(F.concat(F.lit("x"), "node_id").alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("backend"))
    newer = grown.select(F.concat(F.lit("y"), "node_id").alias("node_id"), F.concat(F.lit("x"), "node_id").alias("parent_id"), F.lit(0).alias("ord"), F.lit("new").alias("backend"))
    sides = [merkle.signed(t, merkle.record_digest("node_id", "backend")) for t in (own, kept.unionByName(new).unionByName(newer))]
    return merkle.changes(*sides).select(F.coalesce("left_id", "right_id").alias("node_id"), "change")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_type || (event_id % 3) AS kind, event_id % 4 = 0 AS gone FROM events),
    r AS (
      SELECT user_id, -1::BIGINT AS n, []::VARCHAR[] AS base, []::VARCHAR[] AS now, false AS bad FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, n, base, CASE WHEN gone THEN list_filter(now, lambda x: x <> kind) WHEN list_contains(now, kind) THEN now ELSE list_append(now, kind) END, bad OR (NOT gone AND list_contains(now, kind))
      FROM (SELECT e.user_id, e.n, e.kind, e.gone, CASE WHEN e.n % 3 = 0 THEN CASE WHEN r.bad THEN r.base ELSE r.now END ELSE r.base END AS base,
                   CASE WHEN e.n % 3 = 0 AND r.bad THEN r.base ELSE r.now END AS now, CASE WHEN e.n % 3 = 0 THEN false ELSE r.bad END AS bad
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)),
    last AS (SELECT user_id, arg_max(CASE WHEN bad THEN base ELSE now END, n) AS kinds FROM r GROUP BY user_id)
    SELECT user_id, unnest(kinds) AS kind FROM last""")
def behaviours_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviours that users' units have after a log of batches of three operations, some of which break a rule and leave
    no trace."""
    rows, i = tables.read(spark, sf_dir, "events"), F.col("event_id")
    n = F.row_number().over(intervals.Window.partitionBy("user_id").orderBy("event_id")) - 1
    ops = rows.select(F.col("user_id").cast("string").alias("tree"), F.floor(n / 3).alias("batch"), n.alias("seq"), F.when(i % 4 == 0, "remove").otherwise("behaviour").alias("op"), F.lit("u").alias("unit"), F.concat("event_type", (i % 3).cast("string")).alias("arg"))
    born = rows.select(F.col("user_id").cast("string").alias("tree"), F.lit(-1).cast("long").alias("batch"), F.lit(0).alias("seq"), F.lit("unit").alias("op"), F.lit("u").alias("unit"), F.lit(None).cast("string").alias("arg")).distinct()
    outcome = mutations.judged(born.unionByName(ops))
    return mutations.behaviours_at(outcome).select(F.col("tree").cast("long").alias("user_id"), "kind")


def kinds_sql() -> str:
    rows = [f"('{kind}', {('NULL' if base == 'unit' else repr(base))})" for base, _, own in (x.partition(": ") for x in catalog.lines("kinds.txt")) for kind in own.split(", ")]
    return f"(VALUES {', '.join(rows)}) AS k(kind, base)"


@query(f"""
    WITH RECURSIVE k AS (SELECT *, row_number() OVER (ORDER BY kind) - 1 AS n FROM {kinds_sql()}),
    t AS (SELECT kind, kind AS above, 0 AS depth FROM k UNION ALL SELECT t.kind, k.base, depth + 1 FROM t JOIN k ON k.kind = t.above WHERE k.base IS NOT NULL),
    b AS (SELECT kind, max(depth)::BIGINT AS depth, arg_max(above, depth) AS top FROM t GROUP BY kind),
    e AS (SELECT event_id % (SELECT count(*) + 5 FROM k) AS n, count(*) AS events FROM events GROUP BY 1)
    SELECT k.kind, b.top, b.depth, coalesce(e.events, 0) AS events FROM k JOIN b USING (kind) LEFT JOIN e USING (n)""")
def kind_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of unit with the base at the top of its line, how far above that is, and how many events name it."""
    own = catalog.kinds(spark).filter("base <> 'behaviour'").select(F.expr("substr(kind, 6)").alias("node_id"), F.when(F.col("base") != "unit", F.expr("substr(base, 6)")).alias("parent_id"))
    placed = own.withColumn("n", F.row_number().over(intervals.Window.orderBy("node_id")) - 1)  # an authored list
    n = placed.count()
    found = tree.lift(placed, {})
    named = tables.read(spark, sf_dir, "events").groupBy((F.col("event_id") % (n + 5)).alias("n")).agg(F.count(F.lit(1)).alias("events"))
    return found.join(named, "n", "left").select(F.col("node_id").alias("kind"), F.col("root_id").alias("top"), "depth", F.coalesce("events", F.lit(0)).alias("events"))


def builders_sql() -> str:
    """The parts of each builder's scene in SQL, made from the lines of its file: builder, role, kind, parent and laws."""
    rows = []
    for name, own in builders.builders().items():
        laws_of = lambda role, own=own: "[" + ", ".join("'" + law.split("/")[0] + "'" for r, law in own.laws if r == role) + "]::VARCHAR[]"
        kinds = {"self": own.kind} | {p["role"]: p["kind"] for p in own.parts}
        rows.append(f"('{name}', 'self', '{own.kind}', NULL, {laws_of('self')})")
        rows += [f"('{name}', '{p['role']}', '{p['kind']}', '{kinds[p['parent'] or 'self']}', {laws_of(p['role'])})" for p in own.parts]
    return f"(VALUES {', '.join(rows)}) AS b(builder, role, kind, above, laws)"


_builders = sorted(builders.builders())


@query(f"""
    WITH e AS (SELECT (list_sort([{", ".join(f"'{b}'" for b in _builders)}]) || ['noBuilder'])[event_id % {len(_builders) + 1} + 1] AS builder, count(*) AS events FROM events GROUP BY 1)
    SELECT b.builder, b.role, b.kind, b.above, array_to_string(list_sort(b.laws), ',') AS laws, coalesce(e.events, 0) AS events FROM {builders_sql()} LEFT JOIN e USING (builder)""")
def builder_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each builder's scene, as built: the kind above each, the laws that move it, and the events that ask for it."""
    parts = []
    for name in _builders:
        own = builders.builders()[name]
        many = {p["times"] for p in own.parts if p["times"]}
        nodes, attached = builders.rows(name, **{p: ["one"] if p in many else "recipe" if p == "recipe" else "x" for p in own.parameters})
        kinds, parents = {n[0]: n[3] for n in nodes}, {n[0]: n[1] for n in nodes}
        for number, _, _, kind, props in nodes:
            # Parts that come several times are one part of the scene.
            made = (name, props["role"], kind, kinds.get(parents[number]), ",".join(sorted(law.split("/")[0] for at, _, law in attached if at == number)))
            if made not in parts:
                parts.append(made)
    named = F.element_at(F.array(*map(F.lit, [*_builders, "noBuilder"])), (F.col("event_id") % (len(_builders) + 1) + 1).cast("int"))
    asked_for = tables.read(spark, sf_dir, "events").groupBy(named.alias("builder")).agg(F.count(F.lit(1)).alias("events"))
    rows = spark.createDataFrame(parts, "builder string, role string, kind string, above string, laws string")
    return rows.join(asked_for, "builder", "left").select("builder", "role", "kind", "above", "laws", F.coalesce("events", F.lit(0)).alias("events"))


def swaying(columns: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A law of a user's own: a sway that dies away, and the side that it is on."""
    left = np.exp(-columns["frame"] / columns["duration"])
    return {"x": np.cos(columns["frame"] * 0.25) * 40 * left, "side": np.where(np.cos(columns["frame"] * 0.25) < 0, "left", "right")}


@query(f"""
    SELECT event_id, round(cos(frame * 0.25) * 40 * exp(-frame / (60 + event_id % 5 * 60)), 6) + 0.0 AS x, CASE WHEN cos(frame * 0.25) < 0 THEN 'left' ELSE 'right' END AS side FROM {FRAMES}""")
def extension_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law that isn't the library's, registered and called from SQL."""
    extensions.register(spark, "example.sway", swaying, {"x": "double", "side": "string"})
    places = events(spark, sf_dir).select(F.col("event_id").alias("id"), "frame", (60.0 + F.col("event_id") % 5 * 60).alias("duration"))
    return extensions.channels(spark, "example.sway", places).select(F.col("id").alias("event_id"), r6(F.col("x")).alias("x"), "side")


PROPS_SQL = "event_id, json_extract(props, '$.k')::BIGINT AS k, event_id % 3 AS r"


@query(f"""
    WITH v AS (SELECT {PROPS_SQL} FROM events)
    SELECT event_id, '$.a[1].n' AS path FROM v WHERE r = 1 UNION ALL SELECT event_id, '$.b' FROM v WHERE k % 2 = 0 AND r = 2
    UNION ALL SELECT event_id, '$["new key"]' FROM v WHERE k % 5 = 0""")
def props_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths at which two writings of events' properties differ, whatever the order of their keys."""
    k, r = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    one = text('{"k":', k, ',"b":null,"a":[', F.col("event_id"), ',{"n":', k, ',"m":"x"}]}')
    b = F.when((r == 2) & (k.cast("int") % 2 == 0), "").otherwise('"b":null,')
    extra = F.when(k.cast("int") % 5 == 0, ',"new key":[]').otherwise("")
    other = text('{"a":[', F.col("event_id"), ',{"m":"x","n":', F.when(r == 1, k.cast("int") + 1).otherwise(k.cast("int")), "}],", b, '"k":', k, extra, "}")
    rows = tables.read(spark, sf_dir, "events")
    left, right = (rows.select("event_id", F.parse_json(x).alias("v")) for x in (one, other))
    return plain.disagreements(left, right, ["event_id"], "v").select("event_id", "path")


@query("""
    WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
    t AS (SELECT event_id, ['object', '3', 'a', 'array', '2', 'item', 'number', event_id::VARCHAR, 'item', 'null', 'k', 'number', k, 'é', 'object', '1', 'z', 'string', 'k' || k] AS tokens FROM v)
    SELECT event_id, sha256(array_to_string([strlen(x)::VARCHAR || ':' || x for x in tokens], '')) AS digest FROM t""")
def props_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of nested values, which the order of their keys doesn't change."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"é":{"z":"k'), k, F.lit('"},"k":'), k, F.lit(',"a":['), F.col("event_id").cast("string"), F.lit(",null]}"))
    rows = tables.read(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))
    return rows.select("event_id", plain.digest(F.col("v"), 2).alias("digest"))


@query(f"""WITH n AS ({TREE_SQL}), m AS (SELECT * FROM n UNION ALL SELECT node_id, parent_id, ord + 1, backend, shown, start FROM n WHERE node_id IN ('n3', 'c5') UNION ALL SELECT 'x', 'y', 0, NULL, true, 0 UNION ALL SELECT 'z', 'z', 0, NULL, true, 0)
    SELECT node_id, 'duplicate' AS rule FROM m GROUP BY node_id HAVING count(*) > 1
    UNION ALL SELECT node_id, 'orphan' FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM m)
    UNION ALL SELECT node_id, 'self' FROM m WHERE parent_id = node_id
    UNION ALL SELECT max(node_id), 'shared_place' FROM m GROUP BY parent_id, ord HAVING count(*) > 1""")
def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir)
    twice = rows.filter(F.col("node_id").isin("n3", "c5")).withColumn("ord", F.col("ord") + 1)
    odd = spark.createDataFrame([("x", "y", 0, None, True, 0), ("z", "z", 0, None, True, 0)], rows.schema)
    return tree.violations(rows.unionByName(twice).unionByName(odd))


@query("""
    SELECT p_partkey, r::INT AS row, c::INT AS col, ((r + c) % 2)::INT AS parity FROM part, range(10) a(r), range(6) b(c) WHERE r < p_size % 5 + 1 AND c < p_partkey % 4 + 1""")
def grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a grid for each part, as many rows and columns as the part says."""
    rows = tables.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("rows"), (F.col("p_partkey") % 4 + 1).cast("int").alias("cols"))
    return intervals.grids(rows, F.col("rows"), F.col("cols")).select("p_partkey", "row", "col", "parity")


@query("""
    WITH v AS (SELECT event_id, event_id * 1237 AS f, (24 + user_id % 3 * 6) AS fps FROM events)
    SELECT event_id, lpad((f // fps // 3600)::VARCHAR, greatest(2, length((f // fps // 3600)::VARCHAR))::INT, '0') || ':' || lpad((f // fps // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((f // fps % 60)::VARCHAR, 2, '0') || ':' || lpad((f % fps)::VARCHAR, 2, '0') AS timecode FROM v""")
def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", text.timecode(F.col("event_id") * 1237, (24 + F.col("user_id") % 3 * 6).cast("double")).alias("timecode"))


@query("""
    WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN md5(props) || md5(event_type) WHEN 1 THEN substr(md5(props) || md5(props), 1, 40) WHEN 2 THEN event_type || '-' || user_id
                                     WHEN 3 THEN event_type || chr(10) ELSE ':' || event_type END AS id FROM events)
    SELECT event_id, regexp_full_match(id, '[a-zA-Z0-9._-]{1,160}') AS safe, regexp_full_match(id, '[a-f0-9]{64}') AS sha256, regexp_full_match(id, '([a-f0-9]{40}|[a-f0-9]{64})') AS git,
           regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS key, length(id) > 0 AND NOT regexp_matches(id, '[\\x00-\\x1f\\x7f]') AS media FROM v""")
def id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda c: F.md5(F.col(c).cast("binary"))
    kind = F.col("event_id") % 5
    name = (
        F.when(kind == 0, F.concat(hashed("props"), hashed("event_type")))
        .when(kind == 1, F.substring(F.concat(hashed("props"), hashed("props")), 1, 40))
        .when(kind == 2, F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
        .when(kind == 3, F.concat("event_type", F.lit("\n")))
        .otherwise(F.concat(F.lit(":"), "event_type"))
    )
    checks = {"safe": text.is_safe_id, "sha256": text.is_sha256, "git": text.is_commit, "key": text.is_reconciliation_key, "media": text.is_media_resource}
    return tables.read(spark, sf_dir, "events").select("event_id", *(f(name).alias(k) for k, f in checks.items()))


@query("""
    WITH RECURSIVE c AS (SELECT 12.0::DOUBLE AS d, 0.8::DOUBLE AS m, 140.0::DOUBLE AS k, 60.0::DOUBLE AS fps),
    p AS (SELECT d / (2 * sqrt(k * m)) AS z, sqrt(k / m) AS w, sqrt(k / m) * sqrt(1 - power(d / (2 * sqrt(k * m)), 2)) AS wd, fps FROM c),
    s AS (SELECT 0 AS f, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v
          UNION ALL
          SELECT f + 1, 1 - g, z * w * g - e * (cos(wd * dt) * (-v + z * w * (1 - x)) - wd * (1 - x) * sin(wd * dt))
          FROM (SELECT *, exp(-z * w * dt) AS e, exp(-z * w * dt) * (sin(wd * dt) * ((-v + z * w * (1 - x)) / wd) + (1 - x) * cos(wd * dt)) AS g
                FROM (SELECT s.*, p.*, 1 / fps AS dt FROM s, p WHERE f < 60)))
    SELECT event_id, round(x, 6) + 0.0 AS spring FROM events JOIN s ON f = event_id % 61""")
def spring_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", r6(tl.spring(F.col("event_id") % 61, 60, tl.Spring(12, 0.8, 140))).alias("spring"))


def bezier_sql(x1: float, y1: float, x2: float, y2: float) -> str:
    """Bisection to full precision: another way to the same curve."""
    steps = "SELECT event_id, v, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS k FROM b"
    at = f"(((1 - 3 * {x2} + 3 * {x1}) * m + (3 * {x2} - 6 * {x1})) * m + 3 * {x1}) * m"
    y = f"(((1 - 3 * {y2} + 3 * {y1}) * t + (3 * {y2} - 6 * {y1})) * t + 3 * {y1}) * t"
    return f"""
    WITH RECURSIVE b AS (SELECT event_id, (event_id * 37 % 101) / 100.0::DOUBLE AS v FROM events),
    s AS ({steps} UNION ALL SELECT event_id, v, CASE WHEN {at} > v THEN lo ELSE m END, CASE WHEN {at} > v THEN m ELSE hi END, k + 1
          FROM (SELECT *, (lo + hi) / 2 AS m FROM s WHERE k < 50))
    SELECT event_id, round({y}, 4) + 0.0 AS y FROM (SELECT event_id, (lo + hi) / 2 AS t FROM s WHERE k = 50)"""


@query(bezier_sql(0.42, 0.0, 0.58, 1.0))
def bezier_ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("event_id") * 37 % 101) / 100.0
    return tables.read(spark, sf_dir, "events").select("event_id", (F.round(tl.cubic_bezier(0.42, 0.0, 0.58, 1.0)(v), 4) + 0.0).alias("y"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(DISTINCT value::INT % 3) > 1""")
def determinism_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events").withColumn("out", F.rint("value").cast("int") % 3)
    return determinism.drift(rows, ["user_id", "event_type"], ["out"])


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, value::INT % 3 AS out FROM events),
    f AS (SELECT *, arg_min(out, event_id) OVER (PARTITION BY user_id, event_type) AS wanted FROM e)
    SELECT user_id, event_type, min(event_id) AS first_drift FROM f WHERE out <> wanted GROUP BY user_id, event_type""")
def drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation that first differed, of each address that didn't repeat, told as it came in."""
    rows = tables.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.rint("value").cast("int") % 3).alias("out"))
    found = streamed(spark, rows, "event_id", lambda part: sessions.drifts(part, F.col("user_id"), ["event_type"], "event_id", ["out"]))
    return found.select(F.col("root").cast("long").alias("user_id"), F.get_json_object("address", "$.event_type").alias("event_type"), F.col("seq").alias("first_drift"))


def lanes_sql() -> str:
    """Four lanes of multiply and shift over UTF-16 units in DuckDB, for texts of the first plane."""
    step = lambda prime: f"lambda s, x: xor((xor(s, x) * {prime}) & 4294967295, ((xor(s, x) * {prime}) & 4294967295) >> 16)"
    return " || ".join(f"lpad(lower(hex(list_reduce(list_prepend({start}::UBIGINT, codes), {step(f'{prime}::UBIGINT')}))), 8, '0')" for start, prime in noise.LANES)


@query(f"""
    WITH t AS (SELECT event_id, [event_type, user_id::VARCHAR, props] AS tokens FROM events),
    c AS (SELECT event_id, flatten([list_concat([length(t)], [unicode(x) for x in string_split(t, '')], [{noise.END}]) for t in tokens])::UBIGINT[] AS codes FROM t)
    SELECT event_id, {lanes_sql()} AS digest FROM c""")
def token_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events")
    return rows.select("event_id", noise.batch_hash(F.array("event_type", F.col("user_id").cast("string"), "props")).alias("digest"))


@query("""
    WITH s AS (SELECT o_custkey, o_orderdate::DATE AS at, min(o_totalprice) AS price FROM orders GROUP BY ALL),
    p AS (SELECT event_id, user_id, ts::DATE AS at FROM events)
    SELECT event_id, price FROM p ASOF LEFT JOIN s ON p.user_id = s.o_custkey AND p.at >= s.at""")
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("day")).agg(F.min("o_totalprice").alias("price"))
    points = tables.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("at"))
    return intervals.as_of(points, steps, ["user_id"], "at", "day", "price").select("event_id", "price")


@query("""
    WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(sum(w + 18) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x FROM g""")
def running_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return intervals.running_offsets(rows, ["l_orderkey"], ["l_linenumber", "l_quantity"], "l_quantity").drop("l_quantity")


def lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for leases from events: a revision is some days of a user. Workers hold the token of one of
    a revision's first leases, so that some are stale."""
    rows = revisions(spark, sf_dir)
    ask = F.when(F.col("type") == "neutral", F.element_at(F.array(*map(F.lit, ("acquire", "heartbeat", "checkpoint", "commit", "release"))), (F.col("event_id") % 5 + 1).cast("int"))).otherwise("event")
    revision = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMM"), F.floor(F.dayofmonth("day") / 5).cast("string"))
    fence = F.col("event_id") % 3 + 1
    return rows.select(
        revision.alias("revision_id"),
        F.col("event_id").alias("seq"),
        ask.alias("request"),
        (F.col("event_id") * 1000 + 1_000_000).alias("at"),
        "type",
        F.concat(F.lit("lease-"), revision, F.lit("-"), fence.cast("string")).alias("token"),
        fence.cast("long").alias("fence"),
        F.concat(F.lit("commit-"), F.col("event_id").cast("string")).alias("commit"),
    )


SUCCESS_SQL = ", ".join(f"'{x}'" for x in outcome.SUCCESS)
#: The same requests in SQL.
REQUESTS_SQL = f"""
    SELECT user_id || '-' || strftime(day, '%Y%m') || '-' || (dayofmonth(day) // 5) AS revision_id, event_id AS seq, event_id * 1000 + 1000000 AS t, event_id % 3 + 1 AS held, 'commit-' || event_id AS commit_id, type,
           CASE WHEN type = 'neutral' THEN ['acquire', 'heartbeat', 'checkpoint', 'commit', 'release'][event_id % 5 + 1] ELSE 'event' END AS request
    FROM (SELECT user_id, ts::DATE AS day, event_id, {KIND_SQL} AS type FROM events)"""


def logged(spark: SparkSession, rows: DataFrame, at: str, commits: int = 3) -> Iterator[str]:
    """The rows in an event log, a range of `at` more each time that its path is given."""
    event_log.register(spark)
    path = f"{tables.scratch(spark)}/log"
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    cuts = [None, *(ends["low"] + (ends["high"] - ends["low"]) * k // commits for k in range(1, commits)), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows if low is None else rows.filter(F.col(at) > low)
        part = part if high is None else part.filter(F.col(at) <= high)
        part.write.format("event_log").mode("append").save(path)
        yield path


def streamed(spark: SparkSession, rows: DataFrame, at: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the rows has written after as many runs as there were commits, each of which went
    on from the checkpoint of the one before."""
    folder = tables.scratch(spark)
    for path in logged(spark, rows, at):
        made = stream(spark.readStream.format("event_log").load(path))
        # Not availableNow, which for a Python source leaves out the last batch, the one that only moves timers.
        going = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(processingTime="0 seconds").start(f"{folder}/out")
        going.processAllAvailable()
        going.stop()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


@query(f"""
    WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY seq) AS n FROM ({REQUESTS_SQL})),
    r AS (
      SELECT revision_id, 0::BIGINT AS n, NULL::VARCHAR AS neg, []::VARCHAR[] AS seen, 0::BIGINT AS fence, false AS live, 0::BIGINT AS ends_at, false AS done, NULL::VARCHAR AS kept, false AS void,
             NULL::BIGINT AS lapsed, 0::BIGINT AS seq, '' AS request, '' AS status, '' AS reason, false AS granted FROM (SELECT DISTINCT revision_id FROM q)
      UNION ALL
      SELECT revision_id, n, neg, seen,
             fence + (status = 'acquired')::INT, CASE WHEN status = 'acquired' THEN true WHEN status IN ('released', 'committed') OR (request = 'event' AND type IN ({NEGATIVE_SQL})) THEN false ELSE live END,
             CASE WHEN status IN ('acquired', 'extended') THEN t + 60000 ELSE ends_at END, done OR status = 'committed', CASE WHEN status = 'committed' THEN commit_id ELSE kept END, void OR status = 'retract',
             lapsed, seq, request, status,
             CASE WHEN status IN ('extended', 'released', 'ignored') THEN '' WHEN status = 'stale' THEN 'stale-or-expired-lease' WHEN status = 'committed' THEN commit_id WHEN status = 'retract' THEN coalesce(kept, '') WHEN status = 'recorded' THEN type ELSE because END,
             status = 'acquired'
      FROM (
        SELECT *, CASE
                 WHEN request = 'event' THEN CASE WHEN type IN ({NEGATIVE_SQL}) AND done AND NOT void THEN 'retract' ELSE 'recorded' END
                 WHEN request = 'acquire' THEN CASE WHEN neg IS NOT NULL THEN 'discarded' WHEN NOT save THEN 'waiting' WHEN done THEN 'completed' WHEN live THEN 'busy' ELSE 'acquired' END
                 WHEN request = 'release' THEN CASE WHEN live AND held = fence THEN 'released' ELSE 'ignored' END
                 WHEN NOT save THEN 'canceled' WHEN NOT (live AND held = fence) THEN 'stale'
                 WHEN request = 'heartbeat' THEN 'extended' WHEN request = 'checkpoint' THEN 'active' ELSE 'committed' END AS status
        FROM (
          SELECT *, neg IS NULL AND best IS NOT NULL AND ready AS save,
                 CASE WHEN neg IS NOT NULL THEN neg WHEN best IS NULL THEN 'no-success-signal' WHEN ready THEN best ELSE 'awaiting-compile-and-render' END AS because
          FROM (
            SELECT *, list_filter([{SUCCESS_SQL}], lambda x: list_contains(seen, x))[1] AS best, list_contains(seen, 'compile.succeeded') AND list_contains(seen, 'render.succeeded') AS ready
            FROM (
              SELECT r.revision_id, q.n, q.seq, q.t, q.request, q.type, q.held, q.commit_id, r.fence, r.ends_at, r.done, r.kept, r.void,
                     coalesce(r.neg, CASE WHEN q.request = 'event' AND q.type IN ({NEGATIVE_SQL}) THEN q.type END) AS neg,
                     CASE WHEN q.request = 'event' THEN list_append(r.seen, q.type) ELSE r.seen END AS seen,
                     r.live AND r.ends_at > q.t AS live, CASE WHEN r.live AND r.ends_at <= q.t THEN r.ends_at END AS lapsed
              FROM r JOIN q ON q.revision_id = r.revision_id AND q.n = r.n + 1))))),
    ends AS (SELECT *, max(n) OVER (PARTITION BY revision_id) AS last, (SELECT max(t) FROM q) - 1500 AS clock FROM r)
    SELECT revision_id, seq, request, status, reason, CASE WHEN granted THEN 'lease-' || revision_id || '-' || fence END AS token, fence FROM r WHERE n > 0
    UNION ALL SELECT revision_id, lapsed, 'timer', 'expired', '', 'lease-' || revision_id || '-' || (fence - granted::INT), fence - granted::INT FROM r WHERE lapsed IS NOT NULL
    UNION ALL SELECT revision_id, ends_at, 'timer', 'expired', '', 'lease-' || revision_id || '-' || fence, fence FROM ends WHERE n = last AND live AND ends_at <= clock""")
def lease_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the authority to a stream of requests, and leases that ran out, some of them with nothing to show it."""
    return streamed(spark, lease_requests(spark, sf_dir), "at", lambda rows: authority.authority(rows, late="1500 milliseconds"))


@query("""
    WITH b AS (SELECT event_id, user_id, event_id % 3 AS fence, event_id * 100 AS t, CASE WHEN event_id % 101 <> 0 THEN event_id * 100 + event_id % 97 * 120 END AS answered_at FROM events),
    g AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY user_id, fence ORDER BY t), t - 1000) AS last FROM b),
    s AS (SELECT *, CASE WHEN t - last >= 60000 THEN 'expired' WHEN answered_at IS NULL OR answered_at - t > 10000 THEN 'timeout' ELSE 'extended' END AS own FROM g)
    SELECT event_id, CASE WHEN coalesce(bool_or(own <> 'extended') OVER (PARTITION BY user_id, fence ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'lost' ELSE own END AS status FROM s""")
def lease_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lease.watched(heartbeats(spark, sf_dir)).select("event_id", "status")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") * 100
    beats = tables.read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("revision_id"), (F.col("event_id") % 3).alias("fence"), at.alias("at"),
        F.when(F.col("event_id") % 101 != 0, at + F.col("event_id") % 97 * 120).alias("answered_at"),
    )
    first = beats.groupBy("revision_id", "fence").agg((F.min("at") - 1000).alias("granted_at"))
    return beats.join(first, ["revision_id", "fence"])


@query("""
    WITH b AS (SELECT user_id, event_id % 3 AS fence, event_id * 100 + 1000000 AS t, CASE WHEN event_id % 101 <> 0 THEN event_id * 100 + 1000000 + event_id % 97 * 120 END AS answered_at FROM events),
    g AS (SELECT *, coalesce(lag(t) OVER w, t - 1000) AS last, lead(t) OVER w AS next FROM b WINDOW w AS (PARTITION BY user_id, fence ORDER BY t)),
    s AS (SELECT *, CASE WHEN t - last >= 60000 THEN 'expired' WHEN answered_at IS NULL OR answered_at - t > 10000 THEN 'timeout' ELSE 'extended' END AS own FROM g),
    a AS (SELECT *, CASE WHEN coalesce(bool_or(own <> 'extended') OVER (PARTITION BY user_id, fence ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'lost' ELSE own END AS status FROM s)
    SELECT user_id::VARCHAR AS revision_id, fence::BIGINT AS fence, t AS at, status FROM a
    UNION ALL SELECT user_id::VARCHAR, fence::BIGINT, t + 60000, 'lapsed' FROM a WHERE status = 'extended' AND (next - t >= 60000 OR (next IS NULL AND t + 60000 <= (SELECT max(t) FROM b) - 1050))""")
def lease_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats as a stream: their statuses, and leases that lapsed when nothing arrived."""
    later = {c: F.col(c) + 1_000_000 for c in ("at", "answered_at", "granted_at")}  # no row at the epoch, where watermarks start
    rows = heartbeats(spark, sf_dir).drop("event_id").withColumns(later).withColumn("revision_id", F.col("revision_id").cast("string"))
    return streamed(spark, rows, "at", lambda beats: authority.monitor(beats, late="1050 milliseconds"))


@query("""
    WITH e AS (SELECT event_id AS i FROM events),
    f AS (SELECT i, CASE WHEN i % 11 = 0 THEN 'source.immutable' WHEN i % 7 = 0 THEN 'lease.fence' WHEN i % 23 = 0 THEN 'sealed.candidate_id' WHEN i % 9 = 0 THEN 'review.render'
                         WHEN i % 8 = 0 THEN 'commit.committed' WHEN i % 10 = 0 THEN 'commit.applied' END AS unmet FROM e)
    SELECT i AS event_id,
           CASE WHEN i % 17 = 0 OR i % 13 = 1 OR (i % 13 <> 0 AND i % 19 = 0) THEN 'invalid' WHEN i % 13 = 0 THEN 'skipped' WHEN unmet LIKE 'commit.%' AND i % 16 = 0 THEN 'canceled'
                WHEN unmet IS NOT NULL THEN 'failed' ELSE 'committed' END AS outcome,
           CASE WHEN i % 17 = 0 THEN 'revision.revision_id' WHEN i % 13 = 1 THEN 'acquisition.status' WHEN i % 13 <> 0 AND i % 19 = 0 THEN 'acquisition.lease_without_save' WHEN i % 13 = 0 THEN 'busy'
                WHEN unmet LIKE 'commit.%' AND i % 16 = 0 THEN 'revision.deleted' WHEN unmet IS NOT NULL THEN unmet ELSE left(sha256('p' || i), 40) END AS detail
    FROM f""")
def publication_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to publish, with one thing or another wrong, and how far each came."""
    i = F.col("event_id")
    text_of = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    sha = lambda prefix: F.sha2(text_of(prefix), 256)
    source, digest, commit = F.sha2(F.lit("source"), 256), sha("d"), F.substring(sha("k"), 1, 40)
    same = (digest.alias("digest"), commit.alias("commit"))
    evidence = lambda name: F.struct(F.lit(True).alias("passed"), text_of("e").alias("evidence_id"), F.when((i % 9 == 0) & (F.lit(name) == "render"), " ").otherwise("seen").alias("summary"), *same)
    receipt = F.struct((i % 10 != 0).alias("applied"), *same, F.upper(F.substring(sha("p"), 1, 40)).alias("persisted_commit"))
    attempts = tables.read(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 17 == 0, "not safe").otherwise(text_of("r-")).alias("revision_id"),
        F.upper(source).alias("sha256"),
        F.when(i % 13 == 0, "busy").when(i % 13 == 1, "odd").otherwise("acquired").alias("status"),
        F.struct(F.when(i % 19 == 0, "wait").otherwise("save").alias("action"), F.lit("workspace.exported").alias("reason")).alias("decision"),
        F.struct((i % 11 != 0).alias("immutable"), source.alias("sha256"), text_of("c").alias("checkout_id")).alias("source"),
        F.struct(text_of("t").alias("token"), (i % 7).alias("fence"), (i + 1000).alias("expires_at")).alias("lease"),
        F.struct(F.lit("isolated-candidate").alias("isolation"), source.alias("base_sha256"), text_of("x").alias("candidate_id"), F.lit("w").alias("workspace")).alias("candidate"),
        F.struct(F.when(i % 23 == 0, "other").otherwise(text_of("x")).alias("candidate_id"), source.alias("base_sha256"), *same, F.lit("a").alias("artifact")).alias("sealed"),
        F.struct(F.lit(True).alias("accepted"), text_of("v").alias("review_id"), source.alias("sha256"), *same, F.create_map(*(x for n in protocol.CHECKS for x in (F.lit(n), evidence(n)))).alias("checks")).alias("review"),
        F.struct((i % 8 != 0).alias("committed"), *same, receipt.alias("receipt"), F.struct(F.when(i % 16 == 0, "discard").otherwise("save").alias("action")).alias("decision"), F.lit("revision.deleted").alias("reason")).alias("result"),
    )
    return protocol.handled(attempts).select("event_id", "outcome", "detail")


def entered(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger of decisions about revisions after their events have come in as a stream, in ranges of event_id."""
    folder = tables.scratch(spark)
    for path in logged(spark, rows, "event_id"):
        live = streaming_outcome.decisions(spark.readStream.format("event_log").load(path), keys, ["ts", "event_id"])
        streaming_outcome.enter(live, keys, f"{folder}/ledger", f"{folder}/progress").awaitTermination()
    return spark.read.format("decision_ledger").load(f"{folder}/ledger")


@query(ORACLE_SQL["revision_outcome"])
def revision_outcome_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of each revision after all events have come in as a stream."""
    rows = revisions(spark, sf_dir).withColumn("day", F.col("day").cast("string"))
    return entered(spark, rows, ["user_id", "day"]).filter("kind = 'decision'").select("user_id", "day", "action", "reason")


@query(f"""
    WITH e AS (SELECT user_id, event_id % 8 AS part, ts, event_id, {KIND_SQL} AS type FROM events),
    c AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 3 AS one, min(event_id) + (max(event_id) - min(event_id)) * 2 // 3 AS two FROM e),
    p AS (SELECT k, e.* FROM e, c, (VALUES (1), (2), (3)) AS v(k) WHERE k = 3 OR event_id <= CASE k WHEN 1 THEN one ELSE two END),
    g AS (SELECT user_id, part, k, bool_or(type IN ({NEGATIVE_SQL})) AS negative, arg_min(type, (ts, event_id)) FILTER (type IN ({NEGATIVE_SQL})) AS neg,
                 bool_or(type = 'compile.succeeded') AND bool_or(type = 'render.succeeded') AND bool_or(type IN ({SUCCESS_SQL})) AS ready FROM p GROUP BY user_id, part, k),
    d AS (SELECT *, lag(ready AND NOT negative) OVER (PARTITION BY user_id, part ORDER BY k) AS saved FROM g)
    SELECT user_id, part, neg AS reason FROM d WHERE saved AND negative""")
def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that a commit of events had saved and a later one discarded: each has to be taken back."""
    rows = revisions(spark, sf_dir).withColumn("part", F.col("event_id") % 8)
    return entered(spark, rows, ["user_id", "part"]).filter("kind = 'retraction'").select("user_id", "part", "reason")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('view', 'click') AND event_id > 300 GROUP BY event_type""")
def event_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's events that meet conditions which are settled where its files are read."""
    *_, path = logged(spark, tables.read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    rows = spark.read.format("event_log").option("where", event_log.where(("event_type", "in", ["view", "click"]), ("event_id", ">", 300))).load(path)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Frames a second at which the laws are evaluated.
RATES = (24.0, 30.0, 60.0)
CURVED = {"crt-glitch", "fight-zine", "impact", "media-montage", "neon-heart-pop", "rapid-photo", "turbulent-emulsion"}


#: What owners give the laws, from events, in SQL that both engines read.
GIVEN = {
    "entrance": "20 + event_id % 30", "cut_frames": "10 + event_id % 20", "scale_from": "1 + event_id % 4 * 0.1", "scale_to": "1 + event_id % 3 * 0.05", "sources": "1 + event_id % 5", "strobe_ms": "50 + event_id % 200",
    "letters": "3 + event_id % 8", "letter_index": "event_id % 7", "appear_frame": "event_id % 30", "disappear_frame": "event_id % 30 + event_id % 17", "text": "event_type || ' of user ' || user_id || ', ' || props",
}


def given(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.expr(x).cast(ARGUMENTS[n][0]) for n, x in GIVEN.items()})


#: The same as columns of a query.
GIVEN_SQL = ", ".join(f"{x} AS {n}" if n == "text" else f"({x})::DOUBLE AS {n}" for n, x in GIVEN.items())


def law_query(name: str) -> None:
    """All laws of a family at the frames of events, one column for each channel."""
    channels = {f"{kind.split('.', 1)[1]}.{c}".replace("-", "_").replace("/", "_").replace(".", "__"): t for kind, f in laws.family(name).items() for c, t in f().items()}
    text_like = {k for k, t in channels.items() if k.endswith(("__shadow", "__phase", "__fit", "__filters", "__operations", "__text", "__color"))}
    # Curves are solved to about 1e-5.
    scale = 1e4 if name in CURVED else 1e6

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rate = F.element_at(F.array(*map(F.lit, RATES)), (F.col("event_id") % len(RATES) + 1).cast("int"))
        rows = given(events(spark, sf_dir)).select("event_id", "frame", rate.alias("fps"), (60.0 + F.col("event_id") % 5 * 60).alias("duration"), *GIVEN)
        return rows.select("event_id", *((t.col if k in text_like else F.floor(t.col * scale + 0.5) / scale).alias(k) for k, t in channels.items()))

    f.__name__ = f"laws_{name.replace('-', '_')}"
    known = all(t.sql is not None for t in channels.values())
    outs = ", ".join(f"{t.sql} AS {k}" if k in text_like else f"floor({t.sql} * {scale!r}::DOUBLE + 0.5) / {scale!r}::DOUBLE AS {k}" for k, t in channels.items()) if known else ""
    rates = ", ".join(f"{r!r}::DOUBLE" for r in RATES)
    query(f"SELECT event_id, {outs} FROM (SELECT event_id, frame, [{rates}][event_id % {len(RATES)} + 1] AS fps, (60.0 + event_id % 5 * 60)::DOUBLE AS duration, {GIVEN_SQL} FROM {FRAMES})" if known else None)(f)


@query(f"""
    WITH t(recipe, mode, rate, first) AS (VALUES {", ".join(f"('{k}', '{m}', {float(r)!r}::DOUBLE, {f})" for k, (m, r, f) in panels.TYPING.items())}),
    e AS (SELECT event_id, frame, 24 + event_id % 3 * 6 AS fps, length({GIVEN['text']}) AS n, (list_sort([{", ".join(f"'{k}'" for k in panels.TYPING)}]) || ['no-such-recipe'])[event_id % {len(panels.TYPING) + 1} + 1] AS recipe FROM {FRAMES})
    SELECT event_id, recipe, CASE mode
             WHEN 'whole' THEN least(n, floor(n * greatest(0, least(1, (frame - first) / greatest(1, floor(fps * rate + 0.5))))))
             WHEN 'second' THEN least(n, floor(greatest(0, frame - first) / fps * rate)) WHEN 'frame' THEN least(n, floor(greatest(0, frame - first) * rate)) END::INT AS visible,
           mode IS NULL AS unknown
    FROM e LEFT JOIN t USING (recipe)""")
def typing_by_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters shown by a recipe that each row names, and the rows whose recipe there isn't."""
    names = [*sorted(panels.TYPING), "no-such-recipe"]
    rows = given(events(spark, sf_dir)).select("event_id", "frame", (24 + F.col("event_id") % 3 * 6).cast("double").alias("fps"), F.length("text").alias("n"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("recipe"))
    known, unknown = panels.with_typing(rows, panels.typing_recipes(spark))
    shown = known.select("event_id", "recipe", panels.typed_by(F.col("typing"), F.col("frame"), F.col("fps"), F.col("n")).alias("visible"), F.lit(False).alias("unknown"))
    return shown.unionByName(unknown.select("event_id", "recipe", F.lit(None).cast("int").alias("visible"), F.lit(True).alias("unknown")))


BREAKPOINTS = {
    "inputs": "[{i} % 7 + 0.0, {i} % 7 + 5.5, {i} % 7 + 9 - {i} % 11, 30.0, 30.5 + {i} % 13]", "outputs": "[{i} % 3 * 10.0, 50.0, 50.0, {i} % 19 - 9.0, 100.0]",
    "left": "['extend', 'clamp', 'wrap', 'identity', 'none'][{i} % 5 + 1]", "right": "['clamp', 'wrap', 'identity', 'extend'][{i} % 4 + 1]",
}


@query(f"""
    WITH v AS (SELECT event_id, value / 5 - 4 AS x, {BREAKPOINTS['inputs'].format(i='event_id')}::DOUBLE[] AS ins, {BREAKPOINTS['outputs'].format(i='event_id')}::DOUBLE[] AS outs,
                      {BREAKPOINTS['left'].format(i='event_id')} AS lo, {BREAKPOINTS['right'].format(i='event_id')} AS hi FROM events),
    r AS (SELECT *, ins[1] < ins[2] AND ins[2] < ins[3] AND ins[3] < ins[4] AND ins[4] < ins[5] AS rising FROM v),
    k AS (SELECT *, CASE WHEN x <= ins[2] THEN 1 WHEN x <= ins[3] THEN 2 WHEN x <= ins[4] THEN 3 ELSE 4 END AS k FROM r),
    s AS (SELECT event_id, x, rising, lo, ins[k] AS a, ins[k + 1] AS b, outs[k] AS p, outs[k + 1] AS q, CASE WHEN x < ins[k] THEN lo WHEN x > ins[k + 1] THEN hi END AS mode FROM k)
    SELECT event_id, CASE WHEN NOT rising THEN 'increasing' WHEN lo = 'none' THEN 'edge' END AS problem,
           round(CASE WHEN NOT rising OR lo = 'none' THEN NULL WHEN mode = 'identity' THEN x WHEN p = q THEN p
                      ELSE p + (q - p) * (CASE mode WHEN 'clamp' THEN least(greatest(x, a), b) WHEN 'wrap' THEN (((x - a) % (b - a)) + (b - a)) % (b - a) + a ELSE x END - a) / (b - a) END, 6) + 0.0 AS y FROM s""")
def interpolate_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolation by breakpoints and edge modes that each row brings along, and which rule those break."""
    i = F.col("event_id")
    ins = F.array(*((x).cast("double") for x in (i % 7, i % 7 + 5.5, i % 7 + 9 - i % 11, F.lit(30.0), 30.5 + i % 13)))
    outs = F.array(*((x).cast("double") for x in (i % 3 * 10, F.lit(50.0), F.lit(50.0), i % 19 - 9, F.lit(100.0))))
    mode = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    left, right = mode(("extend", "clamp", "wrap", "identity", "none")), mode(("clamp", "wrap", "identity", "extend"))
    rows = tables.read(spark, sf_dir, "events").select("event_id", (F.col("value") / 5 - 4).alias("x"), ins.alias("ins"), outs.alias("outs"), left.alias("lo"), right.alias("hi"))
    own = [F.col(c) for c in ("ins", "outs", "lo", "hi")]
    return rows.select("event_id", tl.ladder_problem(*own).alias("problem"), r6(tl.interpolate_by(F.col("x"), *own)).alias("y"))


for _family in sorted({k.split(".")[0] for k in laws.LAWS}):
    law_query(_family)


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 5 AS grow, l_partkey * 0.5::DOUBLE AS o FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 'grow' AS field FROM l WHERE grow < 0
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'order' FROM l WHERE o <> floor(o)""")
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = tables.read(spark, sf_dir, "lineitem").select(*key, (F.col("l_quantity") - 5).alias("grow"), F.col("l_discount").alias("shrink"), (F.col("l_partkey") * 0.5).alias("order"))
    return schema.violations(rows, "layout_item", key)


@query("""
    SELECT event_id, nullif(concat_ws(' ', CASE WHEN event_id % 5 <> 0 THEN 'translate3d(' || event_id % 5 || 'px, 0px, 0)' END, CASE WHEN user_id % 7 <> 3 THEN 'rotate(' || (user_id % 7 - 3) || 'deg)' END,
                      CASE WHEN event_id % 2 = 1 THEN 'scale(1, 2)' END, CASE WHEN event_id % 3 = 0 THEN 'translateX(-50%)' END), '') AS transform FROM events""")
def style_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda x: x.cast("double")
    dim = "struct<num: double, txt: string>"
    null = lambda kind: F.lit(None).cast(kind)
    shift = F.struct(F.lit("translate-x").alias("kind"), null(dim).alias("x"), null(dim).alias("y"), F.struct(null("double").alias("num"), F.lit("-50%").alias("txt")).alias("value"), *(null("double").alias(c) for c in ("dx", "dy", "dz", "degrees")))
    pose = F.struct(
        number(F.col("event_id") % 5).alias("x"), F.lit(0.0).alias("y"), number(F.col("user_id") % 7 - 3).alias("rotate"), F.lit(0.0).alias("skew_x"), F.lit(1.0).alias("scale_x"), number(1 + F.col("event_id") % 2).alias("scale_y"),
        F.when(F.col("event_id") % 3 == 0, F.array(shift)).otherwise(F.slice(F.array(shift), 1, 0)).alias("operations"),
    )
    return tables.read(spark, sf_dir, "events").select("event_id", style.transform(pose).alias("transform"))


def catalogue_sql() -> str:
    """The catalogue's file as rows of SQL: id, type, style, import and use_when."""
    rows = []
    for line in catalog.lines("catalogue.txt"):
        name, kind, use = (x.strip() for x in line.split("|"))
        type_, style, _ = name.split(".", 2)
        quoted = ", ".join("'" + u.replace("'", "''") + "'" for u in use.split("; "))
        rows.append(f"({len(rows)}, '{name}', '{type_}', '{style}', '{type_}s/{style}/{kind}', [{quoted}])")
    return f"(VALUES {', '.join(rows)}) AS c(place, id, type, style, import, use_when)"


#: What events ask the catalogue for: its entry number event_id is asked for in part or whole, or by a purpose that it hasn't.
ASKED_SQL = f"""
    SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN c.style END AS style, CASE WHEN e.event_id % 3 = 0 THEN c.type END AS type,
           CASE WHEN e.event_id % 5 = 0 THEN 'nothing of the kind' WHEN e.event_id % 4 > 0 THEN c.use_when[1] END AS purpose
    FROM events e JOIN {catalogue_sql()} ON c.place = e.event_id % {len(catalog.lines("catalogue.txt"))}"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i = catalog.entries(spark), F.col("event_id")
    own = tables.read(spark, sf_dir, "events").select("event_id").join(F.broadcast(rows), F.col("place") == i % len(catalog.lines("catalogue.txt")))
    purpose = F.when(i % 5 == 0, "nothing of the kind").when(i % 4 > 0, F.get("use_when", F.lit(0)))
    return own.select("event_id", F.when(i % 2 == 0, F.col("style")).alias("style"), F.when(i % 3 == 0, F.col("type")).alias("type"), purpose.alias("purpose"))


@query(f"""
    WITH a AS ({ASKED_SQL})
    SELECT a.event_id, c.id, c.import FROM a JOIN {catalogue_sql()}
      ON (a.style IS NULL OR a.style = c.style) AND (a.type IS NULL OR a.type = c.type) AND (a.purpose IS NULL OR list_contains(c.use_when, a.purpose))
    WHERE a.style IS NOT NULL OR a.purpose IS NOT NULL""")
def catalogue_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the catalogue for each of many requests by style, type and purpose."""
    questions = asked(spark, sf_dir).filter("style IS NOT NULL OR purpose IS NOT NULL")
    return catalog.answers(catalog.entries(spark), questions).select("event_id", "id", "import")


_laws = sorted({k.partition("/")[0] for k in laws.LAWS})


@query(f"""
    WITH l(place, id) AS (VALUES {", ".join(f"({i}, 'behaviour.{k}')" for i, k in enumerate(_laws))})
    SELECT id, count(e.event_id) AS events, max(e.event_id) AS latest FROM l LEFT JOIN events e ON l.place = e.event_id % {len(_laws) + 3} GROUP BY id""")
def law_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events name each of the library's laws, those that none names included."""
    known = catalog.find(catalog.of_laws(spark), type="behaviour").select("id")
    names = F.get(F.array(*(F.lit(f"behaviour.{k}") for k in _laws)), (F.col("event_id") % (len(_laws) + 3)).cast("int"))
    named = tables.read(spark, sf_dir, "events").groupBy(names.alias("id")).agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("latest"))
    return known.join(named, "id", "left").select("id", F.coalesce("events", F.lit(0)).alias("events"), "latest")


@query(f"""
    WITH a AS ({ASKED_SQL}), u AS (SELECT style, type, count(*) AS n FROM {catalogue_sql()} GROUP BY ALL)
    SELECT u.style, u.type, u.n::BIGINT AS n, count(a.event_id) AS asked FROM u LEFT JOIN a ON a.style = u.style AND a.type = u.type GROUP BY ALL""")
def catalogue_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by style and type, and how many requests name both."""
    own = catalog.entries(spark).groupBy("style", "type").agg(F.count(F.lit(1)).alias("n"))
    wanted = asked(spark, sf_dir).groupBy("style", "type").agg(F.count(F.lit(1)).alias("asked"))
    return own.join(wanted, ["style", "type"], "left").select("style", "type", "n", F.coalesce("asked", F.lit(0)).alias("asked"))


@query(f"""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'unit.none.such' ELSE c.id END AS kind FROM events JOIN {catalogue_sql()} ON c.place = event_id * 7 % {len(catalog.lines("catalogue.txt"))})
    SELECT e.event_id, e.kind, c.style FROM e LEFT JOIN {catalogue_sql()} ON c.id = e.kind""")
def catalogue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that events name, resolved against the kinds that the library has: a null style where there is none."""
    rows, n = catalog.entries(spark), len(catalog.lines("catalogue.txt"))
    named = tables.read(spark, sf_dir, "events").select("event_id").join(F.broadcast(rows.select("place", "id")), F.col("place") == F.col("event_id") * 7 % n)
    named = named.select("event_id", F.when(F.col("event_id") % 9 == 0, "unit.none.such").otherwise(F.col("id")).alias("kind"))
    kinds = catalog.kinds(spark).select("kind", F.split("kind", r"\.")[1].alias("style"))
    return named.join(F.broadcast(kinds), "kind", "left").select("event_id", "kind", "style")


@query(f"""
    WITH f AS (SELECT DISTINCT floor(frame)::BIGINT AS frame FROM {FRAMES}),
    p AS (SELECT frame, least(1.0, greatest(0.0, (frame - 5) / 12.0::DOUBLE)) AS x FROM f)
    SELECT frame, 4::BIGINT AS nodes, round(1 - (1 - x) * (1 - x) * (1 - x), 6) + 0.0 AS draw_end FROM p""")
def scene_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline's scene at the frames of events: how many nodes are there, and how far its rule is drawn."""
    nodes, attached = builders.build(spark, "signalHeadlineBand", text="A HEADLINE")
    scene = projection.evaluate(nodes, attached, 0, 120)
    frames = events(spark, sf_dir).select(F.floor("frame").alias("frame")).distinct()
    drawn = F.get_json_object("scene", "$.children[1].draw_end").cast("double")
    return frames.join(scene, "frame").select("frame", F.regexp_count("scene", F.lit('"kind"')).cast("long").alias("nodes"), r6(drawn).alias("draw_end"))


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE * 10 AS w, (l_partkey % 500 + 1)::DOUBLE AS h FROM lineitem),
    s AS (SELECT *, greatest(1080 / w, 1920 / h) AS scale, ((l_partkey % 360) - 90) * (pi() / 180) AS turn FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, round(scale, 6) + 0.0 AS scale, round(w * scale, 6) + 0.0 AS width, round(540 + cos(turn) * 100, 6) + 0.0 AS x, round(540 + sin(turn) * 100, 6) + 0.0 AS y FROM s""")
def cover_and_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    fit = geometry.cover_fit(F.col("l_quantity").cast("double") * 10, (F.col("l_partkey") % 500 + 1).cast("double"), 1080, 1920)
    at = geometry.polar((F.col("l_partkey") % 360).cast("double"), 100, 540)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r6(fit["scale"]).alias("scale"), r6(fit["width"]).alias("width"), r6(at["x"]).alias("x"), r6(at["y"]).alias("y"))


@query("""
    WITH e AS (SELECT event_id, event_id % 2 = 0 AS flex, ['start', 'center', 'end'][event_id % 3 + 1] AS a, event_id % 5 AS gap FROM events)
    SELECT event_id, 'align-items: ' || CASE WHEN flex AND a <> 'center' THEN 'flex-' || a ELSE a END || '; column-gap: ' || gap || 'px; display: ' || CASE WHEN flex THEN 'flex; flex-direction: row; flex-wrap: wrap; justify-content: flex-start'
             ELSE 'grid; grid-template-columns: 1fr ' || gap || 'px; justify-content: start' END || '; padding-left: 10%; row-gap: 4px' AS sheet FROM e""")
def style_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    number = lambda x: F.struct(x.cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    null = F.lit(None).cast("struct<num: double, txt: string>")
    track = lambda kind, value, share_of: F.struct(F.lit(kind).alias("kind"), value.alias("value"), share_of.alias("share"), *(F.lit(None).cast("string").alias(c) for c in ("size", "min", "max")))
    columns = F.array(track("fraction", null, F.lit(1.0)), track("fixed", number(i % 5), F.lit(None).cast("double")))
    box = F.struct(
        F.when(i % 2 == 0, "flex").otherwise("grid").alias("mode"), F.lit("row").alias("direction"), F.lit("wrap").alias("wrap"), F.element_at(F.array(*map(F.lit, ("start", "center", "end"))), (i % 3 + 1).cast("int")).alias("align"),
        F.lit(None).cast("string").alias("justify"), columns.alias("columns"), F.slice(columns, 1, 0).alias("rows"),
        F.struct(null.alias("top"), null.alias("right"), null.alias("bottom"), F.struct(F.lit(None).cast("double").alias("num"), F.lit("10%").alias("txt")).alias("left")).alias("padding"),
        F.struct(number(F.lit(4)).alias("row"), number(i % 5).alias("column")).alias("gap"),
    )
    return tables.read(spark, sf_dir, "events").select("event_id", sheet.sheet_text(sheet.layout(box)).alias("sheet"))


def _passed(start: float, length: float) -> str:
    return f"least(1.0, greatest(0.0, (frame - {start}) / {length}))"


def _out3(x: str) -> str:
    return f"(1 - power(1 - {x}, 3))"


def _back(x: str, s: float) -> str:
    return f"(1 + {s + 1} * power({x} - 1, 3) + {s} * power({x} - 1, 2))"


def _smooth(x: str) -> str:
    return f"({x} * {x} * (3 - 2 * {x}))"


_fall, _deal, _boot = _back(_passed(0, 15), 1.35), f"(floor({_back(_passed(0, 16), 1.75)} * 12 + 0.5) / 12)", f"(floor({_back(_passed(0, 18), 1.72)} * 16 + 0.5) / 16)"
_recoil, _enter, _exit = _back(_passed(0, 20), 2.2), _out3(_passed(0, 9)), _smooth(_passed(14, 8))
_rune, _beat, _settle = f"(floor({_passed(2, 18)} * 10) / 10)", "(frame % 22.3)", _back(_passed(0, 14), 1.45)
#: Laws whose SQL is written out by hand, apart from the terms that the laws are made of.
BY_HAND = {
    "archival-dossier.casefile-shutter-fall": {
        "opacity": f"least({_passed(0, 2)}, 1 - {_passed(22, 8)})", "rotate": f"-1.8 + 2.15 * {_fall}", "scale_y": f"0.76 + 0.24 * {_fall}", "y": f"(-1260 + 1260 * {_fall}) + 1180 * {_passed(22, 8)}",
        "blur": f"greatest(0, (16 + -16 * {_fall}) + 8 * {_passed(22, 8)})",
    },
    "archival-dossier.pinned-evidence-drop": {
        "rotate": f"CASE WHEN frame < 10 THEN -8.5 + 10.9 * {_smooth(_passed(0, 10))} WHEN frame < 16 THEN 2.4 - 3.3 * {_smooth(_passed(10, 6))} ELSE -0.9 + 0.65 * {_smooth(_passed(16, 8))} END",
        "y": f"(-310 + 310 * {_smooth(_passed(0, 10))})", "brightness": f"1.18 - 0.22 * {_smooth(_passed(0, 10))}", "opacity": _passed(0, 3),
    },
    "signal-editorial.impact-settle": {"rotate": f"(-5.5 + 5.5 * {_recoil})", "skew_x": f"(-8 + 8 * {_out3(_passed(0, 14))})", "y": f"(92 + -92 * {_recoil})", "contrast": f"1.35 - 0.35 * {_recoil}", "blur": f"(14 + -14 * {_out3(_passed(0, 14))})"},
    "signal-editorial.razor-cut-sweep": {"x": f"-1320 + 2560 * {_exit} + 1320 * {_enter}", "blur": f"(24 + -24 * {_enter}) + 10 * {_exit}", "opacity": f"least({_passed(0, 2)}, 1 - {_passed(19, 3)})", "rotate": f"-11 + 5 * {_enter}"},
    "retro-ritual.ritual-card-deal": {
        "x": f"floor((520 + -520 * {_deal}) + 0.5)", "scale_x": f"floor((0.62 + 0.38 * {_deal}) * 16 + 0.5) / 16", "rotate": f"floor((-9 + 9 * {_deal}) * 2 + 0.5) / 2", "brightness": "CASE WHEN frame % 4 = 0 AND frame < 16 THEN 1.45 ELSE 1 END",
        "opacity": "CASE WHEN frame < 2 THEN 0 ELSE 1 END",
    },
    "retro-ritual.rune-trace": {"draw_end": _rune, "opacity": "CASE WHEN frame < 2 THEN 0 WHEN frame % 4 = 0 THEN 0.72 ELSE 1 END", "stroke_width": "CASE WHEN frame % 4 = 0 THEN 8 ELSE 6 END", "scale_x": f"CASE WHEN {_rune} < 0.5 THEN 0.96 ELSE 1 END"},
    "micro-flash.pulse/6": {"opacity": f"CASE WHEN {_passed(0, 6)} <= 0.3 THEN {_passed(0, 6)} / 0.3 ELSE (1 - {_passed(0, 6)}) / 0.7 END"},
    "photo-glitch.rgb-beat-glitch": {"strength": f"CASE WHEN {_beat} < 4 THEN 5 * (1 - {_beat} / 4) ELSE 0 END", "x": f"CASE WHEN {_beat} < 4 THEN sin(frame * 7.3) * 5 * (1 - {_beat} / 4) * 0.8 ELSE 0 END"},
    "photo-glitch.triptych-exit": {
        "opacity": "1 - power(least(1, greatest(0, (frame - (duration - floor(fps * 0.4 + 0.5))) / floor(fps * 0.4 + 0.5))), 3)", "present": "CASE WHEN frame < duration THEN 1 ELSE 0 END",
    },
    "tape-warble.vhs-tracking-error": {"warp": "least(1, frame / (duration * 0.2))", "roll_y": "1920 * (1 - (frame / duration * 2) % 1)"},
    "fight-zine.row-stagger": {"x": f"(-120 + 120 * {_settle})", "rotate": f"(-2.8 + 2.8 * {_settle})", "brightness": f"1.18 - 0.18 * {_settle}", "opacity": _passed(0, 4)},
    "chalkboard.stroke-draw": {
        "draw_end": _out3(_passed(0, 36)), "content_opacity": _out3(_passed(14, 22)), "eraser_opacity": f"0.48 * {_out3(_passed(52, 12))} * (1 - {_passed(65, 7)})",
        "stroke_width": "7 + 1.6 * (2 * (sin(frame * 78.233 + 12.9898) * 43758.5453 - floor(sin(frame * 78.233 + 12.9898) * 43758.5453)) - 1)",
    },
    "blue-terminal.panel-boot": {
        "y": f"floor((86 + -86 * {_boot}) + 0.5)", "scale_y": f"0.56 + 0.44 * {_boot}", "brightness": f"1.32 - 0.32 * {_out3(_passed(0, 12))} + CASE WHEN frame < 12 AND floor(frame) % 4 = 0 THEN 0.42 ELSE 0 END", "contrast": f"1.34 - 0.22 * {_out3(_passed(0, 12))}",
    },
    "retro-ritual.bone-idle-hop": {
        "add_y": "floor(greatest(0, sin((floor(frame / 2) % 12) / 12 * pi())) * -12 + 0.5)", "add_rotate": "floor(sin((floor(frame / 2) % 12) / 12 * pi() * 2) * 1.5 + 0.5)",
        "times_scale_x": "CASE WHEN floor(frame / 2) % 12 = 0 THEN 1.025 ELSE 1 END", "times_scale_y": "CASE WHEN floor(frame / 2) % 12 = 0 THEN 0.975 ELSE 1 END",
    },
    "conn-check-88bf76acecbb.marker": {"opacity": "least(1, frame / 8)", "scale": "1 - 0.28 * power(1 - least(1, frame / 18), 3)", "y": "40 * power(1 - least(1, frame / 18), 3)"},
    "signal-editorial.ink-rule-strike": {"draw_end": "1 - power(1 - least(1, greatest(0, (frame - 5) / 12)), 3)"},
    "archival-dossier.scene-reveal": {
        "opacity": "least(1, greatest(0, (frame - 13) / 7)) ** 2 * (3 - 2 * least(1, greatest(0, (frame - 13) / 7)))", "y": "18 * (1 - least(1, greatest(0, (frame - 13) / 7)) ** 2 * (3 - 2 * least(1, greatest(0, (frame - 13) / 7))))",
    },
    "media-montage.cut-flash-envelope": {"opacity": "0.35 * (1 - least(1, frame / 3))"},
    "neon-heart-pop.five-hit-title-slam": {"present": "CASE WHEN frame >= floor(0.75 * fps + 0.5) THEN 1 ELSE 0 END"},
    "photo-glitch.beat-vignette-flicker": {"opacity": "0.6 + sin(frame * 0.9) * 0.04", "beat": "floor(frame / 22.3)", "in_beat": "frame - floor(frame / 22.3) * 22.3"},
    "sculptural-3d.ink-tendril-reveal": {"progress": "(1 - cos(least(1, frame / (duration - 1)) * pi())) / 2", "time": "frame / 10"},
    "flash-photo.shutter-flash-reframe/long-push-0": {"opacity": "least(1, frame / greatest(1, floor(0.08 * fps + 0.5)))", "scale": "1 + 0.06 * least(1, frame / 158)"},
    "flash-photo.shutter-flash-reframe/cover-triptych-1": {
        "opacity": "CASE WHEN frame / fps * 1000 >= 743 AND frame / fps * 1000 < 1486 THEN 1 ELSE 0 END", "frame_x": "-180 + (-60 + 120 * least(1, greatest(0, (frame / fps * 1000 - 743) / 743)))", "contrast": "1.2", "saturate": "1.3",
    },
}
_half, _fade = "floor(fps * 0.5 + 0.5)", "least(1.0, greatest(0.0, (frame - (duration - floor(fps * 0.5 + 0.5))) / floor(fps * 0.5 + 0.5)))"
_open = "(1 - power(1 - least(1.0, greatest(0.0, frame / entrance)), 2))"
_ms = lambda x: f"floor({x} / 1000.0 * fps + 0.5)"
_hits = [f"(frame - {_ms(h)})" for h in (0, 150, 300, 450, 600)]
_shake = lambda f, turn, far, step: " + ".join(f"CASE WHEN {e} >= 0 AND {e} < {_ms(100)} THEN {f}(({e} + {k * step}) * {turn}) * {far} * (1 - {e} / {_ms(100)}) ELSE 0 END" for k, e in enumerate(_hits))
_pop = "floor(fps * 0.3 + 0.5)"
BY_HAND |= {
    "archival-dossier.carbon-copy-cadence": {"opacity": _passed(0, 2), "letter_spacing": f"2.8 - 2.1 * {_passed(0, 8)}", "blur": f"1.6 - 1.6 * {_passed(0, 8)}"},
    "signal-editorial.scene-reveal": {"opacity": _out3(_passed(8, 6)), "scale_x": f"1.04 - 0.04 * {_out3(_passed(8, 6))}", "x": f"34 - 34 * {_out3(_passed(8, 6))}", "brightness": f"1.85 - 0.85 * {_out3(_passed(8, 6))}"},
    "blue-terminal.scanline-cadence/pixel-crt": {"opacity": "0.04 + sin(frame * 0.2) * 0.01"},
    "blue-terminal.text-cadence/soft-speaker": {"visible": "least(length(text), floor(greatest(0, frame - 4) / fps * 22))"},
    "blue-terminal.text-cadence/pixel-crt": {"visible": "floor(length(text) * least(1.0, greatest(0.0, frame / floor(fps * 1.8 + 0.5))))"},
    "blue-terminal.cursor-cadence/bevel-status": {"present": "CASE WHEN floor(greatest(0, frame) / fps * 28) < length(text) THEN 1 ELSE 0 END", "opacity": "0"},
    "blue-terminal.indicator-cadence/tagged-status": {"present": "CASE WHEN floor(greatest(0, frame) * 1.7) >= length(text) THEN 1 ELSE 0 END"},
    "blue-terminal.message-cadence": {"opacity": _passed(8, 3), "letter_spacing": f"1.6 - 1.6 * {_out3(_passed(10, 14))}"},
    "turbulent-emulsion.flicker/soft-grain": {"opacity": "0.0325 + sin(frame * 0.2) * 0.0075"},
    "turbulent-emulsion.flicker/cue-2": {"present": "CASE WHEN frame >= 34 THEN 1 ELSE 0 END"},
    "turbulent-emulsion.drift/film-grain": {"fine_seed": "(frame * 7 + 3) % 9973", "dust_seed": "(((frame * 7 + 3) % 9973) * 3 + 17) % 9973"},
    "turbulent-emulsion.drift/soft-grain": {"seed": "frame % 991 + 1"},
    "outlined-word-card.word-cue-state": {"present": "CASE WHEN frame >= appear_frame AND frame < disappear_frame THEN 1 ELSE 0 END"},
    "media-montage.image-strobe-cuts": {"index": f"floor(frame / greatest(1, {_ms('strobe_ms')})) % sources"},
    "media-montage.flash-cut-motion/hard": {"scale": "CASE WHEN frame = 0 THEN scale_from ELSE scale_to END"},
    "media-montage.vignette-release": {"inner": f"0.06 + 0.56 * {_open}", "edge_opacity": f"0.92 - 0.92 * {_open}", "opacity": f"CASE WHEN 0.92 - 0.92 * {_open} > 0.001 THEN 1 ELSE 0 END"},
    "media-montage.first-clip-grade-reveal": {"saturate": f"0.35 + 0.65 * {_open}", "contrast": f"1.55 - 0.55 * {_open}"},
    "photo-glitch.panel-ken-burns/0": {"scale": "1 + 0.18 * least(1.0, frame / duration)", "x": "-12 * least(1.0, frame / duration)", "y": "-18 * least(1.0, frame / duration)"},
    "photo-glitch.beat-photo-cadence": {"beat": "floor(frame / 22.3)", "variant": "floor(frame / 22.3) % 4", "source": "floor(frame / 22.3) % sources", "opacity": "1"},
    "photo-glitch.masked-panel-reveal/1": {"opacity": _passed(10, 4)},
    "photo-glitch.perspective-card-drop/2": {"opacity": _passed(30, 6)},
    "kinetic-intertitles.impact-letter-cadence/scanline-row": {"opacity": f"1 - {_fade}", "brightness": "1 + 0.05 * sin(frame * pi() * 16 / fps)"},
    "kinetic-intertitles.impact-scanline-sweep": {"y": f"-12 + 120 * {_passed('(letters * 5 + 12)', 22)}", "present": "CASE WHEN frame > letters * 5 + 12 THEN 1 ELSE 0 END"},
    "kinetic-intertitles.progress-trace": {"y": "64 + 80 * least(1.0, greatest(0.0, (frame - (floor(fps * 0.6 + 0.5) + floor(fps * 0.06 + 0.5) + floor(fps * 0.38 + 0.5))) / floor(fps * 0.65 + 0.5)))"},
    "kinetic-intertitles.shimmer-sweep": {"x": "-280 + 560 * least(1.0, greatest(0.0, (frame - (floor(fps * 0.6 + 0.5) + floor(fps * 0.08 + 0.5))) / floor(fps * 1.05 + 0.5)))"},
    "kinetic-intertitles.split-word-cadence/shimmer": {"opacity": f"{_out3('least(1.0, frame / floor(fps * 0.6 + 0.5))')} * (1 - power({_fade}, 3))"},
    "neon-heart-pop.orbit-heart-burst": {"rotate_y": "frame / fps * 360"},
    "neon-heart-pop.spinning-heart-burst": {"rotate_y": "frame / fps * 360"},
    "neon-heart-pop.orbit-particle-cadence": {"x": "cos(frame / fps * 4 * pi() + pi() / 2) * 140", "y": "sin(frame / fps * 4 * pi() + pi() / 2) * 140"},
    "neon-heart-pop.heart-constellation-twinkle": {"opacity": "0.2 + 0.8 * (sin((frame + 7) / fps * pi() * 2) + 1) / 2"},
    "neon-heart-pop.orbit-caption-reveal": {"opacity": f"CASE WHEN frame / fps * 1000 >= 350 THEN least(1.0, greatest(0.0, (frame - {_ms(350)}) / ({_ms(550)} - {_ms(350)}))) ELSE 0 END"},
    "neon-heart-pop.five-hit-camera-shake": {"x": _shake("sin", 5.7, 34, 13), "y": _shake("cos", 6.3, 34, 7), "rotate": _shake("sin", 7.1, 1.4, 5)},
    "neon-heart-pop.five-hit-exposure-burst": {"opacity": "greatest(0, " + ", ".join(f"CASE WHEN {e} < 0 THEN 0 WHEN {e} <= 1 THEN 0.85 + 0.05 * {e} WHEN {e} <= 5 THEN 0.9 * (1 - ({e} - 1) / 4) ELSE 0 END" for e in _hits) + ")"},
    "neon-heart-pop.five-hit-photo-slam/2": {"present": f"CASE WHEN frame >= {_ms(300)} THEN 1 ELSE 0 END"},
    "neon-heart-pop.dual-line-glitch-cadence/rule": {"opacity": f"least(1.0, greatest(0.0, (frame - {_ms(250)}) / {_ms(150)}))"},
    "neon-heart-pop.split-nameplate-cadence/label-stage": {"opacity": f"0.7 * least(1.0, greatest(0.0, (frame - {_ms(400)}) / ({_ms(500)} - {_ms(400)})))"},
    "neon-heart-pop.chroma-stack-pop": {"scale": f"CASE WHEN frame <= {_pop} * 0.6 THEN 1.08 * {_out3(f'(frame / ({_pop} * 0.6))')} ELSE 1.08 - 0.08 * {_out3(f'((least(frame, {_pop}) - {_pop} * 0.6) / ({_pop} * 0.4))')} END"},
    "neon-heart-pop.chroma-pop-settle": {"opacity": _passed(0, 3), "blur": f"3 - 3 * {_passed(0, 8)}", "x": "CASE WHEN frame > 18 THEN sin(floor((frame - 18) / 2) * 1.7) * 1.5 ELSE 0 END"},
    "fight-zine.title-cadence/grid": {"opacity": f"0.05 * {_passed(0, 8)}"},
    "fight-zine.chart-cadence/plot": {"opacity": _passed(0, 10), "x": "sin(frame * 0.5) * 1.2", "y": "cos(frame * 0.43) * 1.2"},
    "fight-zine.ranking-table-cadence/score-1": {"score": f"floor(101 + 5 * {_out3(_passed(26, 10))} + 0.5)"},
    "fight-zine.marker-scrawl-trace/title-border": {"trace": _passed(2, 26), "bucket": "floor(frame / 2)"},
    "sculptural-3d.heart-pulse-orbit/slow-pulse": {"y": "sin(frame * 0.034) * 15", "turn": "frame * 0.0065", "orbit_frame": "frame"},
}
_hand = {f"{law}.{channel}".replace("-", "_").replace("/", "_").replace(".", "__"): (law, channel, sql) for law, channels in BY_HAND.items() for channel, sql in channels.items()}


@query(f"""
    SELECT event_id, {", ".join(f"floor(({sql}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS {name}" for name, (_, _, sql) in _hand.items())}
    FROM (SELECT event_id, frame, [{", ".join(f"{r!r}::DOUBLE" for r in RATES)}][event_id % {len(RATES)} + 1] AS fps, (60.0 + event_id % 5 * 60)::DOUBLE AS duration, {GIVEN_SQL} FROM {FRAMES})""")
def laws_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*map(F.lit, RATES)), (F.col("event_id") % len(RATES) + 1).cast("int"))
    rows = given(events(spark, sf_dir)).select("event_id", "frame", rate.alias("fps"), (60.0 + F.col("event_id") % 5 * 60).alias("duration"), *GIVEN)
    return rows.select("event_id", *((F.floor(laws.LAWS[law]()[channel].col * 1e6 + 0.5) / 1e6).alias(name) for name, (law, channel, _) in _hand.items()))

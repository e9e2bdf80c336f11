from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orrery.laws import catalogue as laws
from orrery.operators import catalog, determinism, intervals, outcome, tree
from orrery.sources import tables
from orrery.streaming import lease

READY = ["compile.succeeded", "render.succeeded"]


@pytest.mark.parametrize(
    ("events", "want"),
    [
        (["neutral"], ("wait", "no-success-signal")),
        ([None], ("wait", "no-success-signal")),
        (["workspace.exported"], ("wait", "awaiting-compile-and-render")),
        ([*READY, "workspace.next-task-unchanged"], ("save", "workspace.next-task-unchanged")),
        ([*READY, "workspace.next-task-unchanged", "workspace.published"], ("save", "workspace.published")),
        ([*READY, "workspace.reused", "revision.corrected"], ("discard", "revision.corrected")),
        (["render.failed", "compile.failed", *READY, "workspace.reused"], ("discard", "render.failed")),
    ],
)
def test_outcome(spark, events, want):
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(events)], "rev string, seq int, type string")
    got = outcome.decide(rows, ["rev"], ["seq"]).collect()
    assert [(r["action"], r["reason"]) for r in got] == [want]


def test_review(spark):
    evidence = lambda d: (True, (d, "c"))
    kind = "checks map<string, struct<passed: boolean, evidence: struct<candidate_digest: string, candidate_commit: string>>>"
    good = {c: evidence("d") for c in outcome.CHECKS}
    rows = spark.createDataFrame([(good,), ({**good, "privacy": evidence("x")},), ({k: v for k, v in good.items() if k != "tests"},)], kind)
    assert [r["v"] for r in rows.select(outcome.review_passes(F.col("checks"), F.lit("d"), F.lit("c")).alias("v")).collect()] == [True, False, False]


def test_range_join_equals_nested_loop(spark):
    points = spark.range(300).select((F.col("id") * 0.37 - 20).alias("at"))
    spans = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2.0 - 30).alias("s"), (F.col("id") * 2.0 - 30 + F.col("id") % 17 - 1).alias("e"))
    want = points.crossJoin(spans).filter("at >= s AND at < e").select("at", "k")
    for width in (0.5, 4, 100):
        got = intervals.range_join(points, spans, "at", "s", "e", width).select("at", "k")
        assert determinism.same_rows(got, want)


def test_range_join_plans_no_nested_loop(spark):
    points, spans = spark.range(10).select(F.col("id").cast("double").alias("at")), spark.range(10).select(F.col("id").cast("double").alias("s"), (F.col("id") + 2.0).alias("e"))
    plan = intervals.range_join(points, spans, "at", "s", "e", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mount_phases(spark):
    phase = lambda f, **k: spark.range(1).select(intervals.mount_phase(F.lit(f), F.lit(20), F.lit(30), F.lit(k.get("premount", 0))).alias("v")).first()["v"]
    assert [phase(19), phase(20), phase(49), phase(50)] == ["inactive", "active", "active", "inactive"]
    assert [phase(15, premount=5), phase(14, premount=5)] == ["premount", "inactive"]


def test_segments_round_both_ends(spark):
    rows = spark.createDataFrame([(0, 4080.0), (1, 6419.0), (2, 8467.0), (3, 11767.0)], "idx int, end_ms double")
    got = intervals.segments_from_ends(rows.withColumn("k", F.lit(1)), ["k"], ["idx"], "end_ms", 60).orderBy("idx").collect()
    assert [r["from_frame"] for r in got] + [got[-1]["to_frame"]] == [0, 245, 385, 508, 706]


def test_cues_hand_off(spark):
    ends, appear = [20, 20, 20, 20, 50], [4, 9, 12, 15, 20]
    rows = spark.createDataFrame([(1, i, a, e) for i, (a, e) in enumerate(zip(appear, ends, strict=True))], "k int, idx int, appear_frame int, disappear_frame int")
    got = intervals.cue_violations(rows, ["k"]).orderBy("idx").collect()
    assert not any(r["ordered"] or r["shared_end"] or r["handed_off"] for r in got)
    assert [(r["group_size"], r["slot"]) for r in got] == [(4, 0), (4, 1), (4, 2), (4, 3), (1, 0)]
    visible = rows.filter((F.col("appear_frame") <= 20) & (F.lit(20) < F.col("disappear_frame")))
    assert [r["idx"] for r in visible.collect()] == [4]


def test_pages(spark):
    rows = spark.range(20).select(F.lit(1).alias("k"), "id")
    got = intervals.pages(rows, ["k"], [F.col("id")]).orderBy("rank").collect()
    assert [(r["rank"], r["page"], r["slot"], r["start"], r["duration"]) for r in got[3:6]] == [(4, 0, 3, 18, 54), (5, 1, 0, 0, 72), (6, 1, 1, 6, 66)]
    totals = spark.range(1).select(intervals.page_totals(F.lit(20)).alias("t")).first()["t"]
    assert (totals["ranking"], totals["transition"], totals["duration"]) == (360, 340, 400)


def test_tree(spark):
    rows = [(1, None, 0, "a", True), (2, 1, 1, None, True), (3, 1, 0, "b", False), (4, 3, 0, None, True), (5, 2, 0, None, True)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ord int, backend string, shown boolean")
    order = [r["node_id"] for r in tree.descend(nodes).orderBy("path").collect()]
    assert order == [1, 3, 4, 2, 5]
    assert {r["node_id"]: r["inherited_backend"] for r in tree.inherit(nodes, ["backend"]).collect()} == {1: "a", 2: "a", 3: "b", 4: "b", 5: "a"}
    assert {r["node_id"] for r in tree.visible(nodes, F.col("shown")).collect()} == {1, 2, 5}
    assert {r["node_id"]: r["size"] for r in tree.subtree_sizes(nodes).collect()} == {1: 5, 2: 2, 3: 2, 4: 1, 5: 1}
    assert tree.violations(nodes).isEmpty()


def test_cycles_are_found(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 2, 1)], "node_id long, parent_id long, ord int")
    with pytest.raises(RuntimeError, match="levels"):
        tree.descend(nodes, most=5)
    ring = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 4, 0), (4, 3, 0)], "node_id long, parent_id long, ord int")
    assert {r["node_id"] for r in tree.unreached(ring).collect()} == {3, 4}


def test_deep_trees(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(80)], "node_id long, parent_id long, ord int")
    assert tree.descend(nodes).agg(F.max("depth")).first()[0] == 79


def test_very_deep_trees(spark):
    """A chain of 100,000 nodes, each operation in fewer than 40 jobs."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"), (F.col("id") != 70_000).alias("shown"))
    track = spark.sparkContext.statusTracker()
    for name, f, want in (
        ("depth", lambda: tree.lift(chain, {}).agg(F.sum("depth"), F.count(F.lit(1))).first(), (n * (n - 1) // 2, n)),
        ("visible", lambda: (tree.visible(chain, F.col("shown")).count(),), (70_000,)),
        ("sizes", lambda: tree.subtree_sizes(chain).agg(F.sum("size"), F.max("size")).first(), (n * (n + 1) // 2, n)),
    ):
        spark.sparkContext.setJobGroup(name, name)
        assert tuple(f()) == want
        assert len(track.getJobIdsForGroup(name)) < 40, name
    spark.sparkContext.setJobGroup("rest", "rest")


def test_wide_trees_are_not_sent_about(spark):
    """A wide tree takes as many steps as its depth asks for, and no table of the tree's size goes to all tasks by a guess."""
    n = 5000
    wide = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.when(F.col("id") < 20, 0).otherwise(F.col("id") % 19 + 1)).cast("long").alias("parent_id"), F.col("id").alias("ord"), F.lit(1).alias("v"))
    track = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("wide", "wide")
    sizes = tree.subtree_sizes(wide)
    assert {r["node_id"]: r["size"] for r in sizes.filter("node_id < 20").collect()} == {0: n} | {i: 1 + sum(j % 19 + 1 == i for j in range(20, n)) for i in range(1, 20)}
    assert len(track.getJobIdsForGroup("wide")) < 25
    spark.sparkContext.setJobGroup("rest", "rest")
    sums = tree.subtree_sums(tree.toured(wide), "v")
    assert "Broadcast" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sums.join(sizes, "node_id").filter("total <> size").isEmpty() and sums.count() == n


@pytest.mark.parametrize("seed", range(3))
def test_trees_by_walking(spark, seed):
    """Random forests with orphans and cycles: what a walk finds."""
    rng = random.Random(seed)
    parent = {i: None if i < 3 else rng.choice([rng.randrange(i), rng.randrange(i), 900]) if rng.random() < 0.95 else rng.randrange(40) for i in range(60)}
    place = {i: rng.randrange(4) for i in parent}
    value = {i: rng.choice([None, rng.randrange(9)]) for i in parent}
    below = {i: sorted((j for j in parent if parent[j] == i and i != j), key=lambda j: (place[j], j)) for i in parent}
    order, want = [], {}

    def walk(i, depth, root, line):
        order.append(i)
        start = len(order)
        line = [*line, i]
        for j in below[i]:
            walk(j, depth + 1, root, line)
        named = next((value[x] for x in reversed(line) if value[x] is not None), None)
        want[i] = (depth, root, named, all(value[x] != 8 for x in line), 100.0 - sum(value[x] or 0 for x in line[:-1]), start - 1, len(order) - 1, sum(value[x] or 0 for x in order[start - 1 :]))

    for i in sorted((i for i in parent if parent[i] is None), key=lambda i: (place[i], i)):
        walk(i, 0, i, [])
    nodes = spark.createDataFrame([(i, parent[i], place[i], value[i]) for i in parent], "node_id long, parent_id long, ord int, value long")
    assert {(r["node_id"], r["depth"], r["root_id"], r["inherited_value"]) for r in tree.inherit(nodes, ["value"]).collect()} == {(i, *w[:3]) for i, w in want.items()}
    assert {r["node_id"] for r in tree.visible(nodes, F.col("value") != 8).collect()} == {i for i, w in want.items() if w[3]}
    assert {(r["node_id"], r["local_frame"]) for r in tree.local_frames(nodes, F.col("value"), F.lit(100)).collect()} == {(i, w[4]) for i, w in want.items()}
    toured = tree.toured(nodes)
    assert {(r["node_id"], r["entry"], r["exit"]) for r in toured.collect()} == {(i, *w[5:7]) for i, w in want.items()}
    assert {(r["node_id"], r["total"]) for r in tree.subtree_sums(toured, "value").collect()} == {(i, w[7]) for i, w in want.items()}
    assert {r["node_id"] for r in tree.unreached(nodes).collect()} == set(parent) - set(want)
    pairs = spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in range(60)], "upper long, lower long")
    inside = lambda a, b: a in want and b in want and want[a][5] <= want[b][5] <= want[a][6]
    assert all(r["contained"] == inside(r["upper"], r["lower"]) for r in tree.contains(toured, pairs).collect())


@pytest.mark.parametrize("salts", [1, 5])
def test_range_join_by_pairs(spark, salts):
    rng = random.Random(salts)
    spans = [(i, rng.choice([None, float(rng.randrange(40))]), rng.choice([None, float(rng.randrange(60))])) for i in range(50)]
    points = [(i, rng.choice([None, rng.randrange(60) / 2, 7.0])) for i in range(200)]
    left, right = spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, a double, b double")
    want = sorted((p, s) for p, x in points for s, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert sorted((r["p"], r["s"]) for r in intervals.range_join(left, right, "x", "a", "b", 8, salts=salts).collect()) == want
    alone = {p for p, _ in points} - {p for p, _ in want}
    outer = intervals.range_join(left, right, "x", "a", "b", 8, "left", salts)
    assert outer.columns == ["p", "x", "s", "a", "b"] and {r["p"] for r in outer.filter("s IS NULL").collect()} == alone
    counts = {p: sum(q == p for q, _ in want) for p, _ in points}
    assert {r["p"]: r["n_present"] for r in intervals.presence(left, right, "x", "a", "b", 8).collect()} == counts


def test_presence_counts(spark):
    spans = [(0.0, 5.0), (2.0, 2.0), (3.0, 40.0), (None, 4.0), (-7.5, 0.5), (100.0, 101.0)]
    points = [-9.0, -7.5, 0.0, 0.5, 3.0, 5.0, 39.9, 40.0, 250.0]
    held = intervals.presence(spark.createDataFrame([(p,) for p in points], "at double"), spark.createDataFrame(spans, "s double, e double"), "at", "s", "e", 8)
    want = {p: sum(s is not None and s <= p < e for s, e in spans) for p in points}
    assert {r["at"]: r["n_present"] for r in held.collect()} == want


def test_drift(spark):
    rows = spark.createDataFrame([("k", 0.0), ("k", 0.0), ("m", 1.0), ("m", 2.0), ("n", None), ("n", None)], "a string, out double")
    assert [(r["a"], r["n"]) for r in determinism.drift(rows, ["a"], ["out"]).collect()] == [("m", 2)]


def test_catalogue(spark):
    rows = spark.createDataFrame([("u.a", "unit", "s", "x", ["p", "q"], ["1", "2"]), ("b.a", "behaviour", "s", "x", ["pq"], ["1", "2"]), ("u.b", "other", "t", "x", None, ["1"])], catalog.SCHEMA)
    assert [r["id"] for r in catalog.find(rows, style="s", purpose="p").collect()] == ["u.a"]
    assert catalog.find(rows).count() == 3
    assert {(r["id"], r["rule"]) for r in catalog.problems(rows).collect()} == {("u.b", "type"), ("u.b", "preserves")}


def test_laws_at_known_frames(spark):
    def at(kind, f):
        rows = spark.createDataFrame([(float(f), 30.0, 90.0)], "frame double, fps double, duration double")
        return rows.select(*(t.col.alias(k) for k, t in laws.LAWS[kind]().items())).first()

    assert at("archival-dossier.pinned-evidence-drop", 24)["rotate"] == pytest.approx(-0.25)
    rune = at("retro-ritual.rune-trace", 10)
    assert rune["draw_end"] == pytest.approx(0.4) and rune["rotate"] == -2
    stutter = at("retro-ritual.portal-tile-stutter", 16)
    assert (stutter["scale_x"], stutter["opacity"]) == (1, 1)
    assert at("retro-ritual.portal-tile-stutter", 28)["opacity"] == 0


def test_shots_have_to_be_mountable(spark):
    with pytest.raises(ValueError, match="shot"):
        tables.shots(spark, [(1, 0, 0, 0)])


def play(requests, duration=100):
    record, out = lease.Record(), []
    for r in requests:
        out.append(lease.apply(record, "r", r, duration))
    return record, out


def test_leases_expire_and_fence():
    ready = [{"request": "event", "at": 0, "type": t} for t in [*READY, "workspace.exported"]]
    record, out = play([*ready, {"request": "acquire", "at": 1000}, {"request": "acquire", "at": 1050}, {"request": "acquire", "at": 1101}])
    assert [o["status"] for o in out[3:]] == ["acquired", "busy", "acquired"] and record.fence == 2
    old = {"token": "lease-r-1", "fence": 1}
    assert lease.apply(record, "r", {"request": "commit", "at": 1102, **old}, 100)["status"] == "stale"
    assert lease.apply(record, "r", {"request": "release", "at": 1102, **old}, 100)["status"] == "ignored"
    new = {"token": "lease-r-2", "fence": 2, "commit": "c"}
    assert lease.apply(record, "r", {"request": "commit", "at": 1102, **new}, 100)["status"] == "committed"
    assert lease.reusable(record)
    assert lease.apply(record, "r", {"request": "event", "at": 1200, "type": "revision.deleted"}, 100)["status"] == "retract"
    assert not lease.reusable(record) and record.retraction == "pending"
    assert lease.apply(record, "r", {"request": "acquire", "at": 1300}, 100)["status"] == "discarded"


def test_timing_constraints():
    lease.check_timing()
    with pytest.raises(ValueError, match="heartbeat"):
        lease.check_timing(lease=100, heartbeat=90, timeout=20)


def test_leases_in_a_stream_equal_batch(spark, tmp_path):
    kinds = "revision_id string, seq long, request string, at long, type string, token string, fence long, commit string"
    rows = []
    for k in range(4):
        steps = [("event", t) for t in [*READY, "workspace.exported"]] + [("acquire", None), ("heartbeat", None), ("commit", None), ("acquire", None), ("event", "revision.deleted"), ("acquire", None)]
        rows += [(f"r{k}", i, r, 1000 * i, t, None, None, f"c{i}") for i, (r, t) in enumerate(steps)]
    requests = spark.createDataFrame(rows, kinds)
    for part, test in enumerate(("seq < 4", "seq >= 4 AND seq < 7", "seq >= 7")):
        requests.filter(test).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(requests.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = lease.run_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    out.awaitTermination()
    assert determinism.same_rows(spark.read.parquet(f"{tmp_path}/out"), lease.run_batch(requests))


def test_requests_without_a_token_hold_no_lease(spark):
    rows = [(1, "event", 0, "compile.succeeded"), (2, "event", 0, "render.succeeded"), (3, "event", 0, "workspace.exported"), (4, "acquire", 1, None), (5, "commit", 2, None), (6, "heartbeat", 3, None), (7, "checkpoint", 4, None), (8, "release", 5, None)]
    requests = spark.createDataFrame([("r", *r, None, None, "c") for r in rows], "revision_id string, seq long, request string, at long, type string, token string, fence long, commit string")
    got = {r["seq"]: r["status"] for r in lease.run_batch(requests).collect()}
    assert [got[k] for k in (4, 5, 6, 7, 8)] == ["acquired", "stale", "stale", "stale", "ignored"]


def test_deadlines(spark):
    rows = spark.createDataFrame([(0, 5, None), (0, 11, None), (0, None, None), (0, 9, 8)], "a long, b long, c long")
    got = [r["v"] for r in rows.select(lease.in_time(F.col("a"), F.col("b"), 10, F.coalesce("c", F.lit(10**6))).alias("v")).collect()]
    assert got == [True, False, False, False]

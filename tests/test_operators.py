"""Operators on small fixtures with ties, nulls and empty tables."""

import random
import re
from itertools import product

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry, text
from tessera.operators import graph, intervals, selection
from tessera.sources import annotations

EVENT = "slot string, event_id long, activity string, camera_id string, start_ms long, end_ms long"


def test_band_join_equals_brute_force(spark):
    rows = [("s", i, "a", "C1", (i * 7919) % 500, (i * 7919) % 500 + i % 9) for i in range(60)]
    e = spark.createDataFrame(rows, EVENT)
    for low, high in ((0, 0), (-30, 45), (1, 10), (-9, -3)):
        got = {(r.a_event_id, r.b_event_id) for r in intervals.band_join(e, e, ["slot"], "end_ms", "start_ms", low, high).collect()}
        assert got == {(x[1], y[1]) for x, y in product(rows, rows) if low <= y[4] - x[5] <= high}


def test_overlap_join_makes_each_pair_once(spark):
    rows = [("s", i, "a", "C1", (i * 37) % 200, (i * 37) % 200 + i * 5 % 90) for i in range(40)]
    e = spark.createDataFrame(rows, EVENT)
    got = [(r.a_event_id, r.b_event_id) for r in intervals.overlap_join(e, e, ["slot"], "start_ms", "end_ms", 16).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x, y in product(rows, rows) if min(x[5], y[5]) > max(x[4], y[4]))


def test_empty_tables(spark):
    e = spark.createDataFrame([], EVENT)
    assert intervals.temporal_gap_pairs(e, 1, 10).count() == 0
    assert intervals.islands(e, ["slot"], 10).count() == 0
    assert intervals.duplicate_events(e, 10).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = graph.connected_components(links.unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "u long, v long")))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_greedy_takes_ties_in_order(spark):
    rows = spark.createDataFrame([("s", 1, 2, 5), ("s", 1, 3, 5), ("s", 4, 5, 6), ("s", 5, 6, 7), ("t", 1, 2, 9)], "slot string, a long, b long, gap long")
    got = selection.greedy(rows, ["slot"], ["gap", "a", "b"], selection.no_reuse(("a", "b"))).collect()
    assert {tuple(r) for r in got} == {("s", 1, 2, 5), ("s", 4, 5, 6), ("t", 1, 2, 9)}


def test_box_lines_and_activities(spark, tmp_path):
    lines = ["- { geom: {id1: 71, id0: 4, ts0: 260, g0: 12 34 56 78, keyframe: true } }", "- {'geom': {'g0': '9 8 70 60', 'id0': 4, 'id1': 72, 'ts0': 300}}", "- { meta: x }", None]
    got = annotations.parse_geom(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [(71, 260, 12, 34, 56, 78), (72, 300, 9, 8, 70, 60)]
    (tmp_path / "a.yml").write_text("- {act: {act2: {person_sits_down: {}}, id2: 21, timespan: [{tsr0: [64, 98]}], actors: [{id1: 5}]}}\n- {act: {}}\n- {act: {id2: 22, timespan: [{tsr0: [3]}]}}\n")
    rows = annotations.read_activities(spark, str(tmp_path / "a.yml")).collect()
    assert [(r.activity, r.act_id, r.start_frame, r.end_frame, r.actor_ids) for r in rows] == [("person_sits_down", 21, 64, 98, [5])]


def test_camera_files(spark, tmp_path):
    (tmp_path / "c.krtd").write_text("1 0 0\n0 1 0\n0 0 1\n\n1 0 0\n0 -1 0\n0 0 -1\n\n0 0 1.5\n")
    r = annotations.read_cameras(spark, str(tmp_path / "c.krtd")).first()
    assert (r.k, r.r, r.t) == ([1, 0, 0, 0, 1, 0, 0, 0, 1], [1, 0, 0, 0, -1, 0, 0, 0, -1], [0, 0, 1.5])


def test_level_rays_have_no_ground_point(spark):
    e = [F.lit(float(i in (0, 4, 8))) for i in range(9)]
    t = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    flat = [F.lit(float(x)) for x in (1, 0, 0, 0, 0, -1, 0, 1, 0)]
    assert spark.range(1).select(geometry.ground_point(e, flat, t, F.lit(0.0), F.lit(0.0)).alias("p")).first().p is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=12))
def test_components_equal_brute_force(spark, pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    got = graph.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {(r.node, r.component) for r in got.collect()} == set(label.items())


def test_leak_and_forbidden_patterns_as_python_reads_them(spark, tmp_path):
    from tessera.plans import catalogue

    texts = ["127 seconds", "frame 3814", "127.13 - 133.43", "start_sec", "entity_a", "{name}", "__X__", "evt_x", "cluster_12", "person_opens_trunk", "45 Seconds", "at time 45", "On camera", "camera G33", "12s–180s", "around the 5", None, ""]
    flagged = {"127 seconds": "timestamp", "frame 3814": "timestamp", "127.13 - 133.43": "timestamp", "start_sec": "field", "entity_a": "field", "{name}": "template", "__X__": "template", "evt_x": "template", "cluster_12": "template"}
    assert {(x, n) for x in texts[:9] for n, ps in text.LEAKS.items() if any(re.search(p, x) for p in ps)} == set(flagged.items())
    rng = random.Random(1)
    bits = "12 127 5 .13 .5 - – s S ſ second SECONDS ſeconds at on camera cAmera G frame fRames around the time tİme start_sec entity_ a é ٣ ² \u00a0 \x1f _ __ { } x evt_ cluster_ person_sits_down \n ( .".split(" ")
    texts += ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, rules, where in (("v03_all_token_leaks", text.LEAKS, "documents"), ("v08_all_forbidden", text.FORBIDDEN, "conversations")):
        key = "doc_id" if where == "documents" else "conv_id"
        want = {i: [bool(x) and any(re.search(p, x) is not None for p in ps) for ps in rules.values()] for i, x in enumerate(texts)}
        got = {r[key]: [r[n] for n in rules] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {where} AS SELECT * FROM '{tmp_path}/{where}.parquet/*.parquet'")
        assert {r[0]: list(r[1:]) for r in con.sql(f"SELECT {key}, {', '.join(rules)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()} == want

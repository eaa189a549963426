"""Operators without SQL against brute force, and their edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera import sinks
from tessera.functions import camera, models, rouge
from tessera.operators import driving, graph, selection, slots, tracks
from tessera.operators.similarity import near_duplicate_links
from tessera.plans import catalogue
from tessera.sources import files

SF = "/root/testdata/sf0.001"
EVENT = "slot string, activity string, camera string, event_id long, start_ms long, end_ms long"


def events(n, seed, spread=40_000):
    rng = random.Random(seed)
    rows = [(rng.choice("st"), rng.choice(["x", "y"]), rng.choice(["G300", "G301", "G302"]), i, t := rng.randrange(0, spread, 250), t + rng.randrange(0, 3000)) for i in range(n)]
    return rows


def test_same_events_equal_one_fold_of_the_whole_slot(spark):
    rows = events(150, 1) + [("u", "x", "G300", 900 + i, i * 20_000, i * 20_000) for i in range(4)]
    want = set()
    for key, of in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[4], r[3])), key=lambda r: r[:2]):
        clusters = []
        for e in of:
            for c in clusters:
                if any(m[2] != e[2] and abs(m[4] - e[4]) <= (8000 if {m[2], e[2]} == {"G300", "G301"} else 2000) for m in c):
                    c.append(e)
                    break
            else:
                clusters.append([e])
        want |= {(*key, c[0][3], m[3]) for c in clusters for m in c}
    assert {tuple(r) for r in slots.same_events(spark.createDataFrame(rows, EVENT)).collect()} == want


def test_runs_keep_what_acts_on_each_other(spark):
    rows = events(60, 2, 600_000)
    got = slots.runs(spark.createDataFrame(rows, EVENT), ["slot"], 5_000).collect()
    run = {r.event_id: (r.slot, r.run) for r in got}
    assert all(run[a[3]] == run[b[3]] for a in rows for b in rows if a[0] == b[0] and 0 <= b[4] - max(a[4], a[5]) <= 5_000)
    assert len(set(run.values())) > 2


def test_links_capped_in_runs_equal_one_fold(spark):
    import pandas as pd

    e = catalogue.QUERIES["g01_capped_links"](spark, "/root/testdata/sf0.01").collect()
    from tessera.operators.intervals import band_join
    from tessera.plans.temporal import events_of

    ev = events_of(spark, "/root/testdata/sf0.01")
    l = band_join(ev, ev, ["slot"], "end_ms", "start_ms", 1_000, 60_000).where("a_camera_id <> b_camera_id").select("slot", "a_event_id", "b_event_id", "gap_ms").toPandas()
    want = set()
    for _, of in l.sort_values(["slot", "gap_ms", "a_event_id", "b_event_id"]).groupby("slot"):
        taken = selection.at_most(2, "a_event_id", "b_event_id")
        state = {}
        want |= {(r["slot"], r["a_event_id"], r["b_event_id"]) for r in of.to_dict("records") if taken(state, r)}
    assert {(r.slot, r.a_event_id, r.b_event_id) for r in e} == want and isinstance(l, pd.DataFrame)


def test_bucket_pick_takes_crossing_ones_first(spark):
    rows = [("s", f"h{i}", k, p, c) for i, (k, p, c) in enumerate([("a", "far", False), ("b", "near", False), ("a", "near", True), ("c", "far", False), ("d", "moderate", False)])]
    got = selection.bucket_pick(spark.createDataFrame(rows, "slot string, h string, key string, proximity string, crosses boolean"), ["slot"], 3).collect()
    assert {r.h for r in got} == {"h2", "h1", "h4"}


def test_event_chains_obey_their_rules(spark):
    got = catalogue.QUERIES["g08_event_chain"](spark, SF).collect()
    for _, chain in itertools.groupby(sorted(got, key=lambda r: (r.scene, r.place)), key=lambda r: r.scene):
        c = list(chain)
        assert len(c) in (3, 4) and len({r.obj for r in c}) == len(c)
        assert all(b.first >= a.last - 5 and b.last >= a.last for a, b in zip(c, c[1:]))


def test_ordering_options_hold_the_right_order_once(spark):
    got = catalogue.QUERIES["q02_ordering_questions"](spark, "/root/testdata/sf0.01").collect()
    numerals = ["I", "II", "III", "IV"]
    for r in got:
        ids, shown, options = r.events.split(","), r.shown.split(","), r.options.split("|")
        right = " -> ".join(numerals[shown.index(i)] for i in ids)
        assert len(set(options)) == 4 and options[r.answer_index] == right
    assert got


def test_persons_are_not_given_twice(spark):
    got = catalogue.QUERIES["g07_person_assignment"](spark, SF).collect()
    assert got and len({(r.slot, r.camera, r.known) for r in got}) == len(got) == len({r.id for r in got})
    assert all(r.score >= 0 for r in got)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            words = [w if rng.random() > 0.03 else f"v{rng.randrange(99)}" for w in base]
            rows.append((len(rows), " ".join(words)))
    rows += [(900, ""), (901, None), (902, "a"), (903, "a"), (904, "a b")]
    members, links = near_duplicate_links(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    rep = {r.k: r.rep for r in members.collect()}
    sets = {k: frozenset((t or "").split()) for k, t in rows}
    assert all((rep[a] == rep[b]) == (sets[a] == sets[b]) for a in sets for b in sets)
    want = {(a, b) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) > 90 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in links.collect()} == want and want


def test_paths_cross(spark):
    a = [(1, 1, f, x, 0, 10 * x + 500, 0, 10 * x + 520, 40) for f, x in enumerate([-9, -6, 0, 6, 9])]
    b = [(1, 2, f, 0, 0, 500, 0, 520, 40) for f in range(5)]
    c = [(1, 3, f + 100, 40, 40, 0, 0, 20, 40) for f in range(5)]
    t = spark.createDataFrame(a + b + c, "scene long, obj long, frame long, x long, y long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.a_obj, r.b_obj): (r.n, r.frame, r.d2, r.crosses) for r in tracks.approaches(t, 4).collect()}
    assert got == {(1, 2): (5, 2, 0, True)}


def test_cameras_see_the_ground(spark):
    m, c = camera.camera_matrix(30.0, 40.0, 5.0)
    ok, x, y = camera.ground_sql("960.0D", "540.0D", [f"CAST({v!r} AS DOUBLE)" for v in m], [f"CAST({v!r} AS DOUBLE)" for v in c])
    r = spark.range(1).selectExpr(f"{ok} AS ok", f"{x} AS x", f"{y} AS y").first()
    import math

    far = 5.0 / math.tan(math.radians(40.0))
    assert r.ok and abs(r.x - far * math.cos(math.radians(30))) < 1e-9 and abs(r.y - far * math.sin(math.radians(30))) < 1e-9
    up, *_ = camera.ground_sql("960.0D", "-5000.0D", [f"CAST({v!r} AS DOUBLE)" for v in m], [f"CAST({v!r} AS DOUBLE)" for v in c])
    assert not spark.range(1).selectExpr(f"{up} AS ok").first().ok


def test_quadrants_equal_angles(spark):
    import math

    rows = [(x, y) for x in range(-4, 5) for y in range(-4, 5)]
    got = {(r.x, r.y): r.d for r in spark.createDataFrame(rows, "x long, y long").selectExpr("x", "y", f"{driving.quadrant('x', 'y')} AS d").collect()}
    for x, y in rows:
        a = round(math.degrees(math.atan2(y, x)), 9)
        assert got[x, y] == ("in_front" if -45 <= a < 45 else "left" if 45 <= a < 135 else "behind" if a >= 135 or a < -135 else "right")


def test_rouge_by_hand():
    assert rouge.scores("the cats sat", "the cat sat down") == (6 / 7, 4 / 5, 6 / 7)
    assert rouge.scores("", None) == (0.0, 0.0, 0.0) and rouge.scores("a", "a")[1] == 0.0
    assert rouge.lcs(list("abcbdab"), list("bdcaba")) == 4
    words = "caresses ponies cats agreed plastered motoring conflated troubled sized hopping falling filing happy relational formalize adjustable probate controll".split()
    assert [rouge.stem(w) for w in words] == "caress poni cat agre plaster motor conflat troubl size hop fall file happi relat formal adjust probat control".split()


class Flaky:
    calls = 0

    def answer(self, prompts):
        Flaky.calls += 1
        if Flaky.calls < 3 or "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]


def test_models_are_asked_again(spark):
    df = spark.createDataFrame([("x",)], "p string").coalesce(1)
    assert models.ask(df, "p", client=Flaky).first().reply == "X"
    assert models.ask(spark.createDataFrame([("bad",)], "p string"), "p", client=Flaky).first().reply is None
    assert models.ask(df.limit(0), "p").count() == 0


def test_written_questions_come_back(spark, tmp_path):
    q = catalogue.QUERIES["s23_dataset_entries"](spark, SF).withColumns({"slot": F.substring("key", 1, 10), "category": F.element_at(F.split("key", "_"), 2)})
    sinks.write_slots(q, str(tmp_path / "slots"))
    back = spark.read.json(str(tmp_path / "slots"))
    assert back.count() == q.select("slot").distinct().count() and back.agg(F.sum("total_questions")).first()[0] == q.count()
    sinks.write_categories(q, str(tmp_path / "cats"))
    assert spark.read.json(str(tmp_path / "cats")).count() == q.count()
    with pytest.raises(ValueError):
        sinks.write_categories(q.limit(1).withColumn("category", F.lit("../x")), str(tmp_path / "bad"))
    sinks.write_results(q, str(tmp_path / "res"), "uniform", "org/model")
    assert (tmp_path / "res" / "uniform_org_model").is_dir()
    for i in range(2):
        sinks.audit(spark, str(tmp_path / "audit"), [("progress", "s1", f"step {i}"), ("call", f"c{i}", "x")])
    last = {(r.kind, r.key): r.text for r in sinks.latest(spark.read.parquet(str(tmp_path / "audit"))).collect()}
    assert last == {("progress", "s1"): "step 1", ("call", "c0"): "x", ("call", "c1"): "x"}
    clouds = spark.createDataFrame([("a", [1.0, 2.0], [1, 2])], "token string, points array<double>, labels array<long>")
    sinks.write_points(clouds, str(tmp_path / "pts"))
    assert spark.read.parquet(str(tmp_path / "pts")).first().labels == [1, 2]


def test_points_and_lists(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.bin").write_bytes(np.arange(8, dtype="<f4").tobytes())
    got = files.parse_points(spark.read.format("binaryFile").load(str(tmp_path / "a.bin"))).first()
    assert got.n == 2 and list(got.points) == [0, 1, 2, 3, 0, 4, 5, 6, 7, 0]
    graph.checkpoint_dir(spark)
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", None)], "token string, next string")
    assert {tuple(r) for r in files.list_places(nodes).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "x", 0)}


def test_taxonomies_with_a_cycle_raise(spark):
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), depth=5)


@pytest.mark.parametrize("name", ["j13_frame_pairs", "w01_activity_intervals", "q12_sequential", "q12_comparative", "w08_approaches", "v01_category_rules", "a15_question_scores", "g04_ordering_groups", "g02_event_clusters", "h01_merged_descriptions", "g07_person_assignment", "e05_letter_matches", "s18_scene_graphs", "v04_near_duplicates"])
def test_empty_tables_give_no_rows(spark, name, tmp_path):
    for t in ("lineitem", "events", "part", "documents"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_counts_of_one_activity(spark):
    sf = "/root/testdata/sf0.001"
    acts = catalogue.QUERIES["s04_slot_events"](spark, sf).count()
    got = catalogue.QUERIES["a02_dedup_counts"](spark, sf).collect()
    clusters = {}
    for r in catalogue.QUERIES["g02_event_clusters"](spark, sf).collect():
        clusters.setdefault((r.slot, r.activity), set()).add(r.cluster)
    assert {(r.slot, r.activity): r.n for r in got} == {k: len(v) for k, v in clusters.items() if 2 <= len(v) <= 20} and acts
    assert all(r.question.startswith("How many times does someone perform the action of ") for r in got)


def test_selected_pairs_reuse_no_activity(spark):
    sf = "/root/testdata/sf0.01"
    cand = [r.asDict() for r in catalogue.QUERIES["t01_best_pairs"](spark, sf).collect()]
    want, used = set(), {}
    for c in sorted(cand, key=lambda c: (c["slot"], -c["score_tenths"], c["gap_ms"], c["a_event_id"], c["b_event_id"])):
        mine = used.setdefault(c["slot"], set())
        if not {c["a_activity"], c["b_activity"]} & mine:
            mine |= {c["a_activity"], c["b_activity"]}
            want.add((c["a_event_id"], c["b_event_id"]))
    assert {(r.a_event_id, r.b_event_id) for r in catalogue.QUERIES["g03_selected_pairs"](spark, sf).collect()} == want and want


def test_diverse_groups_share_no_event(spark):
    got = catalogue.QUERIES["g05_diverse_groups"](spark, "/root/testdata/sf0.01").collect()
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, []).append(r)
    assert got and all(len(v) <= 2 and min(x.rank for x in v) == 1 for v in by_slot.values())


def test_person_clusters_equal_union_find(spark):
    sf = "/root/testdata/sf0.01"
    links = catalogue.QUERIES["j04_person_handoffs"](spark, sf).where("confidence >= 70").collect()
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = find((r.slot, r.a_camera, r.a_actor)), find((r.slot, r.b_camera, r.b_actor))
        up[max(a, b)] = min(a, b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    want = sorted((g[0], len(v), len({x[1] for x in v}), min(f"{c}_actor_{a}" for _, c, a in v)) for g, v in groups.items() if len(v) >= 2 and len({x[1] for x in v}) >= 2)
    got = catalogue.QUERIES["gr01_person_clusters"](spark, sf).collect()
    assert sorted((r.slot, r.n, r.n_cameras, r.first_entity) for r in got) == want and want

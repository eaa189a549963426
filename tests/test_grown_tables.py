"""Queries on events as larger or odder tables have them, against their SQL or plain folds."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from tessera.operators import sweeps
from tessera.plans import catalogue
from tessera.plans import slots as plans

RAW = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tables(spark, folder, rows):
    """A folder with events of rows: event_id, second, user_id, event_type, value."""
    at = datetime(2024, 1, 1)
    made = [(i, at + timedelta(seconds=t), u, kind, value, "{}") for i, t, u, kind, value in rows]
    spark.createDataFrame(made, RAW).repartition(2).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def some(n, seed, seconds=3_000, users=40, ids=None):
    rng = random.Random(seed)
    kinds = ["view", "click", "error", "signup", "purchase"]
    return [(ids(i) if ids else i, rng.randrange(seconds * 4) / 4 + 20, rng.randrange(users), rng.choice(kinds), rng.choice([0.0, 1.5, 7.25, 20.0, 45.0])) for i in range(n)]


def same_as_sql(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = Counter(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    assert Counter(tuple(map(str, r)) for r in df.select(cols).collect()) == want and want


@pytest.mark.parametrize("name", ["a15_question_scores", "a16_verify_report", "q17_reshuffled_options"])
def test_questions_that_share_an_id(spark, name, tmp_path):
    """Ids are cut at six digits: 1234560 to 1234569 are all 123456, as far as they are of one category."""
    rows = some(300, 5, 200_000, ids=lambda i: 1_234_500 + i) + some(60, 6, ids=lambda i: 123_440 + i)
    same_as_sql(spark, tables(spark, tmp_path, rows), name)


@pytest.mark.parametrize("name", ["gr01_components", "t02_topk_groups", "q02_ordering", "j17_between_triples"])
@pytest.mark.parametrize("users", [3, 40])
def test_dense_slots(spark, name, users, tmp_path):
    """Slots of many events in a short time, and of three cameras only; the same second on several events."""
    same_as_sql(spark, tables(spark, tmp_path, some(120, users, 300, users)), name)


def test_components_of_slots_that_share_an_id(spark, tmp_path):
    rows = [(1, 100, 1, "view", 1.0), (2, 105, 2, "view", 1.0), (2, 90_100, 1, "view", 1.0), (3, 90_105, 2, "view", 1.0), (3, 200_000, 5, "view", 1.0), (9, 300_000, 5, "view", 1.0)]
    same_as_sql(spark, tables(spark, tmp_path, rows), "gr01_components")


def test_capped_links_of_a_dense_slot_equal_one_fold(spark, tmp_path):
    from tessera.operators.selection import at_most
    from tessera.plans.temporal import events_of

    folder = tables(spark, tmp_path, some(150, 9, 200))
    ev = events_of(spark, folder).collect()
    pairs = [{"gap": b.start_ms - a.end_ms, "a_event_id": a.event_id, "b_event_id": b.event_id} for a in ev for b in ev if a.camera_id != b.camera_id and 1_000 <= b.start_ms - a.end_ms <= 60_000]
    take, state = at_most(2, "a_event_id", "b_event_id"), {}
    want = {(p["a_event_id"], p["b_event_id"], p["gap"]) for p in sorted(pairs, key=lambda p: (p["gap"], p["a_event_id"], p["b_event_id"])) if take(state, p)}
    got = catalogue.QUERIES["g01_capped_links"](spark, folder).collect()
    assert {(r.a_event_id, r.b_event_id, r.gap_ms) for r in got} == want and len(got) == len(want) > 50


def test_chains_of_events_without_an_id(spark, tmp_path):
    rows = [(None if i % 4 == 0 else i, 100 + 5 * i, i, kind, 1.0) for i, kind in enumerate(["view", "click", "error", "signup", "view"])]
    same_as_sql(spark, tables(spark, tmp_path, rows), "t02_topk_groups")


def test_links_of_events_without_an_id(spark, tmp_path):
    rows = [(None, 100, 0, "view", 1.0), (None, 100, 8, "view", 1.0), (3, 110, 1, "view", 1.0), (4, 111, 2, "view", 1.0)]
    got = catalogue.QUERIES["g01_capped_links"](spark, tables(spark, tmp_path, rows)).collect()
    assert sorted((r.b_event_id, r.gap_ms) for r in got if r.a_event_id is None) == [(3, 9_000), (3, 9_000), (4, 10_000), (4, 10_000)] and len(got) == 4


CHAINS = {"own": lambda i: i, "shared": lambda i: i % 25 + 100 * (i % 3), "missing": lambda i: None if i % 5 == 0 else i}


@pytest.mark.parametrize("ids", CHAINS)
def test_best_groups_are_those_of_all_chains(spark, ids, tmp_path):
    """Of two slots, dense and sparse; a missing user has no camera and no description."""
    rows = some(45, 4, 150, 24, CHAINS[ids]) + [(i, t + 90_000, u, k, v) for i, t, u, k, v in some(30, 8, 400, 24, CHAINS[ids])]
    folder = tables(spark, tmp_path, [(i, t, None if n % 11 == 0 else u, k, v) for n, (i, t, u, k, v) in enumerate(rows)])
    same_as_sql(spark, folder, "g04_ordering_groups")
    all_ = sorted((r.slot, -r.score, r.events) for r in catalogue.QUERIES["g04_ordering_groups"](spark, folder).collect())
    want = [r for slot in sorted({r[0] for r in all_}) for r in [r for r in all_ if r[0] == slot][:12]]
    got = sweeps.best_groups(plans.placed(spark, folder), 12, 2_000, 60_000).collect()
    assert [(r.slot, -r.score, r.events) for r in sorted(got, key=lambda r: (r.slot, r.rank))] == want and len(want) > 12


@pytest.mark.parametrize("entries", [sweeps.TABLE, 50])
def test_all_groups_of_a_dense_slot(spark, entries, tmp_path):
    """Scores from a table or, if it would be large, from the codes at hand; no chain is joined or shuffled."""
    from tessera.operators.slots import ordering_groups

    events = plans.placed(spark, tables(spark, tmp_path, [(i, t, None if i % 11 == 0 else u, k, v) for i, t, u, k, v in some(70, 15, 150, 24)]))
    got = sweeps.all_groups(events, 2_000, 60_000, entries)
    want = Counter((r.slot, ",".join(map(str, r.events)), ",".join(c for c in r.cameras if c), r.score) for r in ordering_groups(events, 2_000, 60_000).collect())
    assert Counter((r.slot, r.events, r.cameras, r.score) for r in got.collect()) == want and len(want) > 100
    assert catalogue.QUERIES["g04_ordering_groups"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


def test_description_overlaps_of_dense_slots(spark, tmp_path):
    """Across hours, with equal times and users and ids that are missing; words are not compared for each pair."""
    rows = some(250, 16, 9_000, 40) + [(None if i % 2 else 900 + i, 3_590 + i, None if i % 3 == 0 else i, "view", 1.0) for i in range(24)]
    folder = tables(spark, tmp_path, rows)
    same_as_sql(spark, folder, "x03_description_overlap")
    got = catalogue.QUERIES["x03_description_overlap"](spark, folder)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    all_, few = (Counter(map(tuple, sweeps.set_overlaps(plans.acts(spark, folder), "slot", "camera", "event_id", "told", str.split, "end_ms", "start_ms", 1_000, 300_000, n).collect())) for n in (sweeps.TABLE, 10))
    assert all_ == few and len(all_) > 1_000


def test_diverse_groups_of_a_dense_slot(spark, tmp_path):
    """400 events a minute have over 10^10 chains, which are not made; no chain scores over 43, and the best by ids share an event."""
    got = catalogue.QUERIES["g05_diverse_groups"](spark, tables(spark, tmp_path, some(2_000, 3, 300, 80))).collect()
    assert [r.score for r in got] == [43, 43] and min(r.rank for r in got) == 1 and got[0].events != got[1].events


def test_ordering_questions_of_a_dense_slot(spark, tmp_path):
    got = catalogue.QUERIES["q02_ordering_questions"](spark, tables(spark, tmp_path, some(2_000, 5, 300, 80))).collect()
    assert len(got) == 2 and all(sorted(r.events.split(",")) == sorted(r.shown.split(",")) and len(set(r.options.split("|"))) == 4 for r in got)


def test_links_of_dense_slots(spark, tmp_path):
    """Links of both directions and of several events of two actors; a missing user or id links nothing.  No pair of events is shuffled."""
    rows = some(300, 6, 120, 24) + [(900 + i, t + 90_000, None if i % 3 == 0 else u, k, v) for i, t, u, k, v in some(60, 7, 90, 12)]
    folder = tables(spark, tmp_path, [*rows, (None, 30, 1, "view", 1.0)])
    same_as_sql(spark, folder, "gr05_undirected_links")
    assert "Join" not in catalogue.QUERIES["gr05_undirected_links"](spark, folder)._jdf.queryExecution().toString()


def test_pairs_tell_relations_by_bits(spark, tmp_path):
    """All relations of activities, against SQL; none is looked up by names for each pair."""
    from tessera.functions import wording

    folder = tables(spark, tmp_path, some(200, 12, 300, 24))
    same_as_sql(spark, folder, "h04_pair_gates")
    assert "person_opens_trunk" not in catalogue.QUERIES["h04_pair_gates"](spark, folder)._jdf.queryExecution().analyzed().expressions().toString()
    names = sorted({a for p in wording.related() for a in p} | {"person_walks"})
    d = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    d = d.selectExpr("*", *[f"{c} AS {n}" for s in "ab" for n, c in wording.relation_bits(s, f"{s}_").items()])
    assert d.where(f"NOT ({wording.relation('a', 'b')}) <=> ({wording.relation_of('a_', 'b_')})").isEmpty()


def test_overlaps_of_dense_slots(spark, tmp_path):
    """Entities of hours and of a moment, with equal starts and a missing user; only one side of the join is spread over buckets."""
    rows = some(250, 13, 60_000, 40) + [(1_000 + i, 500, u, "view", v) for i, (u, v) in enumerate([(8, 3.0), (16, 3.0), (24, 0.0), (None, 5.0), (32, -2.0)])]
    folder = tables(spark, tmp_path, [*rows, *[(2_000 + u, 86_000, u, "view", 30.0) for u in range(0, 40, 3)]])
    same_as_sql(spark, folder, "j07_overlap_pairs")
    assert catalogue.QUERIES["j07_overlap_pairs"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


@pytest.mark.parametrize("ids", [1, 10**15])
def test_distinct_episodes_of_dense_slots(spark, ids, tmp_path):
    """Actors of one to four digits, negative ones, many that share no action, some without a user or action; texts that fit one block
    of the hash and texts that don't.  No pair is a row: a join of the actors would have to sort them all."""
    rows = some(600, 21, 40_000, 1_500) + [(2_000 + i, 90_000, -i if i % 3 else None, "view", 1.0) for i in range(60)] + [(None, 50 + i, 7 * i, "view", 1.0) for i in range(30)]
    folder = tables(spark, tmp_path, [(i, t, None if u is None else u * ids, k, v) for i, t, u, k, v in rows])
    same_as_sql(spark, folder, "j24_distinct_episodes")
    assert "Join" not in catalogue.QUERIES["j24_distinct_episodes"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_least_pairs_of_any_items(spark):
    """More items than a word has bits; slots where all share one, of one node and of names longer than a block."""
    from hashlib import md5

    rng = random.Random(4)
    rows = [(s, i, rng.sample([f"x{k}" for k in range(150)], 3) + ["one"] * (s == "all")) for s in ("few", "all", "long" * 20) for i in range(90)] + [("single", 5, ["a"])]
    got = {(r.slot, r.a, r.b) for r in sweeps.least_disjoint_pairs(spark.createDataFrame(rows, "slot string, n long, l array<string>"), "slot", "n", "l", "s").collect()}
    want = {(s, *min((md5(f"s::{s}::{a}::{b}".encode()).hexdigest(), a, b) for t, a, x in rows for u, b, y in rows if t == u == s and a < b and not set(x) & set(y))[1:]) for s in ("few", "long" * 20)}
    assert got == want


def test_heads_of_hashes():
    from hashlib import md5

    from tessera.functions import md5_heads

    texts = [f"{i:05}" for i in range(0, 99_999, 2)]
    words = [int.from_bytes(b"ab::", "little"), *md5_heads.spelled([t.encode() + b"\x80" for t in texts], 0), *[0] * 11, 9 * 8, 0]
    assert md5_heads.heads(words, len(texts)).tolist() == [int(md5(f"ab::{t}".encode()).hexdigest()[:8], 16) for t in texts]


def test_chains_of_ids_shared_by_slots_and_within_one(spark, tmp_path):
    """Ids are shared by rows of one slot, of two, and of both; events that are one in either slot are in no chain of the other."""
    rows = [(k % 18 + 18 * (k % 3), t, u, v, x) for k, t, u, v, x in some(60, 31, 120, 16)] + [(k % 18 + 18 * (k % 2), t + 90_000, u, v, x) for k, t, u, v, x in some(40, 32, 120, 16)]
    folder = tables(spark, tmp_path, rows + [(500 + k, t, u, v, x) for k, t, u, v, x in some(30, 33, 120, 16)])
    same_as_sql(spark, folder, "g04_ordering_groups")


def test_ordering_questions_join_no_ids_that_no_slots_share(spark, tmp_path):
    """The events are shuffled once by slot and once by id for the ids that slots share, not joined with all others in buckets."""
    plan = catalogue.QUERIES["q02_ordering_questions"](spark, tables(spark, tmp_path, some(30, 34)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Generate explode") == 1


ODD = [(None, 500, 3, "view", 0.0), (None, 500, 4, "view", 0.0), (7_001, 500, 5, "view", -45.0), (7_002, 500, None, "view", 1.0), (7_003, 460, 6, "view", None), (7_004, 85_990, 8, "view", 30.0), (7_005, 86_010, 9, "click", 1.0)]


def test_overlaps_are_ranges(spark, tmp_path):
    """Rows of lists as short as may be, and long ones; pairs are neither joined nor dealt to buckets."""
    from tessera.plans.temporal import events_of
    from tessera.sources.adapters import entity_view

    folder = tables(spark, tmp_path, some(400, 41, 4_000, 120) + ODD)
    same_as_sql(spark, folder, "j07_overlap_pairs")
    assert "Join" not in catalogue.QUERIES["j07_overlap_pairs"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    rows = entity_view(events_of(spark, folder))
    few, all_ = (Counter(map(tuple, sweeps.overlapping_pairs(rows, "slot", "camera_id", "actor_id", "first_ms", "last_ms", *n).collect())) for n in ((3, 2), (10**6, 10**6)))
    assert few == all_ and len(all_) > 100


def test_triples_are_ranges(spark, tmp_path):
    """Across hours, with equal times, events of no length or less, ids and users that are missing; no pair of events is joined."""
    from tessera.plans.temporal import events_of

    folder = tables(spark, tmp_path, some(120, 42, 300, 20) + [(500 + i, 3_500 + t / 2, u, k, v) for i, t, u, k, v in some(80, 43, 400, 9)] + ODD)
    same_as_sql(spark, folder, "j17_between_triples")
    assert "Join" not in catalogue.QUERIES["j17_between_triples"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    few, all_ = (Counter(map(tuple, sweeps.between_triples(events_of(spark, folder), 120_000, n).collect())) for n in (1, 10**6))
    assert few == all_ and len(all_) > 1_000


@pytest.mark.parametrize("days", [1, 9])
def test_chains_deal_events_once(spark, days, tmp_path):
    """Rows are copied only if there are fewer slots than cores, and dealt by id only if ids have several rows."""
    rows = [(1_000 * d + i, t + 86_400 * d, u, k, v) for d in range(days) for i, t, u, k, v in some(24, d, 120, 16)]
    folder = tables(spark, tmp_path, [(None, *r[1:]) if r[0] % 7 == 0 else r for r in rows])
    same_as_sql(spark, folder, "g04_ordering_groups")
    plan = catalogue.QUERIES["g04_ordering_groups"](spark, folder)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Generate explode") == (days == 1) and plan.toString().count("Window") == 0

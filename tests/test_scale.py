"""Plans and portions of queries that failed on larger tables."""

import os

import pytest
from pyspark.sql import functions as F

from fieldtrace.plans import catalog, measures, paths, play  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.mark.parametrize("name", ["variant_consensus", "weighted_consensus"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """Fifteen rows an event, whose size Spark estimates as that of the event: the driver ran out of memory."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_exploded_rows_are_not_broadcast_at_run_time(spark):
    """Spark plans anew when it has measured what was shuffled, and then broadcasts what lies below its threshold; here all does."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        df = catalog.QUERIES["weighted_consensus"](spark, DATA)
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_candidates_are_not_broadcast(spark):
    plan = catalog.QUERIES["short_bridges"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_gaps_of_a_clip_are_one_group(spark):
    """A group a gap cost more than its paths."""
    for name in ("short_bridges", "beam_consensus"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas [clip_id" in plan and not any("gap_no" in x.split("],")[0] for x in plan.splitlines() if "FlatMapGroupsInPandas" in x)


def test_labels_of_a_clip_are_one_loop(spark):
    """The fold in the JVM evaluated its nested conditions anew for each use."""
    plan = catalog.QUERIES["causal_labels"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_association_does_not_depend_on_order_of_arrival(spark):
    """Boxes of one point_no stood in the order in which they came; and each task gets its share of clips, whatever their bytes."""
    from fieldtrace.operators import points

    rows = [(1, f, f / 25.0, 7, float(x), 0.0, x + 10.0, 40.0) for f in range(6) for x in (0, 12, 24)]
    schema = "clip_id long, source_frame long, clip_seconds double, point_no long, x1 double, y1 double, x2 double, y2 double"
    got = [sorted(map(tuple, points.associated(spark.createDataFrame(r, schema), ["clip_id"], 0.4, 300.0).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 18
    assert "RepartitionByExpression" in planned(catalog.QUERIES["player_tracks"](spark, DATA))


def test_kits_are_found_once(spark):
    """Two steps read the sides, and each ran numpy over all clips, in one task."""
    from fieldtrace.operators import initial

    assert "FlatMapGroupsInPandas" not in planned(initial.kits(paths.opening_tracks(spark, DATA), ["clip_id"]))


def test_seeds_that_split_alike_count_once():
    """The best of all pairs, as by trying each."""
    import numpy as np

    from fieldtrace.operators import initial

    colors = np.array([[50.0, 60, 60], [52, 61, 60], [49, 58, 63], [50, -40, 30], [51, -42, 30], [48, -41, 33], [90, 0, 0]])
    assert initial.best_split(colors, np.ones(7)).tolist() == [0, 0, 0, 1, 1, 1, -1]
    calls = []
    average = np.average
    np.average = lambda *a, **k: calls.append(1) or average(*a, **k)
    try:
        initial.best_split(colors, np.ones(7))
    finally:
        np.average = average
    assert len(calls) < 12  # 14 pairs of seeds and more, three ways to split


def test_stretches_of_a_clip_are_one_group(spark):
    from fieldtrace.operators import reports

    rows = spark.createDataFrame([(1, 1, 1.0, "pass", "red"), (1, 2, 9.0, "pass", "red"), (1, 3, 10.5, None, "red")], "clip_id long, event_no long, seconds double, event_type string, team string")
    found = reports.aligned(rows, rows.withColumn("seconds", F.col("seconds") + 0.25), ["clip_id"], 0.5)
    assert "stretch" not in planned(found) and "RepartitionByExpression" in planned(found)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 0.25), (1, 2, 2, 0.25)]


def test_folds_of_a_clip_are_dealt_evenly(spark):
    """Spark joined partitions of few bytes to one task, whose sorts and lists then took gigabytes."""
    for name in ("control_spells", "aerial_crossings", "shot_events"):
        assert "RepartitionByExpression [clip_id" in planned(catalog.QUERIES[name](spark, DATA))


def test_frames_and_pairs_are_counted_in_one_place(spark):
    assert "RepartitionByExpression [clip_id" in planned(catalog.QUERIES["covisible_tracks"](spark, DATA))


def test_handoffs_read_their_inputs_once(spark):
    assert "lineitem" not in planned(catalog.QUERIES["handoff_free_passes"](spark, DATA)) and "Relation" not in planned(catalog.QUERIES["handoff_free_passes"](spark, DATA))


def test_turns_are_listed_once(spark):
    assert planned(measures.saved_states(spark, DATA)).count("collect_list(") == 1


def test_restarts_read_stoppages_once(spark):
    """The ball's path: once for the stoppages, once for its steps."""
    assert planned(play.restarts(spark, DATA)).count("Relation") == 2


def test_events_of_a_chain_are_stored_before_its_rules(spark):
    from fieldtrace.operators import chain

    seen = []
    rule = chain.Rule("look", lambda e, t: seen.append(planned(e)) or e)
    chain.run(spark.range(3).withColumn("k", F.col("id") + 1), [[rule]], chain.Inputs({}))
    assert "Project" not in seen[0]


def test_what_a_fold_looks_up_is_worked_out_once(spark):
    """Within a lambda every mention is worked out anew."""
    from fieldtrace.operators import control, rules

    events = play.control_transfers(spark, DATA)
    for df in (control.deduplicated(events, ["clip_id"]), rules.one_reception(events, ["clip_id"])):
        assert planned(df).count("array_position(") == 1


def test_candidates_find_their_gaps_in_one_shuffle(spark):
    """They were dealt by clip and bucket of frames, joined, and dealt again by clip."""
    plan = planned(catalog.QUERIES["beam_consensus"](spark, DATA))
    assert "Join" not in plan and "MapInPandas" in plan


def test_gaps_take_their_steps_together(monkeypatch):
    """Each gap went frame by frame by itself, so that the calls of numpy grew with the gaps and took most of the time."""
    import numpy as np
    import pandas as pd

    from fieldtrace.operators import trajectory

    one = pd.DataFrame([(f, 300 + 9.0 * f + 20 * k, 300.0, 0.9 - k / 4, 4.0, 5.0, 0.0, 61.0, 6.0, 300.0, 300.0, 225.0, 0.0) for f in range(1, 61) for k in range(2)], columns=["source_frame", "x", "y", "visual_score", "width", "height", *trajectory.LEAD])
    hypot, counts, found = np.hypot, [], []
    for n in (1, 40):
        calls = []
        monkeypatch.setattr(np, "hypot", lambda *a, calls=calls, **k: calls.append(1) or hypot(*a, **k))
        at, _ = trajectory.agreed(pd.concat([one] * n, ignore_index=True), np.repeat(np.arange(n), len(one)), 5, 25.0, 900.0, trajectory.Beam())
        found.append([(at[at // len(one) == g] % len(one)).tolist() for g in range(n)])
        counts.append(len(calls))
    assert counts[1] == counts[0] > 60 and len(found[0][0]) > 5 and found[1] == found[0] * 40


def test_no_gap_is_cut_by_portions(spark, monkeypatch):
    """Portions smaller than a gap, of candidates and of pairs, change nothing."""
    from fieldtrace.operators import trajectory

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = lambda: sorted(map(tuple, catalog.QUERIES["beam_consensus"](spark, DATA).collect()))
    want = rows()
    monkeypatch.setattr(trajectory, "ROWS", 100)
    monkeypatch.setattr(trajectory, "PAIRS", 200)
    spark.conf.set(key, "7")
    try:
        assert rows() == want and len(want) > 200
    finally:
        spark.conf.set(key, before)

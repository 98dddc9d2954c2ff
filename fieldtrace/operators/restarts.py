"""Restarts from a ball that lies still (J7), and team identity along chains of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import control, joins

#: Longest step, how near in time a ball must be to a player's step, seconds around a release, least steps of players, confidences.
STEP, NEAR, AROUND, LEAST, SURE, RELEASED = 0.3, 0.11, 0.4, 8, 0.75, 0.85
TINY = 1e-9


def ball_steps(balls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, step_no, start_seconds, end_seconds, speed) between seen points of at most 0.3 s; of points of one time the surest counts."""
    best = balls.groupBy(*keys, "clip_seconds").agg(F.max_by(F.struct("x", "y"), "confidence").alias("p")).select(*keys, "clip_seconds", "p.x", "p.y")
    w = Window.partitionBy(*keys).orderBy("clip_seconds")
    t = F.lag("clip_seconds").over(w)
    rows = best.select(*keys, t.alias("start_seconds"), F.col("clip_seconds").alias("end_seconds"), (g.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)) / (F.col("clip_seconds") - t)).alias("speed"))
    rows = rows.where((F.col("end_seconds") > F.col("start_seconds")) & (F.col("end_seconds") - F.col("start_seconds") <= STEP))
    return rows.withColumn("step_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start_seconds")))


def still_runs(steps: DataFrame, keys: Sequence[str], slow: float, seconds: float) -> DataFrame:
    """(keys, still_start, still_end) of runs of steps at most `slow`, one following the other, that last long enough."""
    w = Window.partitionBy(*keys).orderBy("start_seconds")
    still = F.col("speed") <= slow
    follows = still & F.coalesce(F.lag(still).over(w) & (F.abs(F.col("start_seconds") - F.lag("end_seconds").over(w)) <= 1e-6), F.lit(False))
    rows = steps.withColumn("run_", F.sum(F.when(follows, 0).otherwise(1)).over(w)).where(still)
    runs = rows.groupBy(*keys, "run_").agg(F.min("start_seconds").alias("still_start"), F.max("end_seconds").alias("still_end")).drop("run_")
    return runs.where(F.col("still_end") - F.col("still_start") >= seconds - TINY)


def player_motion(players: DataFrame, balls: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """(keys, seconds, speed in heights a second, track_id) of players' steps near the ball."""
    w = Window.partitionBy(*keys, "track_id").orderBy("clip_seconds")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    rows = players.withColumns({"cx_": middle("x1", "x2"), "cy_": middle("y1", "y2"), "tall_": F.col("y2") - F.col("y1")})
    took, tall = F.col("clip_seconds") - F.lag("clip_seconds").over(w), (F.lag("tall_").over(w) + F.col("tall_")) / 2
    rows = rows.select(*keys, "track_id", F.col("clip_seconds").alias("seconds"), "cx_", "cy_", took.alias("took_"), tall.alias("height_"), g.distance(F.col("cx_"), F.col("cy_"), F.lag("cx_").over(w), F.lag("cy_").over(w)).alias("far_"))
    rows = rows.where((F.col("took_") > 0) & (F.col("took_") <= STEP) & (F.col("height_") > 0))
    seen = balls.groupBy(*keys, "clip_seconds").agg(F.max_by(F.struct("x", "y"), "confidence").alias("p")).select(*keys, "clip_seconds", F.col("p.x").alias("bx"), F.col("p.y").alias("by"))
    before = joins.as_of(rows, seen.withColumnsRenamed({"clip_seconds": "t0", "bx": "x0", "by": "y0"}), keys, "seconds", "t0", ["x0", "y0"])
    both = joins.as_of(before, seen.withColumnsRenamed({"clip_seconds": "t1", "bx": "x1_", "by": "y1_"}), keys, "seconds", "t1", ["x1_", "y1_"], forward=True)
    earlier = F.coalesce(F.col("seconds") - F.col("t0") <= F.col("t1") - F.col("seconds"), F.col("t0").isNotNull())
    gap = F.when(earlier, F.col("seconds") - F.col("t0")).otherwise(F.col("t1") - F.col("seconds"))
    away = g.distance(F.col("cx_"), F.col("cy_"), F.when(earlier, F.col("x0")).otherwise(F.col("x1_")), F.when(earlier, F.col("y0")).otherwise(F.col("y1_"))) / F.col("height_")
    return both.where((gap <= NEAR) & (away <= radius)).select(*keys, "track_id", "seconds", (F.col("far_") / F.col("took_") / F.col("height_")).alias("speed"))


def stationary_restarts(
    balls: DataFrame, players: DataFrame, keys: Sequence[str], slow: float = 40.0, seconds: float = 0.4, delay: float = 1.5, kick: float = 350.0, sustained: float = 150.0, active: float = 0.5,
    setup_most: float = 0.3, reaction_least: float = 0.45, increase: float = 0.15, reacting: int = 6, radius: float = 8.0,
) -> DataFrame:
    """Stoppages that end with a kick of a still ball: a run of `seconds` or more with the ball at most `slow`, then within `delay` a step of `kick` or more that two of three steps sustain, while the players
    near the ball (outfield, within `radius` heights) stand until then and move around the release, at least `reacting` of them. Of runs with one release the last counts.

    balls: clip_seconds, x, y, confidence (seen ones only); players: track_id, clip_seconds, x1 .. y2 of the teams' outfield players. Runs are islands, releases and nearest balls as-of windows, and the players'
    steps are bucketed into the spans of run and release; a clip is never gathered.
    """
    if slow < 0 or min(seconds, delay, kick, sustained, active, radius) <= 0 or reacting < 1 or not all(0 <= x <= 1 for x in (setup_most, reaction_least, increase)):
        raise ValueError("speeds, times and the radius must be positive, shares from 0 to 1")
    steps = ball_steps(balls, keys)
    w = Window.partitionBy(*keys).orderBy("start_seconds")
    fast = sum(F.coalesce((F.lead("speed", k).over(w) >= sustained).cast("int"), F.lit(0)) for k in (0, 1, 2))
    releases = steps.withColumn("fast_", fast).where((F.col("speed") >= kick) & (F.col("fast_") >= 2)).select(*keys, F.col("start_seconds").alias("release"), F.col("speed").alias("release_speed"))
    runs = still_runs(steps, keys, slow, seconds).withColumn("from_", F.col("still_end") - TINY)
    runs = joins.as_of(runs, releases, keys, "from_", "release", ["release_speed"], forward=True).where(F.col("release") - F.col("still_end") <= delay + TINY)
    moves = player_motion(players, balls, keys, radius)
    run = [*keys, "still_start", "still_end", "release", "release_speed"]
    spans = runs.select(*run, F.explode(F.array(F.struct(F.lit("setup").alias("part"), F.col("still_start").alias("lo"), F.col("still_end").alias("hi")), F.struct(F.lit("reaction").alias("part"), (F.col("release") - AROUND).alias("lo"), (F.col("release") + AROUND).alias("hi")))).alias("s"))
    spans = spans.select(*run, "s.part", "s.lo", "s.hi").withColumn("until_", F.col("hi") + TINY)
    near = joins.in_interval(moves, spans, keys, "seconds", "lo", "until_", 2.0).where(F.col("seconds") <= F.col("hi"))
    moving = F.col("speed") >= active
    part = lambda p: F.col("part") == p
    per = near.groupBy(*run).agg(
        *[F.count_if(part(p)).alias(f"n_{p}") for p in ("setup", "reaction")], *[F.count_if(part(p) & moving).alias(f"m_{p}") for p in ("setup", "reaction")],
        F.count_distinct(F.when(part("reaction") & moving, F.col("track_id"))).alias("reacting_players"),
    )
    per = per.withColumns({"setup_ratio": F.col("m_setup") / F.nullif("n_setup", F.lit(0)), "reaction_ratio": F.col("m_reaction") / F.nullif("n_reaction", F.lit(0))})
    good = (F.col("n_setup") >= LEAST) & (F.col("n_reaction") >= LEAST) & (F.col("setup_ratio") <= setup_most) & (F.col("reaction_ratio") >= reaction_least) & (F.col("reaction_ratio") - F.col("setup_ratio") >= increase) & (F.col("reacting_players") >= reacting)
    last = Window.partitionBy(*keys, "release").orderBy(F.desc("still_start"))
    kept = per.where(good).withColumn("k_", F.row_number().over(last)).where("k_ = 1")
    r = lambda c, n=3: F.round(F.col(c), n)
    return kept.select(
        *keys, r("still_start").alias("start_seconds"), r("release").alias("end_seconds"), F.round(F.col("release") - F.col("still_start"), 3).alias("duration_seconds"), r("still_start").alias("resumed_seconds"), r("release").alias("play_resumed_seconds"),
        F.lit(False).alias("starts_outside"), F.lit("stationary_ball_restart").alias("stoppage_kind"), F.lit("free_kick").alias("restart_type"), F.lit(SURE).alias("confidence"), F.lit(RELEASED).alias("release_confidence"),
        r("still_end").alias("stationary_end_seconds"), r("setup_ratio", 4).alias("setup_active_ratio"), r("reaction_ratio", 4).alias("reaction_active_ratio"), "reacting_players", r("release_speed", 2).alias("release_speed"),
    )


def through_setup(
    intervals: DataFrame, spells: DataFrame, balls: DataFrame, keys: Sequence[str], delay: float = 2.0, control: float = 1.0, slow: float = 100.0, settled: float = 0.4, kick: float = 200.0, search: float = 2.0,
) -> DataFrame:
    """Stoppages whose release only moved the ball to where it is set up: after a still-ball restart's release a player controls it for `control` seconds or more, starting within `delay`. Play then resumes with the last kick (a step of
    `kick` that two of three steps sustain) of a ball that had settled for `settled` seconds, up to `search` seconds after that control, or with its end. Adds discarded_release_seconds, setup_start_seconds and setup_end_seconds, null where
    nothing changed. spells: start_seconds, end_seconds.

    Settled runs are islands among the steps of one stoppage's search, so stoppages are partitions of a window.
    """
    rows = intervals.withColumn("no_", F.struct(*keys, "start_seconds", "play_resumed_seconds")).withColumn("from_", F.when(F.col("stoppage_kind") == "stationary_ball_restart", F.col("play_resumed_seconds")))
    long = spells.where(F.col("end_seconds") - F.col("start_seconds") >= control).select(*keys, F.col("start_seconds").alias("setup_start"), F.col("end_seconds").alias("setup_end"))
    asked = rows.where("from_ IS NOT NULL").select(*keys, "no_", "from_").join(long, list(keys)).where((F.col("setup_start") > F.col("from_")) & (F.col("setup_start") <= F.col("from_") + delay))
    first = asked.groupBy(*keys, "no_").agg(F.min(F.struct("setup_start", "setup_end")).alias("s")).select(*keys, "no_", "s.*")

    steps = ball_steps(balls, keys)
    w = Window.partitionBy(*keys).orderBy("start_seconds")
    sustained = sum(F.coalesce((F.lead("speed", k).over(w) >= slow).cast("int"), F.lit(0)) for k in (0, 1, 2)) >= 2
    steps = steps.withColumn("kick_", (F.col("speed") >= kick) & sustained).withColumnsRenamed({"start_seconds": "at_", "end_seconds": "to_"})
    spans = first.withColumns({"lo_": F.col("setup_start") - TINY, "hi_": F.col("setup_end") + search + TINY}).withColumn("until_", F.col("hi_") + STEP + 1)
    near = joins.in_interval(steps, spans, keys, "to_", "lo_", "until_", 4.0).where(F.col("at_") <= F.col("hi_"))
    own = Window.partitionBy(*keys, "no_").orderBy("at_")
    still = F.col("speed") <= slow
    apart = F.coalesce(F.col("at_") - F.lag("to_").over(own) > STEP, F.lit(True))
    near = near.withColumns({"still_": still, "new_": F.when(still & F.coalesce(F.lag(still).over(own), F.lit(False)) & ~apart, 0).otherwise(1)}).withColumn("run_", F.sum("new_").over(own)).withColumn("apart_", apart)
    near = near.withColumn("since_", F.min("at_").over(Window.partitionBy(*keys, "no_", "run_")))
    was = F.coalesce(F.lag("still_").over(own), F.lit(False)) & ~F.col("apart_") & (F.lag("to_").over(own) - F.lag("since_").over(own) >= settled - TINY)
    last = near.withColumn("ok_", F.col("kick_") & ~F.col("still_") & was).groupBy("no_").agg(F.max(F.when(F.col("ok_"), F.col("at_"))).alias("again_"))
    found = first.join(last, "no_", "left").select("no_", "setup_start", "setup_end", F.round(F.coalesce("again_", "setup_end"), 3).alias("resumed_"))
    rows = rows.join(found, "no_", "left")
    new = {
        "play_resumed_seconds": F.coalesce("resumed_", "play_resumed_seconds"), "end_seconds": F.coalesce("resumed_", "end_seconds"), "duration_seconds": F.coalesce(F.round(F.col("resumed_") - F.col("start_seconds"), 3), F.col("duration_seconds")),
        "release_confidence": F.when(F.col("resumed_").isNotNull(), F.least(F.coalesce("release_confidence", F.lit(RELEASED)), F.lit(0.75))).otherwise(F.col("release_confidence")),
    }
    told = [F.round(F.when(F.col("resumed_").isNotNull(), F.col("from_")), 3).alias("discarded_release_seconds"), F.round("setup_start", 3).alias("setup_start_seconds"), F.round("setup_end", 3).alias("setup_end_seconds")]
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in intervals.columns], *told)


def receiver_teams(events: DataFrame, labels: DataFrame, keys: Sequence[str], seconds: float, least: int, share: float = 0.6) -> DataFrame:
    """events with local_team: what most labels (track_id, clip_seconds, label; null for those of no team) of the receiver's track say within `seconds` of the completion, at least `least` of them and `share` of all; else null."""
    rows = events.withColumn("event_", F.struct(*events.columns)).where("to_track IS NOT NULL AND completion_seconds IS NOT NULL")
    seen = labels.where("label IS NOT NULL").select(*keys, F.col("track_id").alias("to_track"), F.col("clip_seconds").alias("at_"), "label")
    near = joins.within_band(rows.select(*keys, "to_track", "completion_seconds", "event_").distinct(), seen, [*keys, "to_track"], "completion_seconds", "at_", seconds)
    counts = near.groupBy("event_", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("event_").agg(F.max_by("label", "n").alias("label"), F.max("n").alias("most"), F.sum("n").alias("all"))
    best = best.where((F.col("all") >= least) & (F.col("most") / F.col("all") >= share)).select("event_", F.col("label").alias("local_team"))
    return events.withColumn("event_", F.struct(*events.columns)).join(best, "event_", "left").drop("event_")


def identity_switches(events: DataFrame, labels: DataFrame, keys: Sequence[str], teams: tuple[str, str], chain: float, seconds: float = 0.8, least: int = 3) -> DataFrame:
    """Events whose teams follow the shirts: a turnover to a receiver in the sender's shirt is a pass, and events that a corrected one leads to (its receiver sends within `chain` seconds) take over its team and are
    passes or turnovers by their receiver's shirt. `corrected` tells the first (identity) from those that follow (continuity); null where nothing changed.

    events: event_no, event_type, clip_seconds, team, from_track, to_track, completion_seconds. What a later event takes over depends on all corrections before it, so a clip's events are one fold in the JVM, whose state is the
    corrected ones.
    """
    if chain < 0 or seconds <= 0 or least <= 0:
        raise ValueError("chain must not be negative, seconds and least must be positive")
    rows = receiver_teams(events, labels, keys, seconds, least)
    parts = F.struct("clip_seconds", "event_no", "event_type", "team", "from_track", "to_track", "completion_seconds", "local_team")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(parts)).alias("all_"))
    anchor, made = "array<struct<team:string,pass:boolean,track:bigint,at:double>>", "array<struct<event_no:bigint,event_type:string,team:string,corrected:string>>"
    other = lambda t: F.when(t == teams[0], teams[1]).when(t == teams[1], teams[0])

    def step(acc: Column, e: Column) -> Column:
        leads = F.filter(acc["anchors"], lambda a: (a["track"] == e["from_track"]) & (e["clip_seconds"] - a["at"]).between(0, chain))
        return control.looked_up(F.try_element_at(leads, F.lit(-1)), lambda lead: after(acc, e, lead))

    def after(acc: Column, e: Column, lead: Column) -> Column:
        sender = F.when(lead.isNotNull(), F.when(lead["pass"], lead["team"]).otherwise(other(lead["team"]))).otherwise(e["team"])
        same = e["local_team"] == sender
        usable = e["local_team"].isNotNull() & sender.isin(*teams)
        changes = usable & (lead.isNotNull() | ((e["event_type"] == "turnover_candidate") & same))

        def out(kind: Column, team: Column, why: Column) -> Column:
            return F.concat(acc["out"], F.array(F.struct(e["event_no"].alias("event_no"), kind.alias("event_type"), team.alias("team"), why.alias("corrected"))))

        kind = F.when(same, "pass_candidate").otherwise("turnover_candidate")
        mine = F.struct(sender.alias("team"), same.alias("pass"), e["to_track"].alias("track"), e["completion_seconds"].alias("at"))
        kept = F.struct(acc["anchors"].alias("anchors"), out(e["event_type"], e["team"], F.lit(None).cast("string")).alias("out"))
        new = F.struct(F.concat(acc["anchors"], F.array(mine)).cast(anchor).alias("anchors"), out(kind, sender, F.when(lead.isNotNull(), "continuity").otherwise("identity")).alias("out"))
        return F.when(F.coalesce(changes, F.lit(False)), new).otherwise(kept).cast(f"struct<anchors:{anchor},out:{made}>")

    start = F.struct(F.array().cast(anchor).alias("anchors"), F.array().cast(made).alias("out"))
    found = listed.select(*keys, F.explode(F.aggregate("all_", start, step, lambda acc: acc["out"])).alias("e")).select(*keys, "e.*")
    return events.drop("event_type", "team").join(found, [*keys, "event_no"]).select(*events.columns, "corrected")


def controlled_turnovers(events: DataFrame, players: DataFrame, balls: DataFrame, keys: Sequence[str], heights: float = 0.25, continuity: float = 2.0) -> DataFrame:
    """Events without turnovers at whose completion only the sender's own team is within so many heights of the ball; the next pass of another team, within `continuity` seconds of such a one, is the retained team's (`retained` tells it).

    events: event_no, event_type, clip_seconds, team, to_track, completion_seconds. The ball's frame is the first within 0.04 s of the completion. Which pass is next depends on what was dropped before, so a clip's events are one fold in the JVM,
    whose state is a team and a time.
    """
    near = players.select(*keys, "source_frame", "team", "x1", "y1", "x2", "y2").join(balls.select(*keys, "source_frame", F.col("x").alias("bx_"), F.col("y").alias("by_")), [*keys, "source_frame"])
    near = near.where(g.box_distance(F.col("bx_"), F.col("by_"), g.box()) <= heights).groupBy(*keys, "source_frame").agg(F.array_sort(F.collect_set("team")).alias("near_"))
    seen = balls.select(*keys, "source_frame", F.col("clip_seconds").alias("ball_at_")).join(near, [*keys, "source_frame"], "left").withColumn("near_", F.coalesce("near_", F.array().cast("array<string>")))
    asked = events.withColumn("from_", F.col("completion_seconds") - 0.04)
    rows = joins.as_of(asked, seen, keys, "from_", "ball_at_", ["near_"], forward=True, within=0.08)
    parts = F.struct("clip_seconds", "event_no", "event_type", "team", "to_track", "completion_seconds", "near_")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(parts)).alias("all_"))
    kind = "array<struct<event_no:bigint,team:string,retained:boolean>>"

    def step(acc: Column, e: Column) -> Column:
        again = F.coalesce(acc["team"].isNotNull() & (e["event_type"] == "pass_candidate") & ~e["team"].eqNullSafe(acc["team"]) & (e["clip_seconds"] - acc["at"] <= continuity), F.lit(False))
        team = F.when(again, acc["team"]).otherwise(e["team"])
        gone = F.coalesce((e["event_type"] == "turnover_candidate") & e["to_track"].isNotNull() & e["completion_seconds"].isNotNull() & (e["near_"] == F.array(e["team"])), F.lit(False))
        out = F.concat(acc["out"], F.array(F.struct(e["event_no"].alias("event_no"), team.alias("team"), again.alias("retained")))).cast(kind)
        kept = F.struct(F.when(~again, acc["team"]).alias("team"), F.when(~again, acc["at"]).alias("at"), out.alias("out"))
        dropped = F.struct(e["team"].alias("team"), e["completion_seconds"].alias("at"), acc["out"].alias("out"))
        return F.when(gone, dropped).otherwise(kept)

    start = F.struct(F.lit(None).cast("string").alias("team"), F.lit(None).cast("double").alias("at"), F.array().cast(kind).alias("out"))
    found = listed.select(*keys, F.explode(F.aggregate("all_", start, step, lambda acc: acc["out"])).alias("e")).select(*keys, "e.*")
    return events.drop("team").join(found, [*keys, "event_no"]).select(*events.columns, "retained")

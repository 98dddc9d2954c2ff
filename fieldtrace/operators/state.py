"""Stoppages, restarts and the match state that follows from them (2J), and the events that need it (2K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators import control, joins

#: The law that each kind of restart falls under.
LAWS = {
    "unknown": "law_8_start_and_restart",
    "dropped_ball": "law_8_start_and_restart",
    "throw_in": "law_15_throw_in",
    "corner_kick": "law_17_corner_kick",
    "goal_kick": "law_16_goal_kick",
    "free_kick": "law_13_free_kicks",
    "direct_free_kick": "law_13_free_kicks",
    "indirect_free_kick": "law_13_free_kicks",
    "penalty_kick": "law_8_start_and_restart",
    "kick_off": "law_8_start_and_restart",
}
ADVANTAGE, RESTART, BALL = "laws_5_and_12_referee_and_advantage", "law_8_start_and_restart", "law_9_ball_in_and_out"


def law_of(restart: Column) -> Column:
    """Null for a kind of restart that the laws don't know."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LAWS.items() for x in pair]), restart)


def restart_releases(intervals: DataFrame, steps: DataFrame, keys: Sequence[str], speed: float) -> DataFrame:
    """Intervals with play_resumed_seconds: the start of the first step (clip_seconds, next_seconds, speed) of at least `speed` from the time that the ball is
    back on, if it ends before the next interval starts."""
    if speed <= 0:
        raise ValueError("speed is positive")
    w = Window.partitionBy(*keys).orderBy("start_seconds")
    rows = intervals.withColumn("search_end_", F.lead("start_seconds").over(w))
    fast = steps.where(F.col("speed") >= speed).select(*keys, F.col("clip_seconds").alias("release_"), F.col("next_seconds").alias("ends_"))
    back = joins.as_of(rows, fast, keys, "resumed_seconds", "release_", ["ends_"], forward=True)
    known = F.col("resumed_seconds").isNotNull() & (F.col("search_end_").isNull() | (F.col("ends_") <= F.col("search_end_")))
    return back.withColumn("play_resumed_seconds", F.when(known, F.round("release_", 3))).drop("release_", "ends_", "search_end_")


def without_aerial_crossings(intervals: DataFrame, spell_rows: DataFrame, keys: Sequence[str], before: float = 1.0, after: float = 1.2, span: float = 4.0) -> DataFrame:
    """Intervals with `reason`, "continuous_possession" where the team that had the ball at most `before` seconds before controls it again at most `after` seconds
    after it is back, and at most `span` seconds after it went; else null."""
    own = control.flat(spell_rows, keys)
    prior = joins.as_of(intervals, own.select(*keys, F.col("end_seconds").alias("prior_end"), F.col("team").alias("prior_team")), keys, "start_seconds", "prior_end", ["prior_team"], within=before)
    back = prior.where("resumed_seconds IS NOT NULL")
    both = joins.as_of(back, own.select(*keys, F.col("start_seconds").alias("next_start"), F.col("team").alias("next_team")), keys, "resumed_seconds", "next_start", ["next_team"], forward=True, within=after)
    both = both.unionByName(prior.where("resumed_seconds IS NULL"), allowMissingColumns=True)
    crossing = (F.col("prior_team") == F.col("next_team")) & (F.col("next_start") - F.col("start_seconds") <= span)
    return both.withColumn("reason", F.when(crossing, "continuous_possession")).select(*intervals.columns, "reason")


def boundary_turnovers(intervals: DataFrame, spell_rows: DataFrame, prior: DataFrame, keys: Sequence[str], lookback: float = 2.0, apart: float = 3.0, startup: float | None = None) -> DataFrame:
    """The team whose spell ended last, within `lookback` seconds (2 at most where the stoppage lasts less than 3 s), loses the ball when it goes out, unless a player of
    its own takes the restart within 8 s after the ball was held near the upper body (or the interval starts by `startup`), or the team lost it within `apart` seconds
    already (prior events or one found here before). Intervals that open outside or are stationary-ball restarts have none."""
    rows = intervals.where("NOT starts_outside AND coalesce(stoppage_kind, '') <> 'stationary_ball_restart'").withColumn("duration_", F.coalesce(F.col("end_seconds") - F.col("start_seconds"), F.lit(0.0)))
    one = spell_rows.select(*keys, F.col("spell.end_seconds").alias("owner_end"), F.struct("spell_no", "spell").alias("owner"))
    rows = joins.as_of(rows, one, keys, "start_seconds", "owner_end", ["owner"], within=max(lookback, 2.0))
    rows = rows.where(F.col("start_seconds") - F.col("owner_end") <= F.when(F.col("duration_") >= 3, lookback).otherwise(min(lookback, 2.0)))
    rows = rows.withColumn("spell", F.col("owner.spell")).withColumn("back_", F.coalesce("play_resumed_seconds", "resumed_seconds"))
    kept_hands = F.col("spell.held") >= 2
    if startup is not None:
        kept_hands = kept_hands | (F.col("start_seconds") <= startup)
    takers = spell_rows.select(*keys, (F.col("spell.start_seconds") - 8).alias("open_"), (F.col("spell.start_seconds") + 1e-9).alias("stop_"), F.col("spell.start_seconds").alias("taken_"), F.col("spell.team").alias("taker_"), F.col("spell.track_id").alias("taker_track"))
    taken = joins.in_interval(rows.where(kept_hands & F.col("back_").isNotNull()), takers, keys, "back_", "open_", "stop_", 8.0).where(F.col("taker_track") != F.col("spell.track_id"))
    own = taken.groupBy(*keys, "start_seconds").agg(F.min_by("taker_", "taken_").alias("taker_"), F.first("spell.team").alias("team_")).where("taker_ = team_").select(*keys, "start_seconds")
    rows = rows.join(own, [*keys, "start_seconds"], "left_anti")
    before = prior.where("event_type = 'turnover_candidate'").select(*keys, F.col("clip_seconds").alias("lost_"), F.col("team").alias("loser_"))
    vetoed = joins.within_band(rows, before, keys, "start_seconds", "lost_", apart).where(F.col("loser_") == F.col("spell.team")).select(*keys, "start_seconds").distinct()
    rows = rows.join(vetoed, [*keys, "start_seconds"], "left_anti")
    kind = "array<struct<start_seconds:double,team:string,track:bigint,duration:double>>"
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_seconds", F.col("spell.team").alias("team"), F.col("spell.track_id").alias("track"), F.col("duration_").alias("duration")))).cast(kind).alias("all_"))

    def step(acc: Column, e: Column) -> Column:
        again = F.exists(acc, lambda p: (p["team"] == e["team"]) & (e["start_seconds"] - p["start_seconds"] <= apart))
        return F.when(again, acc).otherwise(F.concat(acc, F.array(e)))

    out = listed.select(*keys, F.explode(F.aggregate("all_", F.array().cast(kind), step)).alias("e"))
    e = F.col("e")
    return out.select(*keys, F.lit("turnover_candidate").alias("event_type"), F.round(e["start_seconds"], 3).alias("clip_seconds"), e["team"].alias("team"), e["track"].alias("from_track"), F.lit(None).cast("bigint").alias("to_track"), F.round(F.least(F.lit(0.8), 0.5 + e["duration"] / 20), 4).alias("confidence"), F.round(e["start_seconds"], 3).alias("completion_seconds"))


def outside_flags(events: DataFrame, intervals: DataFrame, observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events with released_outside (a pass sent from an interval's start to its resumption, unless the sender controlled the ball between its re-entry and then) and
    completed_outside. Intervals that open outside don't count; the first that holds the time decides."""
    live = intervals.where("NOT starts_outside").withColumn("until_", F.coalesce("play_resumed_seconds", "resumed_seconds", F.lit(1e9)))
    span = live.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_seconds", "until_", "resumed_seconds"))).alias("spans_"))
    holds = lambda at: lambda s: (s["start_seconds"] <= at) & (at <= s["until_"])
    rows = events.join(span, list(keys), "left").withColumn("spans_", F.coalesce("spans_", F.array().cast("array<struct<start_seconds:double,until_:double,resumed_seconds:double>>")))
    rows = rows.withColumn("hit_", F.try_element_at(F.filter("spans_", holds(F.col("clip_seconds"))), F.lit(1))).withColumn("completed_outside", F.coalesce(F.exists("spans_", holds(F.col("completion_seconds"))), F.lit(False)))
    seen = observations.select(*keys, F.col("track_id").alias("from_track"), F.col("clip_seconds").alias("seen_"))
    rows = last_seen(rows, seen, keys)
    controlled = F.coalesce(F.col("seen_") >= F.col("hit_.resumed_seconds"), F.lit(False))
    out = (F.col("event_type") == "pass_candidate") & F.col("hit_").isNotNull() & ~controlled
    return rows.withColumn("released_outside", out).select(*events.columns, "released_outside", "completed_outside")


def last_seen(events: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """events with seen_, the last time before them that their sender's track is in `seen`: one union and one window."""
    by = [*keys, "from_track"]
    rows = events.withColumn("at_", F.col("clip_seconds")).withColumn("order_", F.lit(0)).unionByName(seen.withColumn("at_", F.col("seen_")).withColumn("order_", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("at_", "order_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before_", F.last(F.when(F.col("order_") == 1, F.col("at_")), ignorenulls=True).over(w)).where("order_ = 0")
    return rows.withColumn("seen_", F.col("before_")).drop("at_", "order_", "before_")


STATE = "struct<seconds:double,state:string,trigger:string,confidence:double,restart_type:string,law_reference:string>"


def proposals(clip_seconds: Column) -> Column:
    """The changes of state that an interval proposes, in order: offences, goals and other stoppages by the referee, ends of a period, stationary balls, clips
    that open outside, and balls that leave the pitch."""
    c, start, release, resumed, kind = F.col, F.col("start_seconds"), F.col("play_resumed_seconds"), F.col("resumed_seconds"), F.col("law_event")
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")

    def to(at: Column, state: str, trigger, confidence, law, restart=None, only: Column | None = None) -> Column:
        at = F.round(F.least(F.greatest(at, F.lit(0.0)), clip_seconds), 3)
        one = F.struct(at.alias("seconds"), F.lit(state).alias("state"), text(trigger).alias("trigger"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), text(restart).alias("restart_type"), text(law).alias("law_reference")).cast(STATE)
        return F.when(F.lit(True) if only is None else only, one)

    sure = lambda name, default: F.coalesce(c(name), F.lit(default))
    released = lambda trigger, confidence, restart, law: to(release, "in_play", trigger, confidence, law, restart, release.isNotNull())
    offence = F.coalesce(c("restart_type"), F.lit("free_kick"))
    stopped, open_ = c("advantage_applied") == F.lit(False), c("advantage_applied").isNull()
    went_on = open_ & c("continued_seconds").isNotNull()
    after_offence = F.when(~went_on, released("legal_restart_release_detected", sure("release_confidence", 0.85), offence, law_of(offence)))
    of_offence = F.array(
        to(start, "restart_pending", "offence_stopped_play", sure("confidence", 0.75), ADVANTAGE, offence, stopped),
        to(start, "possible_stoppage", "possible_offence_awaiting_play_outcome", sure("confidence", 0.5), ADVANTAGE, offence, open_),
        to(c("continued_seconds"), "in_play", "advantage_or_no_stoppage_confirmed", sure("continuation_confidence", 0.7), ADVANTAGE, None, went_on),
        to(c("confirmed_seconds"), "restart_pending", "stoppage_confirmed", sure("confirmation_confidence", 0.75), ADVANTAGE, offence, open_ & ~went_on & c("confirmed_seconds").isNotNull()),
        F.when(c("advantage_applied").isNull() | ~c("advantage_applied"), after_offence),
    )
    goal = kind == "goal"
    other = F.when(goal, "kick_off").otherwise(F.coalesce(c("restart_type"), F.lit("dropped_ball")))
    of_stop = F.array(
        to(start, "restart_pending", F.when(goal, "goal_requires_kick_off").otherwise("referee_stoppage_requires_restart"), sure("confidence", 0.75), RESTART, other),
        released("legal_restart_release_detected", sure("release_confidence", 0.85), other, law_of(other)),
    )
    of_end = F.array(to(start, "period_ended", "period_ended", sure("confidence", 0.9), RESTART))
    still = F.coalesce(c("restart_type"), F.lit("unknown"))
    of_still = F.array(
        to(start, "restart_pending", "stationary_ball_and_player_disengagement", sure("confidence", 0.75), law_of(still), still),
        released("restart_kick_and_player_reaction", sure("release_confidence", 0.85), still, law_of(still)),
    )
    of_opening = F.array(to(start, "unknown", "ball_tracking_opened_outside_boundary", 0.5, BALL, None, start > 1e-9), released("restart_release_detected", 0.7, "unknown", RESTART))
    of_exit = F.array(
        to(start, "out_of_play", "sustained_boundary_exit", 0.75, BALL),
        to(resumed, "restart_pending", "ball_reentered_before_restart_release", 0.7, RESTART, "unknown", resumed.isNotNull() & (release.isNull() | (release > resumed + 1e-9))),
        released("restart_release_detected", 0.8, "unknown", RESTART),
    )
    made = (
        F.when(kind == "offence", of_offence).when(kind.isin("goal", "other_referee_stoppage"), of_stop).when(kind == "period_end", of_end)
        .when(c("stoppage_kind") == "stationary_ball_restart", of_still).when(c("starts_outside"), of_opening).otherwise(of_exit)
    )
    return F.filter(made, lambda p: p.isNotNull())


def transitions(intervals: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes of state of clips (duration_seconds), in order of time and then of proposal.

    intervals: start_seconds, resumed_seconds, play_resumed_seconds, starts_outside, stoppage_kind, law_event, restart_type, advantage_applied, continued_seconds, confirmed_seconds and confidences
    (null where unknown). After any proposal the state is the proposed one, so a proposal changes nothing exactly if the one before it proposed the same.
    """
    first = intervals.groupBy(*keys).agg(F.min_by(F.struct("start_seconds", "starts_outside"), "start_seconds").alias("f"))
    clips = clips.join(first, list(keys), "left")
    initial = F.when(F.col("f.starts_outside") & (F.col("f.start_seconds") <= 1e-9), "unknown").otherwise("in_play")
    clips = clips.select(*keys, F.col("duration_seconds"), initial.alias("initial_state"))
    rows = intervals.join(clips, list(keys)).where(F.col("start_seconds") <= F.col("duration_seconds"))
    made = rows.select(*keys, "initial_state", "duration_seconds", F.round("start_seconds", 3).alias("boundary_start_seconds"), "start_seconds", F.posexplode(proposals(F.col("duration_seconds"))).alias("pos", "p"))
    order = Window.partitionBy(*keys).orderBy("start_seconds", "pos")
    made = made.withColumn("proposal_no", F.row_number().over(order)).withColumn("was_", F.coalesce(F.lag("p.state").over(order), F.col("initial_state")))
    kept = made.where(F.col("p.state") != F.col("was_"))
    time = Window.partitionBy(*keys).orderBy("p.seconds", "proposal_no")
    return kept.select(*keys, "duration_seconds", "initial_state", F.row_number().over(time).cast("long").alias("transition_no"), F.col("p.seconds").alias("clip_seconds"), F.coalesce(F.lag("p.state").over(time), F.col("initial_state")).alias("previous_state"), "p.state", "p.trigger", "p.confidence", "p.restart_type", "p.law_reference", "boundary_start_seconds")


def state_intervals(changes: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each clip the stretches of one state, from 0 to its duration; changes at one time leave no stretch between them. A clip without changes is in play throughout."""
    w = Window.partitionBy(*keys).orderBy("transition_no")
    after = changes.select(*keys, F.col("state"), F.col("clip_seconds").alias("start_seconds"), F.coalesce(F.lead("clip_seconds").over(w), F.col("duration_seconds")).alias("end_seconds"), (F.lead("clip_seconds").over(w).isNull()).alias("last_"))
    first = changes.where("transition_no = 1").select(*keys, F.col("initial_state").alias("state"), F.lit(0.0).alias("start_seconds"), F.col("clip_seconds").alias("end_seconds"), F.lit(False).alias("last_"))
    calm = clips.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("in_play").alias("state"), F.lit(0.0).alias("start_seconds"), F.round("duration_seconds", 3).alias("end_seconds"), F.lit(True).alias("last_"))
    return first.unionByName(after).unionByName(calm).where("end_seconds > start_seconds").drop("last_")


def state_at(times: DataFrame, stretches: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """The state at a time: stretches are half-open, the last one of a clip is closed."""
    w = Window.partitionBy(*keys)
    ends = stretches.withColumn("until_", F.when(F.col("end_seconds") == F.max("end_seconds").over(w), F.col("end_seconds") + 1e-9).otherwise(F.col("end_seconds")))
    ends = ends.select(*keys, F.col("start_seconds").alias("from_"), "until_", F.col("state").alias(name))
    found = joins.as_of(times, ends, keys, at, "from_", ["until_", name])
    return found.withColumn(name, F.when(F.col(at) < F.col("until_"), F.col(name))).drop("from_", "until_")


def gated(events: DataFrame, stretches: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Restart passes, turnovers just when the ball goes out of play, and events whose start and completion are both in play."""
    rows = state_at(events, stretches, keys, "clip_seconds", "start_state")
    rows = state_at(rows.withColumn("done_", F.coalesce("completion_seconds", "clip_seconds")), stretches, keys, "done_", "end_state")
    exits = changes.where("state = 'out_of_play'").select(*keys, F.col("clip_seconds").alias("exit_"), F.lit(1).alias("out_")).distinct()
    rows = joins.as_of(rows.withColumn("until_", F.col("clip_seconds") + 1e-6), exits, keys, "until_", "exit_", ["out_"], within=2e-6)
    live = (F.col("start_state") == "in_play") & (F.col("end_state") == "in_play")
    ok = (F.col("event_type") == "restart_pass_candidate") | (F.col("exit_").isNotNull() & (F.col("event_type") == "turnover_candidate")) | live
    return rows.where(ok).select(*events.columns)


def boundary_context(times: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, back: float = 2.0) -> DataFrame:
    """possible_out within an interval, recently_resumed up to `back` seconds after the ball is back, inside elsewhere; the first interval decides. A clip's
    intervals are few and travel as one array."""
    listed = intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "resumed_seconds"))).alias("spans_"))
    t = F.col(at)

    def said(s: Column) -> Column:
        return F.when((s["start_seconds"] <= t) & (t <= s["end_seconds"]), "possible_out").when((s["resumed_seconds"] <= t) & (t < s["resumed_seconds"] + back), "recently_resumed")

    found = F.try_element_at(F.filter(F.transform("spans_", said), lambda x: x.isNotNull()), F.lit(1))
    return times.join(listed, list(keys), "left").withColumn("boundary_context", F.coalesce(found, F.lit("inside"))).drop("spans_")


def continuous_flights(intervals: DataFrame, points: DataFrame, keys: Sequence[str], context: float = 0.4, fast: float = 120.0, moving: float = 80.0, ratio: float = 0.75, straight: float = 0.7, seconds: float = 2.2, depth: float = 100.0) -> DataFrame:
    """Intervals with reason "continuous_flight" where the ball, from `context` seconds before to as much after, flies on: four steps or more, `seconds` and `depth` of the interval, a median
    speed of `fast`, and shares of `ratio` of moving steps and of their turns that go straight on (cosine at least `straight`); with the evidence."""
    if context < 0 or fast <= 0 or moving <= 0 or not 0 <= ratio <= 1 or not -1 <= straight <= 1 or seconds < 0 or depth < 0:
        raise ValueError("context, seconds and depth are not negative, speeds positive, ratio in 0..1, straight in -1..1")
    by = [*keys, "start_seconds"]
    spans = intervals.select(*by, (F.col("start_seconds") - context).alias("from_"), (F.col("end_seconds") + context + 1e-9).alias("until_"))
    near = joins.in_interval(points.select(*keys, "clip_seconds", "x", "y"), spans, keys, "clip_seconds", "from_", "until_", 4.0)
    w = Window.partitionBy(*by).orderBy("clip_seconds")
    steps = near.withColumns({"dx_": F.col("x") - F.lag("x").over(w), "dy_": F.col("y") - F.lag("y").over(w), "dt_": F.col("clip_seconds") - F.lag("clip_seconds").over(w)}).where("dt_ > 0")
    steps = steps.withColumn("long_", F.sqrt(F.col("dx_") * F.col("dx_") + F.col("dy_") * F.col("dy_"))).withColumn("speed_", F.col("long_") / F.col("dt_"))
    per = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), F.percentile("speed_", 0.5).alias("median_speed"), F.avg((F.col("speed_") >= moving).cast("double")).alias("moving_ratio"))
    runs = steps.where(F.col("speed_") >= moving)
    cosine = (F.col("dx_") * F.lag("dx_").over(w) + F.col("dy_") * F.lag("dy_").over(w)) / F.nullif(F.col("long_") * F.lag("long_").over(w), F.lit(0.0))
    turns = runs.withColumn("turn_", cosine).where("turn_ IS NOT NULL").groupBy(*by).agg(F.avg((F.col("turn_") >= straight).cast("double")).alias("straight_ratio"))
    rows = intervals.join(per, by, "left").join(turns, by, "left").fillna(0.0, ["moving_ratio", "straight_ratio"])
    flies = (F.col("steps") >= 4) & (F.col("end_seconds") - F.col("start_seconds") >= seconds) & (F.abs("minimum_signed_distance") >= depth) & (F.col("median_speed") >= fast) & (F.col("moving_ratio") >= ratio) & (F.col("straight_ratio") >= ratio)
    rounded = [F.round("median_speed", 2).alias("median_speed"), F.round("moving_ratio", 4).alias("moving_ratio"), F.round("straight_ratio", 4).alias("straight_ratio")]
    return rows.select(*intervals.columns, F.when(flies, "continuous_flight").alias("reason"), *rounded)


def fragmented_projections(stoppages: DataFrame, spell_rows: DataFrame, keys: Sequence[str], parts: int = 3, depth: float = 60.0, margin: float = 1.0, seconds: float = 0.4) -> DataFrame:
    """Coalesced stoppages (merged, minimum_signed_distance) with reason "competitive_possession_inside_boundary": `parts` or more, `depth` deep at most, with a spell of `seconds` at least
    `margin` inside them; with the number of such spells and the longest."""
    own = control.flat(spell_rows, keys).select(*keys, F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end")).where(F.col("end") - F.col("start") >= seconds)
    outer = stoppages.select(*keys, F.col("start_seconds").alias("outer_start"), F.coalesce("resumed_seconds", "end_seconds").alias("outer_end"))
    inside = joins.contained(own, outer, keys, margin, 4.0).groupBy(*keys, F.col("outer_start").alias("start_seconds")).agg(F.count(F.lit(1)).alias("inner_spells"), F.round(F.max(F.col("end") - F.col("start")), 3).alias("longest_spell"))
    rows = stoppages.join(inside, [*keys, "start_seconds"], "left").fillna(0, ["inner_spells"])
    split = (F.col("merged") >= parts) & (F.abs("minimum_signed_distance") <= depth) & (F.col("inner_spells") > 0)
    return rows.withColumn("reason", F.when(split, "competitive_possession_inside_boundary"))

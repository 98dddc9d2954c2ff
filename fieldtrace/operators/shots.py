"""Shots on target: goal faces, crossings of the goal line, arrests before it, and the summary of attempts (2L, D30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import control, joins
from fieldtrace.operators.tracks import ordered


def face(y: Column, z: Column, low: float, high: float, bar: float, unsure: float) -> Column:
    """L3: where a point of the goal's plane lies: inside or outside the frame by more than the uncertainty, else ambiguous."""
    inside = y.between(low + unsure, high - unsure) & (z <= bar - unsure)
    outside = (y < low - unsure) | (y > high + unsure) | (z > bar + unsure)
    return F.when(z < -unsure, "ambiguous").when(inside, "inside").when(outside, "outside").otherwise("ambiguous")


def goal_line_crossings(samples: DataFrame, keys: Sequence[str], line: float) -> DataFrame:
    """The first time that samples (x, y, z) of a flight reach or cross the line, and where, on the straight line between two samples."""
    w = ordered(keys)
    rows = samples.withColumns({"a_": F.col("x") - line, "b_": F.lead("x").over(w) - line, **{f"n{c}": F.lead(c).over(w) for c in ("y", "z", "source_frame")}})
    on, k = F.col("a_") == 0, F.col("a_") / F.when(F.col("a_") != F.col("b_"), F.col("a_") - F.col("b_"))
    rows = rows.where("b_ IS NOT NULL AND (a_ = 0 OR a_ * b_ < 0 OR b_ = 0)")
    at = {f"crossing_{c}": F.when(on, F.col(c)).otherwise(F.col(c) + (F.col(f"n{c}") - F.col(c)) * k) for c in ("y", "z")}
    one = F.struct("source_frame", F.when(on, F.col("source_frame")).otherwise(F.col("nsource_frame")).alias("crossing_frame"), *[c.alias(n) for n, c in at.items()])
    return rows.groupBy(*keys).agg(F.min_by(one, "source_frame").alias("c")).select(*keys, "c.crossing_frame", "c.crossing_y", "c.crossing_z")


def projected_faces(samples: DataFrame, keys: Sequence[str], line: float, low: float, high: float, bar: float, unsure: float) -> DataFrame:
    """Where the last two samples of a flight lead to in the goal's plane; outside if they lead away from it, insufficient if there are not two."""
    last = samples.groupBy(*keys).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("source_frame", "x", "y", "z")))), 1, 2).alias("s"))
    second, first = F.get("s", 0), F.get("s", 1)
    rows = last.select(*keys, *[p[c].alias(f"{n}{c}") for n, p in (("a", first), ("b", second)) for c in ("x", "y", "z")])
    step, left = F.col("bx") - F.col("ax"), line - F.col("bx")
    k = F.try_divide(left, step)
    there = face(F.col("by") + (F.col("by") - F.col("ay")) * k, F.col("bz") + (F.col("bz") - F.col("az")) * k, low, high, bar, unsure)
    return rows.select(*keys, F.when(F.col("ax").isNull(), "insufficient").when((step == 0) | (left * step < 0), "outside").otherwise(there).alias("projected"))


def arrests(points: DataFrame, keys: Sequence[str], zone: float, fast: float, before: float = 1.0, after: float = 0.6, slow: float = 0.35, least: int = 3) -> DataFrame:
    """Points within `zone` of the goal (far) where a ball that came at `fast` or more within the last `before` seconds stops: over the next `after` seconds
    (`least` points) it stays in the zone and slows to `slow` of its peak."""
    w = ordered(keys)
    ms = F.round(F.col("clip_seconds") * 1000).cast("long")
    rows = points.withColumn("toward_", F.col("far") < F.lag("far").over(w)).withColumn("speed_", g.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)) / (F.col("clip_seconds") - F.lag("clip_seconds").over(w)))
    by = Window.partitionBy(*keys).orderBy(ms)
    back, ahead = by.rangeBetween(-round(before * 1000), 0), by.rangeBetween(1, round(after * 1000))
    rows = rows.withColumns({"peak": F.max(F.when(F.col("toward_"), F.col("speed_"))).over(back), "widest_": F.max("far").over(ahead), "slowest_": F.min("speed_").over(ahead), "later_": F.count(F.lit(1)).over(ahead)})
    return rows.where((F.col("far") <= zone) & (F.col("peak") >= fast) & (F.col("later_") >= least) & (F.col("widest_") <= zone) & (F.col("slowest_") <= slow * F.col("peak"))).drop("toward_", "speed_", "widest_", "slowest_", "later_")


def summary(attempts: DataFrame, keys: Sequence[str], teams: Sequence[str]) -> DataFrame:
    """Attempts (attempt_id, order_no, team, resolution, reason), each once (the first): on target for each team, unresolved ones by reason, and whether all is resolved."""
    once = attempts.groupBy(*keys, "attempt_id").agg(F.min_by(F.struct("team", "resolution", "reason"), "order_no").alias("a")).select(*keys, "a.*")
    hit, open_ = F.col("resolution") == "on_target", F.col("resolution") == "unresolved"
    reasons = once.where(open_).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", "n"))), ",").alias("unresolved_reasons"))
    out = once.groupBy(*keys).agg(*[F.count_if(hit & (F.col("team") == t)).alias(f"{t}_on_target") for t in teams], F.count_if(open_).alias("unresolved"))
    return out.withColumn("analysis_status", F.when(F.col("unresolved") > 0, "partial").otherwise("complete")).join(reasons, list(keys), "left")


def candidates(balls: DataFrame, keys: Sequence[str], width: float, height: float, fast: float, least_cosine: float, most_seconds: float = 0.8) -> DataFrame:
    """Steps of the ball of at least `fast` that start in the outer two fifths of the picture and point at the goal of that side (its centre at 18 or 95 percent of the width and
    27 percent of the height): their middle time, speed and side."""
    w = ordered(keys)
    rows = balls.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("x", "y", "clip_seconds")})
    dx, dy, took = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y"), F.col("n_clip_seconds") - F.col("clip_seconds")
    side = F.when(F.col("x") >= 0.6 * width, "right").when(F.col("x") <= 0.4 * width, "left")
    gx, gy = F.when(side == "right", 0.95 * width).otherwise(0.18 * width) - F.col("x"), 0.27 * height - F.col("y")
    long, away = F.sqrt(dx * dx + dy * dy), F.sqrt(gx * gx + gy * gy)
    rows = rows.withColumns({"speed": long / took, "side": side, "took_": took, "aim_": F.try_divide(dx * gx + dy * gy, long * away)})
    ok = (F.col("took_") > 0) & (F.col("took_") <= most_seconds) & (F.col("speed") >= fast) & F.col("side").isNotNull() & (F.col("aim_") >= least_cosine)
    return rows.where(ok).select(*keys, ((F.col("clip_seconds") + F.col("n_clip_seconds")) / 2).alias("clip_seconds"), "speed", "side")


def events(debounced: DataFrame, spell_rows: DataFrame, prior: DataFrame, keys: Sequence[str], teams: Sequence[str], receiver: float = 0.8, owner: float = 3.0) -> DataFrame:
    """Shots from debounced candidates (clip_seconds, speed): none where a spell of two observations or more starts within `receiver` seconds. The team is that of the last event of a
    team within `owner` seconds (its receiver, else its sender, shoots), else of the spell that ended last within them."""
    own = control.flat(spell_rows, keys)
    taken = own.where("observations >= 2").select(*keys, F.col("start_seconds").alias("start_"))
    near = joins.as_of(debounced, taken.withColumn("v_", F.lit(1)), keys, "clip_seconds", "start_", ["v_"], forward=True, within=receiver)
    free = near.where("start_ IS NULL").drop("start_", "v_")
    told = prior.where(F.col("team").isin(*teams)).select(*keys, F.col("clip_seconds").alias("event_at"), F.col("team").alias("event_team"), F.coalesce("to_track", "from_track").alias("event_track"))
    free = joins.as_of(free, told, keys, "clip_seconds", "event_at", ["event_team", "event_track"], within=owner)
    spells = own.select(*keys, F.col("end_seconds").alias("spell_end"), F.col("team").alias("spell_team"), F.col("track_id").alias("spell_track"))
    free = joins.as_of(free, spells, keys, "clip_seconds", "spell_end", ["spell_team", "spell_track"], within=owner)
    by_event = F.col("event_at").isNotNull()
    return free.select(*keys, F.lit("shot_candidate").alias("event_type"), F.round("clip_seconds", 3).alias("clip_seconds"), F.when(by_event, F.col("event_team")).otherwise(F.col("spell_team")).alias("team"), F.when(by_event, F.col("event_track")).otherwise(F.col("spell_track")).alias("from_track"), F.round(F.least(F.lit(0.95), 0.45 + F.col("speed") / 1200), 4).alias("confidence"))


INTENTS = ("scoring_attempt", "ambiguous")


def attempts(releases: DataFrame, breaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Releases (frame, seconds, team, intent, continuation_of) with window_end (frame and seconds of the next one), without those that are seen twice: continuations of another one, and scoring
    attempts (or ambiguous ones) of the team that attempted last with neither a break (frame: a contact or a goal) nor another release between. One release a frame."""
    tries = F.col("intent").isin(*INTENTS)
    rows = releases.where(~(tries & F.col("continuation_of").isNotNull())).withColumn("k_", F.lit(1))
    both = rows.unionByName(breaks.select(*keys, "frame").withColumn("k_", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("frame", "k_")
    parted = F.coalesce((F.col("k_") == 0) | ~tries, F.lit(True))
    both = both.withColumn("parts_", F.sum(parted.cast("int")).over(w))
    own = Window.partitionBy(*keys).orderBy("frame")
    marked = both.where("k_ = 1").withColumn("last_", F.last(F.when(tries, F.struct("team", "parts_")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    again = tries & F.col("last_").isNotNull() & F.col("team").eqNullSafe(F.col("last_.team")) & (F.col("parts_") == F.col("last_.parts_"))
    kept = marked.where(~F.coalesce(again, F.lit(False))).withColumns({"end_frame": F.lead("frame").over(own), "end_seconds": F.lead("seconds").over(own)})
    return kept.where(tries).drop("k_", "parts_", "last_", "continuation_of")


def resolved(tries: DataFrame, evidence: DataFrame, keys: Sequence[str], tolerance: float = 0.2, near: float = 0.6, live: float = 2.0) -> DataFrame:
    """Attempts (frame, seconds, team, intent, end_frame) with resolution and reason.

    evidence has one row a clip, bounded by it: attacking_goal (map of team to side), geometry (map of side to struct line, low, high, bar, unsure), duration_seconds, initial_state and arrays in order of
    time: states (state, start_seconds, end_seconds), samples (frame, x, y, z; observed ones), contacts (frame, seconds, kind, team), goals (frame, seconds, team, side, valid), arrivals (frame, seconds, side, y, z,
    arrested). Each attempt looks only up to the next release. A valid goal counts, then what touched the ball decides by where it was going, then where it was stopped, then where it crossed.
    """
    rows = tries.join(evidence, list(keys)).withColumn("target", F.try_element_at("attacking_goal", F.col("team")))
    geo = F.try_element_at("geometry", F.col("target"))
    within = lambda x: (x["frame"] > F.col("frame")) & (F.col("end_frame").isNull() | (x["frame"] <= F.col("end_frame")))
    first = lambda a, test: F.try_element_at(F.filter(a, test), F.lit(1))
    rows = rows.withColumns({
        "goal_": first("goals", lambda x: within(x) & (x["side"] == F.col("target"))), "contact_": first("contacts", within), "geo_": geo,
        "arrival_": first("arrivals", lambda x: within(x) & (x["side"] == F.col("target"))),
    })
    flight = F.filter("samples", lambda s: (s["frame"] >= F.col("frame")) & F.coalesce(s["frame"] <= F.col("contact_.frame"), F.lit(True)) & F.coalesce(s["frame"] <= F.col("end_frame"), F.lit(True)))
    rows = rows.withColumn("flight_", flight)

    def stopped(start: Column, end: Column) -> Column:
        return F.exists("states", lambda s: (s["state"] != "in_play") & (start < s["start_seconds"]) & (s["start_seconds"] < end - tolerance))

    def at_face(y: Column, z: Column) -> Column:
        u, low, high, bar = (F.col(f"geo_.{c}") for c in ("unsure", "low", "high", "bar"))
        inside, outside = y.between(low + u, high - u) & (z <= bar - u), (y < low - u) | (y > high + u) | (z > bar + u)
        return F.when(z < -u, "ambiguous").when(inside, "inside").when(outside, "outside").otherwise("ambiguous")

    last = F.size("states")
    state = F.coalesce(F.get(F.filter("states", lambda s: (s["start_seconds"] <= F.col("seconds")) & ((F.col("seconds") < s["end_seconds"]) | ((s["end_seconds"] == F.element_at("states", last)["end_seconds"]) & (F.col("seconds") <= s["end_seconds"])))), 0)["state"], F.col("initial_state"))
    a, b = F.try_element_at("flight_", F.lit(-2)), F.try_element_at("flight_", F.lit(-1))
    step, left = b["x"] - a["x"], F.col("geo_.line") - b["x"]
    on = lambda c: b[c] + (b[c] - a[c]) * F.try_divide(left, step)
    few = F.size("flight_") < 2
    projected = F.when(few, "insufficient").when((step == 0) | (left * step < 0), "outside").otherwise(at_face(on("y"), on("z")))
    beside = first("arrivals", lambda x: within(x) & (x["side"] == F.col("target")) & (F.abs(x["seconds"] - F.col("contact_.seconds")) <= near))
    rows = rows.withColumn("beside_", beside).withColumn("path_", F.when(few & F.col("beside_").isNotNull(), at_face(F.col("beside_.y"), F.col("beside_.z"))).otherwise(projected))
    pairs = F.transform(F.slice("flight_", 1, F.greatest(F.size("flight_") - 1, F.lit(0))), lambda s, k: F.struct(s.alias("a"), F.get("flight_", k + 1).alias("b")))
    line = F.col("geo_.line")
    crossed = F.filter(pairs, lambda p: (p["a"]["x"] == line) | ((p["a"]["x"] - line) * (p["b"]["x"] - line) < 0) | (p["b"]["x"] == line))
    rows = rows.withColumn("cross_", F.try_element_at(crossed, F.lit(1)))
    ca, cb = F.col("cross_.a"), F.col("cross_.b")
    k = F.when(ca["x"] == line, F.lit(0.0)).otherwise(F.try_divide(ca["x"] - line, ca["x"] - cb["x"]))
    crossing = at_face(*[ca[c] + (cb[c] - ca[c]) * k for c in ("y", "z")])
    arrival, until = F.col("arrival_"), F.col("arrival_.seconds") + live
    out = stopped(arrival["seconds"], until + tolerance)
    where = at_face(arrival["y"], arrival["z"])
    told = lambda resolution, reason: F.struct(F.lit(resolution).alias("resolution"), F.lit(reason).alias("reason"))
    open_ = lambda reason: told("unresolved", reason)
    goal, contact = F.col("goal_"), F.col("contact_")
    by_goal = F.when(~goal["valid"] | (goal["team"] != F.col("team")), open_("unsupported_goal_claim")).when(stopped(F.col("seconds"), goal["seconds"]), open_("play_stopped_before_outcome")).otherwise(told("on_target", "valid_goal"))
    saved = F.when(contact["kind"] == "goalkeeper", told("on_target", "goalkeeper_save")).otherwise(told("on_target", "last_line_defender_save"))
    by_contact = (
        F.when(stopped(F.col("seconds"), contact["seconds"]), open_("play_stopped_before_outcome")).when(contact["kind"] == "unknown", open_("contact_role_unknown")).when(contact["kind"] == "woodwork", told("off_target", "woodwork_out"))
        .when(contact["kind"] == "outfield", told("blocked", "ordinary_block")).when(contact["team"] == F.col("team"), open_("contact_team_conflict")).when(F.col("path_") == "insufficient", open_("insufficient_observed_motion"))
        .when(F.col("path_") == "inside", saved).when(F.col("path_") == "outside", told("off_target", "pre_contact_path_off_target")).otherwise(open_("goal_frame_ambiguous"))
    )
    by_arrival = (
        F.when(~arrival["arrested"], open_("outcome_not_observed")).when(stopped(F.col("seconds"), arrival["seconds"]), open_("play_stopped_before_outcome")).when(where == "ambiguous", open_("goal_frame_ambiguous"))
        .when(until > F.col("duration_seconds"), open_("flight_truncated")).when((where == "inside") & out, open_("goal_entry_without_goal_confirmation")).when(where == "inside", told("on_target", "stopped_at_goal_face"))
        .when(out, told("off_target", "wide_or_high")).otherwise(open_("off_frame_arrest_in_play"))
    )
    by_crossing = (
        F.when(F.col("cross_").isNull(), F.when(F.col("end_frame").isNull(), open_("flight_truncated")).otherwise(open_("outcome_not_observed")))
        .when(crossing == "outside", told("off_target", "wide_or_high")).when(crossing == "inside", open_("goal_entry_without_goal_confirmation")).otherwise(open_("goal_frame_ambiguous"))
    )
    verdict = (
        F.when(F.col("intent") == "ambiguous", open_("ambiguous_intent")).when(F.col("team").isNull(), open_("unknown_attacking_team")).when(state == "unknown", open_("match_state_unknown"))
        .when(state != "in_play", told("excluded", "release_not_in_play")).when(F.col("target").isNull(), open_("attacking_direction_unknown")).when(goal.isNotNull(), by_goal).when(contact.isNotNull(), by_contact)
        .when(few & arrival.isNotNull(), by_arrival).when(few, open_("insufficient_observed_motion")).otherwise(by_crossing)
    )
    return rows.withColumn("v_", verdict).select(*tries.columns, "target", "v_.resolution", "v_.reason")


def merged(events_: DataFrame, tries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events with the attempts that are on target as shot_on_target, in place of any there before; a sort by time is left to the reader."""
    hits = tries.where("resolution = 'on_target'").select(*keys, F.lit("shot_on_target").alias("event_type"), F.col("seconds").alias("clip_seconds"), "team")
    return events_.where("event_type <> 'shot_on_target'").select(*keys, "event_type", "clip_seconds", "team").unionByName(hits)

"""Who controls the ball, spells of control, and the passes and turnovers between them (2K).

What depends on the row before is a fold in the JVM over a clip's rows; all else is joins and windows whose partitions a clip bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import spread
from fieldtrace.operators import joins, tracks

#: An observation of control, a spell of such, and what a fold over a clip carries.
OBSERVATION = "struct<source_frame:bigint,clip_seconds:double,team:string,track_id:bigint,player_x:double,player_y:double,height:double,ball_x:double,ball_y:double,control_ratio:double>"
SPELL = f"struct<team:string,track_id:bigint,start_seconds:double,end_seconds:double,observations:bigint,close:bigint,held:bigint,first:{OBSERVATION},before:{OBSERVATION},last:{OBSERVATION}>"
FIELDS = [f.split(":")[0] for f in OBSERVATION[len("struct<") : -1].split(",")]


def triples(balls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speeds in and out and the cosine of the turn at each inner point of the ball's path in a clip."""
    w = Window.partitionBy(*keys).orderBy("clip_seconds")
    t = F.col("clip_seconds")
    rows = balls.select(*keys, "source_frame", "clip_seconds", "x", "y").withColumns({
        "ix": F.col("x") - F.lag("x").over(w), "iy": F.col("y") - F.lag("y").over(w), "it": t - F.lag(t).over(w),
        "ox": F.lead("x").over(w) - F.col("x"), "oy": F.lead("y").over(w) - F.col("y"), "ot": F.lead(t).over(w) - t,
    })
    rows = rows.where("it > 0 AND ot > 0").withColumn("il", F.sqrt(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy"))).withColumn("ol", F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")))
    turn = F.when((F.col("il") > 0) & (F.col("ol") > 0), (F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy")) / (F.col("il") * F.col("ol")))
    return rows.select(*keys, "source_frame", "clip_seconds", "x", "y", (F.col("il") / F.col("it")).alias("speed_in"), (F.col("ol") / F.col("ot")).alias("speed_out"), F.col("ot").alias("out_seconds"), turn.alias("turn"))


def control_observations(players: DataFrame, balls: DataFrame, keys: Sequence[str], radius: float, ground: float | None = None, aerial_turn: float = 0.5, flyby_speed: float | None = None, flyby_heights: float | None = None, flyby_turn: float = 0.85, confirm: float = 0.0) -> DataFrame:
    """K1: of each frame the player nearest to the ball within `radius` heights.

    A ball higher than `ground` heights counts only where it turns (cosine at most aerial_turn) within half a height sideways of the player. A frame whose nearest
    player a fast ball flies past (speed at least flyby_speed, or flyby_heights of that player a second, cosine at least flyby_turn) has no
    observation. If confirm > 0, neither holds for a player of the team that controlled before whose track is within half a height of a low ball at
    most `confirm` seconds later. Ties in distance go to the smaller track_id, then to the taller box, then to the one farther left. There is one ball a frame.

    Only the last rule depends on the row before, and only through its team: each frame has at most one outcome for each team, and a fold chooses.
    """
    if not -1 <= flyby_turn <= 1 or not -1 <= aerial_turn <= 1 or confirm < 0 or (ground is not None and ground < 0):
        raise ValueError("cosines lie between -1 and 1, seconds and heights are not negative")
    if any(v is not None and v <= 0 for v in (flyby_speed, flyby_heights)):
        raise ValueError("speeds are positive")
    frame = [*keys, "source_frame"]
    fx, fy = g.foot(g.box())
    motion = tracks.motion(balls, [*keys, "track_id"]).select(*frame, "motion_speed", "turn_cosine")
    b = balls.select(*frame, "clip_seconds", F.col("x").alias("ball_x"), F.col("y").alias("ball_y")).join(motion, frame, "left")
    p = players.select(*frame, "team", "track_id", fx.alias("player_x"), fy.alias("player_y"), g.height(g.box()).alias("height"))
    pairs = b.join(p, frame).withColumn("distance", g.distance(F.col("ball_x"), F.col("ball_y"), F.col("player_x"), F.col("player_y")))
    pairs = pairs.withColumn("ratio", F.col("distance") / F.col("height")).where(F.col("ratio") <= radius)
    up = (F.col("player_y") - F.col("ball_y")) / F.col("height")
    pairs = pairs.withColumn("low_", (up <= (0.4 if ground is None else ground)) & (F.col("ratio") <= 0.5))
    w = Window.partitionBy(*keys, "track_id").orderBy(F.round(F.col("clip_seconds") * 1000).cast("long")).rangeBetween(1, max(1, round(confirm * 1000)))
    pairs = pairs.withColumn("later_", (F.coalesce(F.max("low_").over(w), F.lit(False))) if confirm > 0 else F.lit(False))
    elevated = F.lit(False)
    if ground is not None:
        elevated = (up > ground) & (F.col("turn_cosine").isNull() | (F.col("turn_cosine") > aerial_turn) | (F.abs(F.col("ball_x") - F.col("player_x")) / F.col("height") > 0.5))
    fast = F.lit(False)
    if flyby_speed is not None:
        fast = fast | (F.col("motion_speed") >= flyby_speed)
    if flyby_heights is not None:
        fast = fast | (F.col("motion_speed") / F.col("height") >= flyby_heights)
    pairs = pairs.withColumn("elevated_", elevated).withColumn("flyby_", F.coalesce(fast & (F.col("turn_cosine") >= flyby_turn), F.lit(False)))
    one = F.struct("source_frame", "clip_seconds", "team", "track_id", "player_x", "player_y", "height", "ball_x", "ball_y", F.round("ratio", 4).alias("control_ratio")).cast(OBSERVATION)
    listed = pairs.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("distance", "track_id", "ratio", "elevated_", "flyby_", F.when(F.col("later_"), F.col("team")).alias("spared_"), one.alias("one")))).alias("c"))

    def outcome(c: Column, before: Column) -> Column:
        spared = lambda x: F.coalesce(x["spared_"] == before, F.lit(False))
        near = F.try_element_at(F.filter(c, lambda x: ~x["elevated_"] | spared(x)), F.lit(1))
        return F.when(~near["flyby_"] | spared(near), near["one"])

    if confirm <= 0:
        return listed.select(*keys, outcome(F.col("c"), F.lit(None).cast("string")).alias("o")).where("o IS NOT NULL").select(*keys, "o.*")
    clips = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_frame", "c"))).alias("all_"))
    start = F.struct(F.lit(None).cast("string").alias("team"), F.array().cast(f"array<{OBSERVATION}>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        o = outcome(f["c"], acc["team"])
        return F.struct(F.coalesce(o["team"], acc["team"]).alias("team"), F.when(o.isNotNull(), F.concat(acc["out"], F.array(o))).otherwise(acc["out"]).alias("out"))

    return clips.select(*keys, F.explode(F.aggregate("all_", start, step, lambda acc: acc["out"])).alias("o")).select(*keys, "o.*")


def spell_numbers(observations: DataFrame, keys: Sequence[str], gap: float, radius: float, apart: float = 0.0) -> DataFrame:
    """K3: observations with the number of their spell. One goes on for at most `gap` seconds within a team if the track is the same, or the player moved at most
    `radius` heights, or the ball is dribbled on (cosine 0.9, 5 heights a second, ratios within 1, after two observations of the spell); but not to
    a track that takes turns with the spell's first one within `apart` seconds each way (0: no such rule), which tells two players apart."""
    if apart < 0:
        raise ValueError("seconds are not negative")
    observations = spread(observations, keys)  # windows, lists and folds follow in one task
    w = Window.partitionBy(*keys).orderBy("clip_seconds")
    back = lambda c, k=1: F.lag(c, k).over(w)
    t = F.col("clip_seconds")
    scale = F.greatest(F.lit(1.0), (F.col("height") + back("height")) / 2)
    ix, iy, ox, oy = back("ball_x") - back("ball_x", 2), back("ball_y") - back("ball_y", 2), F.col("ball_x") - back("ball_x"), F.col("ball_y") - back("ball_y")
    il, ol = F.sqrt(ix * ix + iy * iy), F.sqrt(ox * ox + oy * oy)
    dribbled = (back("control_ratio") <= 1) & (F.col("control_ratio") <= 1) & (t > back("clip_seconds")) & (il > 0) & (ol > 0) & (ix * ox + iy * oy >= 0.9 * il * ol) & (ol / (t - back("clip_seconds")) / scale <= 5)
    near = (F.col("track_id") == back("track_id")) | (g.distance(F.col("player_x"), F.col("player_y"), back("player_x"), back("player_y")) / scale <= radius)
    joined = (t - back("clip_seconds") <= gap) & (F.col("team") == back("team"))
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = observations.withColumn("same_", no(joined & near)).withColumn("on_", no(joined & dribbled))
    one = F.struct(t, "track_id", "same_", "on_", F.struct(*FIELDS).cast(OBSERVATION).alias("one"))
    clips = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all_"))
    if apart > 0:
        pairs = returning_pairs(observations, keys, apart).groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("pairs_"))
        clips = clips.join(pairs, [*keys], "left")
    else:
        clips = clips.withColumn("pairs_", F.lit(None).cast("array<struct<low:bigint,high:bigint>>"))
    start = F.struct(F.lit(0).alias("spell"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("track"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        pair = F.struct(F.least(o["track_id"], acc["track"]).alias("low"), F.greatest(o["track_id"], acc["track"]).alias("high"))
        returns = F.coalesce((o["track_id"] != acc["track"]) & F.array_contains("pairs_", pair), F.lit(False))
        on = (o["same_"] | (o["on_"] & (acc["n"] >= 2))) & ~returns
        spell = F.when(on, acc["spell"]).otherwise(acc["spell"] + 1)
        return F.struct(spell.alias("spell"), F.when(on, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(on, acc["track"]).otherwise(o["track_id"]).alias("track"), F.concat(acc["out"], F.array(spell)).alias("out"))

    numbered = clips.withColumn("no_", F.aggregate("all_", start, step, lambda acc: acc["out"]))
    return numbered.select(*keys, F.explode(F.arrays_zip("all_", "no_")).alias("z")).select(*keys, F.col("z.no_").alias("spell_no"), "z.all_.one.*")


def returning_pairs(observations: DataFrame, keys: Sequence[str], apart: float) -> DataFrame:
    """Pairs of tracks of which one controls, then the other at most `apart` seconds later, then again the first at most as much later."""
    w = Window.partitionBy(*keys, "track_id").orderBy("clip_seconds")
    runs = observations.select(*keys, "track_id", "clip_seconds", F.lead("clip_seconds").over(w).alias("next_seconds")).where(F.col("next_seconds") - F.col("clip_seconds") <= 2 * apart)
    other = observations.select(*keys, F.col("track_id").alias("other"), F.col("clip_seconds").alias("at"))
    pairs = joins.in_interval(other, runs, keys, "at", "clip_seconds", "next_seconds", max(0.1, 2 * apart)).where((F.col("other") != F.col("track_id")) & (F.col("at") - F.col("clip_seconds") <= apart) & (F.col("next_seconds") - F.col("at") <= apart + 1e-9))
    return pairs.select(*keys, F.least("track_id", "other").alias("low"), F.greatest("track_id", "other").alias("high")).distinct()


def spells(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row a spell (spell): counts, its first and last two observations. Its track is that of the first."""
    one = F.struct(*FIELDS).cast(OBSERVATION)
    per = numbered.groupBy(*keys, "spell_no").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("control_ratio") <= 0.5).cast("int").alias("close"),
        F.count_if(((F.col("player_y") - F.col("ball_y")) / F.greatest(F.lit(1.0), F.col("height")) >= 0.65) & (F.col("control_ratio") <= 1.6)).cast("int").alias("held"),
        F.min_by(one, "clip_seconds").alias("first"), F.slice(F.array_sort(F.collect_list(F.struct("clip_seconds", one.alias("one")))), -2, 2).alias("ends"), F.max_by(one, "clip_seconds").alias("last"),
    )
    before = F.when(F.col("n") > 1, F.expr("transform(ends, e -> e.one)[0]"))
    row = F.struct(F.col("first.team"), F.col("first.track_id"), F.col("first.clip_seconds").alias("start_seconds"), F.col("last.clip_seconds").alias("end_seconds"), F.col("n").alias("observations"), "close", "held", "first", before.alias("before"), "last")
    return per.select(*keys, "spell_no", row.cast(SPELL).alias("spell"))


def flat(spell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spell_rows.select(*keys, "spell_no", "spell.*")


def collapsed(spell_rows: DataFrame, keys: Sequence[str], longest: float, occluded: float | None = None, owner_speed: float = 3.0, owner_turn: float | None = None) -> DataFrame:
    """K4: spells without those of an opponent between two spells of one team, if they last at most `longest` seconds and the team is back within
    `occluded` (else `longest`) seconds, or if the owner can have gone on: within `occluded` seconds, at most owner_speed heights a second, and, if given, at a
    cosine of at least owner_turn to its motion, and the opponent had no firm control (four observations, two of them close) or the team's next spell has two.
    A spell of the same track then continues the one before. Two teams meet; spells are numbered anew.

    A fold over a clip's spells carries the spells kept and the opponent's that wait for what follows.
    """
    if longest < 0 or (occluded is not None and occluded < 0) or owner_speed <= 0 or not -1 <= (owner_turn or 0) <= 1:
        raise ValueError("durations are not negative, speeds positive, cosines between -1 and 1")
    listed = spell_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("spell_no", "spell"))).alias("all_"))
    many = f"array<{SPELL}>"
    start = F.struct(F.array().cast(many).alias("kept"), F.array().cast(many).alias("wait"))
    end = lambda a: F.try_element_at(a, F.lit(-1))

    def step(acc: Column, x: Column) -> Column:
        s, kept, wait = x["spell"], acc["kept"], acc["wait"]
        owner, foe = end(kept), end(wait)
        opponent_at = F.try_element_at(wait, F.lit(1))["start_seconds"]
        short = (foe["end_seconds"] - opponent_at <= longest) & (s["start_seconds"] - foe["end_seconds"] <= (longest if occluded is None else occluded))
        plausible = F.lit(False)
        if occluded is not None:
            a, b = owner["last"], s["first"]
            took = b["clip_seconds"] - a["clip_seconds"]
            far = g.distance(a["player_x"], a["player_y"], b["player_x"], b["player_y"]) / F.greatest(F.lit(1.0), (a["height"] + b["height"]) / 2)
            plausible = (took > 0) & (took <= occluded) & (far / took <= owner_speed)
            if owner_turn is not None:
                px, py = a["player_x"] - owner["before"]["player_x"], a["player_y"] - owner["before"]["player_y"]
                qx, qy = b["player_x"] - a["player_x"], b["player_y"] - a["player_y"]
                pl, ql = F.sqrt(px * px + py * py), F.sqrt(qx * qx + qy * qy)
                plausible = plausible & (owner["observations"] >= 2) & (pl > 0) & (ql > 0) & (px * qx + py * qy >= owner_turn * pl * ql)
            firm = F.exists(wait, lambda o: (o["observations"] >= 4) & (o["close"] >= 2))
            plausible = plausible & ((s["observations"] >= 2) | ~firm)
        bridged = F.coalesce(short | plausible, F.lit(False))
        # What continues the owner's spell: one of the track that had it last.
        longer = F.struct(
            owner["team"].alias("team"), owner["track_id"].alias("track_id"), owner["start_seconds"].alias("start_seconds"), s["end_seconds"].alias("end_seconds"), (owner["observations"] + s["observations"]).alias("observations"), (owner["close"] + s["close"]).alias("close"),
            (owner["held"] + s["held"]).alias("held"), owner["first"].alias("first"), F.coalesce(s["before"], owner["last"]).alias("before"), s["last"].alias("last"),
        ).cast(SPELL)
        merged = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(longer))
        same_track = owner["last"]["track_id"] == s["first"]["track_id"]
        none, own = F.array().cast(many), F.array(s)
        pair = lambda k, w: F.struct(k.alias("kept"), w.alias("wait"))
        back = F.when(bridged & same_track, pair(merged, none)).when(bridged, pair(F.concat(kept, own), none)).otherwise(pair(F.concat(kept, wait), own))
        return F.when(F.size(kept) == 0, pair(own, none)).when(s["team"] != owner["team"], pair(kept, F.concat(wait, own))).when(F.size(wait) == 0, pair(F.concat(kept, own), none)).otherwise(back)

    # The fold starts from arrays that may be empty, so lengths of slices are guarded by size(kept) above.
    folded = listed.select(*keys, F.posexplode(F.aggregate("all_", start, step, lambda acc: F.concat(acc["kept"], acc["wait"]))).alias("spell_no", "spell"))
    return folded.withColumn("spell_no", (F.col("spell_no") + 1).cast("int"))


def stable(spell_rows: DataFrame, least: int, trusted: Sequence[int]) -> DataFrame:
    """K5: spells of at least so many observations, and single observations of trusted tracks (goalkeepers)."""
    n = F.col("spell.observations")
    return spell_rows.where((n >= least) | ((n == 1) & F.col("spell.track_id").isin(list(trusted))))


def with_single_touches(spell_rows: DataFrame, stable_rows: DataFrame, numbered: DataFrame, covisible: DataFrame, keys: Sequence[str], longest: float, heights: float) -> DataFrame:
    """K6: stable spells, and single observations within 0.35 heights after which a stable spell of a co-visible teammate (first_track, second_track) has the ball: two observations of it within half a
    height, the first of them at most `longest` seconds later and `heights` of ball travel away. numbered: the observations with their spell_no."""
    close = numbered.where(F.col("control_ratio") <= 0.5).groupBy(*keys, "spell_no").agg(F.min_by(F.struct("clip_seconds", "ball_x", "ball_y", "height"), "clip_seconds").alias("c"), F.count(F.lit(1)).alias("n_")).where("n_ >= 2")
    receivers = stable_rows.join(close, [*keys, "spell_no"]).select(*keys, F.col("spell.team").alias("team_"), F.col("spell.track_id").alias("receiver_"), "c", F.col("c.clip_seconds").alias("at_"))
    others = spell_rows.join(stable_rows.select(*keys, "spell_no"), [*keys, "spell_no"], "left_anti")
    touch = F.col("spell.last")
    senders = others.where((F.col("spell.observations") == 1) & (touch["control_ratio"] <= 0.35)).withColumn("from_", touch["clip_seconds"]).withColumn("until_", touch["clip_seconds"] + longest + 1e-9)
    pairs = joins.in_interval(receivers, senders, keys, "at_", "from_", "until_", max(1.0, longest)).where((F.col("team_") == F.col("spell.team")) & (F.col("receiver_") != F.col("spell.track_id")))
    travel = g.distance(F.col("c.ball_x"), F.col("c.ball_y"), touch["ball_x"], touch["ball_y"]) / F.greatest(F.lit(1.0), (touch["height"] + F.col("c.height")) / 2)
    both = {"first_track": F.least("receiver_", F.col("spell.track_id")), "second_track": F.greatest("receiver_", F.col("spell.track_id"))}
    found = pairs.where(travel >= heights).withColumns(both).join(covisible.select(*keys, "first_track", "second_track"), [*keys, "first_track", "second_track"], "left_semi")
    return stable_rows.unionByName(spell_rows.join(found.select(*keys, "spell_no").distinct(), [*keys, "spell_no"], "left_semi"))


def next_spell(spell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("spell_no")
    return spell_rows.withColumn("to_", F.lead("spell").over(w)).where("to_ IS NOT NULL").withColumn("gap_", F.col("to_.start_seconds") - F.col("spell.end_seconds"))


def event(keys: Sequence[str], kind: Column, at: Column, confidence: Column, to: Column, completion: Column, team: Column | None = None, sender: Column | None = None) -> list:
    own = F.col("spell")
    return [*keys, kind.alias("event_type"), at.alias("clip_seconds"), (own["team"] if team is None else team).alias("team"), (own["track_id"] if sender is None else sender).alias("from_track"), to.alias("to_track"), F.round(confidence, 4).alias("confidence"), F.round(completion, 3).alias("completion_seconds")]


def transfer_kind(a: Column, b: Column) -> Column:
    return F.when(a == b, "pass_candidate").otherwise("turnover_candidate")


def transfers(spell_rows: DataFrame, keys: Sequence[str], longest: float, heights: float) -> DataFrame:
    """K7: from a spell to the next of another track within `longest` seconds. The ball must travel `heights` mean heights of the two players, but for a turnover
    to a spell of four observations, two of them close. Confidence grows with observations and travel."""
    rows = next_spell(spell_rows, keys).where((F.col("gap_") >= 0) & (F.col("gap_") <= longest) & (F.col("spell.track_id") != F.col("to_.track_id")))
    a, b = F.col("spell.last"), F.col("to_.first")
    travel = g.distance(b["ball_x"], b["ball_y"], a["ball_x"], a["ball_y"]) / F.greatest(F.lit(1.0), (a["height"] + b["height"]) / 2)
    firm = (F.col("spell.team") != F.col("to_.team")) & (F.col("to_.observations") >= 4) & (F.col("to_.close") >= 2)
    rows = rows.withColumn("travel_", travel).where((F.col("travel_") >= heights) | firm)
    sure = F.least(F.lit(1.0), 0.3 + 0.05 * F.least(F.col("spell.observations"), F.lit(3)) + 0.05 * F.least(F.col("to_.observations"), F.lit(3)) + 0.05 * F.least(F.col("travel_"), F.lit(3.0)))
    return rows.select(*event(keys, transfer_kind(F.col("spell.team"), F.col("to_.team")), F.col("spell.end_seconds"), sure, F.col("to_.track_id"), F.col("to_.start_seconds")))


def between(pairs: DataFrame, points: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Points (of triples()) from the end of a spell to the start of the next, each spell pair's beside it."""
    spans = pairs.withColumn("from_", F.col("spell.end_seconds")).withColumn("until_", F.col("to_.start_seconds") + 1e-6)
    return joins.in_interval(points, spans, keys, "clip_seconds", "from_", "until_", width)


def direction_changes(spell_rows: DataFrame, points: DataFrame, keys: Sequence[str], longest: float, speed: float, turn: float = 0.25) -> DataFrame:
    """K8: passes between consecutive spells of a team and other tracks within `longest` seconds, if the ball turns between them (cosine at most `turn`) at `speed` in and out."""
    pairs = next_spell(spell_rows, keys).where((F.col("spell.team") == F.col("to_.team")) & (F.col("spell.track_id") != F.col("to_.track_id")) & (F.col("gap_") >= 0) & (F.col("gap_") <= longest))
    sharp = points.where((F.least("speed_in", "speed_out") >= speed) & (F.col("turn") <= turn))
    hit = between(pairs, sharp, keys, longest).groupBy(*keys, "spell_no").agg(F.min("turn").alias("turn_"), F.first("spell").alias("spell"), F.first("to_").alias("to_"))
    rows = hit.select(*event(keys, F.lit("pass_candidate"), F.round("spell.end_seconds", 3), F.least(F.lit(0.8), 0.55 + (1 - F.col("turn_")) * 0.1), F.col("to_.track_id"), F.col("to_.start_seconds")))
    return deduplicated(rows, keys)


def flights(releases: DataFrame, spell_rows: DataFrame, keys: Sequence[str], lookback: float, window: float, least_sender: int = 1, least_receiver: int = 1) -> DataFrame:
    """K9: debounced releases (clip_seconds, speed) of the spell that ends last among those begun by then and over at most `lookback` seconds ago, to the first
    spell of another track that starts within `window` seconds."""
    one = F.struct(F.col("spell.end_seconds").alias("end_"), (-F.col("spell_no")).alias("order_"), "spell")
    owners = spell_rows.where(F.col("spell.observations") >= least_sender).select(*keys, F.col("spell.start_seconds").alias("from_"), (F.col("spell.end_seconds") + lookback + 1e-9).alias("until_"), one.alias("owner_"))
    sent = joins.in_interval(releases, owners, keys, "clip_seconds", "from_", "until_", max(1.0, lookback)).groupBy(*keys, "clip_seconds", "speed").agg(F.max("owner_").alias("owner_"))
    sent = sent.withColumn("sender_", F.col("owner_.spell")).drop("owner_")
    taken = spell_rows.where(F.col("spell.observations") >= least_receiver).select(*keys, "spell_no", F.col("spell.start_seconds").alias("begin_"), (F.col("spell.start_seconds") + 1e-9).alias("stop_"), F.col("spell").alias("to_"))
    taken = taken.withColumn("open_", F.col("begin_") - window)
    pairs = joins.in_interval(sent, taken, keys, "clip_seconds", "open_", "stop_", max(1.0, window)).where(F.col("to_.track_id") != F.col("sender_.track_id"))
    first = pairs.groupBy(*keys, "clip_seconds", "speed").agg(F.min_by(F.struct(F.col("sender_").alias("spell"), "to_"), "spell_no").alias("p")).select(*keys, "clip_seconds", "speed", "p.*")
    rows = first.select(*event(keys, transfer_kind(F.col("spell.team"), F.col("to_.team")), F.round("clip_seconds", 3), F.least(F.lit(0.9), 0.45 + F.col("speed") / 1000), F.col("to_.track_id"), F.col("to_.start_seconds")))
    return deduplicated(rows, keys)


def decelerations(spell_rows: DataFrame, points: DataFrame, keys: Sequence[str], speed: float, slow: float, lookback: float, window: float, heights: float) -> DataFrame:
    """Passes from a spell to nobody known: between it and the next of its team the ball slows from `speed` to a share of at most `slow` of its speed, at most
    min(lookback, 0.75) s after the spell and 0.6 s to `window` before the next, `heights` away, and flies again (at least max(150, 3 * speed)) 0.6 s or more later."""
    if speed <= 0 or not 0 < slow < 1:
        raise ValueError("speed is positive, slow between 0 and 1")
    pairs = next_spell(spell_rows, keys).where(F.col("spell.team") == F.col("to_.team"))
    # The last fast step that ends before the next spell starts.
    again = between(pairs, points.where(F.col("speed_out") >= max(150.0, 3 * speed)), keys, 4.0).where(F.col("clip_seconds") + F.col("out_seconds") <= F.col("to_.start_seconds"))
    again = again.groupBy(*keys, "spell_no").agg(F.max("clip_seconds").alias("again_"))
    slowed = points.where((F.col("speed_in") >= speed) & (F.col("speed_out") <= slow * F.col("speed_in")))
    rows = between(pairs, slowed, keys, 4.0).join(again, [*keys, "spell_no"])
    t, last = F.col("clip_seconds"), F.col("spell.last")
    near = (t > F.col("spell.end_seconds")) & (t < F.col("to_.start_seconds")) & (t - F.col("spell.end_seconds") <= min(lookback, 0.75)) & (F.col("to_.start_seconds") - t <= window) & (F.col("to_.start_seconds") - t >= 0.6)
    far = g.distance(F.col("x"), F.col("y"), last["ball_x"], last["ball_y"]) / F.greatest(F.lit(1.0), last["height"]) >= heights
    rows = rows.where(near & far & (F.col("again_") >= t + 0.6))
    best = rows.groupBy(*keys, "spell_no").agg(F.max(F.struct((F.col("speed_in") / F.greatest(F.col("speed_out"), F.lit(1.0))).alias("r"), t.alias("t"))).alias("b"), F.first("spell").alias("spell"))
    out = best.select(*event(keys, F.lit("pass_candidate"), F.round("spell.end_seconds", 3), F.lit(0.6), F.lit(None).cast("bigint"), F.col("b.t")))
    return deduplicated(out, keys)


EVENT = "struct<clip_seconds:double,completion_seconds:double,event_type:string,team:string,from_track:bigint,to_track:bigint,confidence:double>"
NAMES = ["clip_seconds", "completion_seconds", "event_type", "team", "from_track", "to_track", "confidence"]


def looked_up(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) where the value is worked out once: within a fold every mention of it, in a lambda for each element, would work it out anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def deduplicated(events: DataFrame, keys: Sequence[str], same: float = 0.25, other: float = 0.04) -> DataFrame:
    """Of receptions of one type, team and receiver that complete within `same` seconds of an earlier one (`other` if another track sends) the first stays;
    where the sender is the same, the later takes its place. The receptions kept are carried through a fold over the clip's events in order."""
    listed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*NAMES).cast(EVENT))).alias("all_"))

    def step(acc: Column, e: Column) -> Column:
        def twin(p: Column) -> Column:
            limit = F.when(p["from_track"].eqNullSafe(e["from_track"]), same).otherwise(other)
            return F.coalesce((p["event_type"] == e["event_type"]) & (p["team"] == e["team"]) & p["to_track"].eqNullSafe(e["to_track"]) & (F.abs(p["completion_seconds"] - e["completion_seconds"]) <= limit), F.lit(False))

        def kept(at: Column) -> Column:
            found = F.try_element_at(acc, F.when(at > 0, at).otherwise(1).cast("int"))
            replaced = F.transform(acc, lambda p, k: F.when(k == at - 1, e).otherwise(p))
            return F.when(at == 0, F.concat(acc, F.array(e))).when(found["from_track"].eqNullSafe(e["from_track"]), replaced).otherwise(acc).cast(f"array<{EVENT}>")

        return looked_up(F.array_position(F.transform(acc, twin), F.lit(True)), kept)

    return listed.select(*keys, F.explode(F.aggregate("all_", F.array().cast(f"array<{EVENT}>"), step)).alias("e")).select(*keys, "e.*")


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Primary events, and those of the fallback that have no event kept within `seconds` (one kept before them, or primary), then deduplicated()."""
    one = F.struct(*NAMES).cast(EVENT)
    lists = [df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias(n)) for df, n in ((primary, "a_"), (fallback, "b_"))]
    both = lists[0].join(lists[1], list(keys), "full_outer")
    none = F.array().cast(f"array<{EVENT}>")

    def step(acc: Column, e: Column) -> Column:
        return F.when(F.exists(acc, lambda p: F.abs(p["clip_seconds"] - e["clip_seconds"]) <= seconds), acc).otherwise(F.concat(acc, F.array(e)))

    merged = both.select(*keys, F.explode(F.aggregate(F.coalesce("b_", none), F.coalesce("a_", none), step)).alias("e")).select(*keys, "e.*")
    return deduplicated(merged, keys)


def startup_guarded(events: DataFrame, observations: DataFrame, keys: Sequence[str], guard: float, ratio: float, tolerance: float = 0.25) -> DataFrame:
    """Without receptions up to `guard` seconds whose receiver was seen around then, but never within `ratio` heights."""
    if guard < 0 or ratio <= 0:
        raise ValueError("guard is not negative, ratio positive")
    some = observations.select(*keys, F.col("track_id").alias("to_track"), F.col("clip_seconds").alias("seen_seconds"), "control_ratio")
    early = events.where((F.col("completion_seconds") <= guard) & F.col("to_track").isNotNull())
    weak = joins.within_band(early, some, [*keys, "to_track"], "completion_seconds", "seen_seconds", tolerance).groupBy(*keys, "clip_seconds", "completion_seconds", "to_track").agg(F.min("control_ratio").alias("best_")).where(F.col("best_") > ratio).drop("best_")
    return events.join(weak, [*keys, "clip_seconds", "completion_seconds", "to_track"], "left_anti")


def inherited(spell_rows: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Owners (keys, initial_team) had the ball before: if the first spell is the other team's, a turnover at 0."""
    first = spell_rows.groupBy(*keys).agg(F.min_by("spell", F.col("spell.start_seconds")).alias("to_")).join(owners, list(keys)).where(F.col("to_.team") != F.col("initial_team"))
    return first.select(*event(keys, F.lit("turnover_candidate"), F.lit(0.0), F.lit(0.65), F.col("to_.track_id"), F.col("to_.start_seconds"), F.col("initial_team"), F.lit(None).cast("bigint")))

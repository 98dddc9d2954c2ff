"""Who plays in which kit, who keeps which goal and who officiates, from the first seconds of a clip."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.storage import once, spread
from fieldtrace.operators.rules import lab, nearest_name

#: Fixed values of kit clusters: samples and seconds of a track, tracks of a clip and of a side, least separation of seeds in L*a*b*, bounds of the trim, its multiple of the median, least confidence.
SAMPLES, SECONDS, TRACKS, SIDE, SEPARATION, TRIM, TRIM_MEDIANS, SURE = 3, 1.5, 4, 2, 18.0, (18.0, 55.0), 2.5, 0.42
#: Fixed values of goalkeepers: seconds, outer part of the pitch, least share of positions there, least colour distance, movement and colour distance that count whole, weights, least confidence.
KEEPER_SECONDS, OUTER, KEEPER_SHARE, KEEPER_COLOR, MOVES, WHOLE, PLACE, LOOK, KEEPER_SURE = 6.0, 0.24, 0.6, 24.0, 0.35, 70.0, 0.55, 0.45, 0.58
#: Fixed values of sides and officials: by how much the teams' medians differ; seconds, share of positions in the centre, and the centre.
SIDES_APART, OFFICIAL_SECONDS, OFFICIAL_SHARE, CENTRE = 0.08, 4.0, 0.55, ((0.2, 0.8), (0.15, 0.9))
#: Fixed palette (blue, green, red).
KITS = {"black": (25, 25, 25), "blue": (170, 70, 25), "green": (45, 140, 45), "red": (35, 35, 190), "white": (220, 220, 220), "yellow": (40, 210, 220)}
NO_TEAMS, NO_KICKOFF, NO_KEEPERS = "two_outfield_kit_clusters_not_confident", "segment_does_not_begin_at_kickoff", "both_goalkeepers_not_confidently_affiliated"


def evidence(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a track: sample_count, duration_seconds, its median colour (b, g, r), and its positions (x, y from 0 to 1) as an array."""
    colors = [F.floor(F.percentile(c, F.lit(0.5)) + 0.5).cast("int").alias(c) for c in ("b", "g", "r")]
    return points.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("sample_count"), (F.max("clip_seconds") - F.min("clip_seconds")).alias("duration_seconds"), *colors, F.collect_list(F.struct("x", "y")).alias("positions"))


def apart(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def of_lab(row: str) -> list[Column]:
    return [F.col(f"{row}.{c}") for c in ("l", "a", "b")]


def as_lab(b: Column, g: Column, r: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(("l", "a", "b"), lab(b, g, r), strict=True)])


def best_split(colors: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
    """For each track 0 or 1, or -1 for those trimmed off: the best of all pairs of seeds, each track going to the nearer one; None without two clear sides."""
    n = len(colors)
    distance = np.sqrt(((colors[:, None] - colors[None]) ** 2).sum(axis=2))
    best, sides, seen = 0.0, None, set()
    for i in range(n):
        seeds = i + 1 + np.flatnonzero(~(distance[i, i + 1 :] < SEPARATION))
        splits = distance[:, i] > distance[seeds]
        few = np.minimum(splits.sum(axis=1), n - splits.sum(axis=1))
        for second in splits[few >= SIDE]:
            if second.tobytes() in seen:  # other seeds split the tracks in the same way
                continue
            seen |= {second.tobytes(), (~second).tobytes()}
            count = np.array([(~second).sum(), second.sum()])
            centers = np.stack([np.average(colors[second == s], axis=0, weights=weights[second == s]) for s in (False, True)])
            within = np.sqrt(((colors - centers[second.astype(int)]) ** 2).sum(axis=1)).sum() / n
            score = np.sqrt(((centers[0] - centers[1]) ** 2).sum()) * (count.min() / count.max()) / (1.0 + within)
            if sides is None or score > best:
                best, sides = score, second.astype(int)
    if sides is None:
        return None
    out = np.full(n, -1)
    for s in (0, 1):
        own = np.flatnonzero(sides == s)
        far = np.sqrt(((colors[own] - np.average(colors[own], axis=0, weights=weights[own])) ** 2).sum(axis=1))
        out[own[far <= max(TRIM[0], min(TRIM[1], float(np.median(far)) * TRIM_MEDIANS))]] = s
    return out if min((out == 0).sum(), (out == 1).sum()) >= SIDE else None


def kits(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, track_id, team, color (b, g, r of the team), confidence) for the outfield tracks of clips with two clear kits.

    All pairs of a clip's tracks are tried as seeds, which are a few dozen, so a clip is one group of numpy, whose sides, which several steps read, are kept; centres, names and confidence are columns.
    """
    weight = F.least(F.lit(20.0), F.greatest(F.lit(1.0), F.col("duration_seconds")))
    some = tracks.where((F.col("sample_count") >= SAMPLES) & (F.col("duration_seconds") >= SECONDS)).withColumn("weight", weight.cast("double")).withColumn("lab", as_lab(F.col("b"), F.col("g"), F.col("r")))
    kinds = ", ".join(f"{k} {tracks.schema[k].dataType.simpleString()}" for k in (*keys, "track_id"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id")
        sides = best_split(pdf[["l", "a", "b"]].to_numpy(float), pdf["weight"].to_numpy(float)) if len(pdf) >= TRACKS else None
        out = pdf[[*keys, "track_id"]].assign(side=-1 if sides is None else sides)
        return out[out["side"] >= 0]

    sides = once(spread(some.select(*keys, "track_id", "weight", "lab.*"), keys).groupBy(*keys).applyInPandas(split, f"{kinds}, side int"))
    rows = some.select(*keys, "track_id", "weight", "lab", F.col("b").alias("blue"), F.col("g").alias("green"), F.col("r").alias("red")).join(sides, [*keys, "track_id"])
    center = F.struct(*[F.bround(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).cast("int").alias(n) for n, c in (("b", "blue"), ("g", "green"), ("r", "red"))])
    teams = rows.groupBy(*keys, "side").agg(center.alias("color"), F.count(F.lit(1)).alias("n"))
    teams = teams.withColumn("center", as_lab(F.col("color.b"), F.col("color.g"), F.col("color.r"))).withColumn("name", nearest_name(F.col("color.b"), F.col("color.g"), F.col("color.r"), KITS))
    both = teams.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.struct("color", "n", "center", "name"))).alias(f"t{s}") for s in (0, 1)]).where("t0 IS NOT NULL AND t1 IS NOT NULL")
    rows = rows.select(*keys, "track_id", "side", "lab").join(both, list(keys)).withColumn("own", F.when(F.col("side") == 0, F.col("t0.center")).otherwise(F.col("t1.center")))
    clip = Window.partitionBy(*keys)
    within = F.percentile(apart(of_lab("lab"), of_lab("own")), F.lit(0.5)).over(clip)
    separation = apart(of_lab("t0.center"), of_lab("t1.center"))
    balance = F.least("t0.n", "t1.n") / F.greatest("t0.n", "t1.n")
    rows = rows.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), separation / (separation + within + 1e-6) * balance)), 3)).where(F.col("confidence") >= SURE)
    same = F.col("t0.name") == F.col("t1.name")
    team = F.when(same, F.when(F.col("side") == 0, "team_a").otherwise("team_b")).otherwise(F.when(F.col("side") == 0, F.col("t0.name")).otherwise(F.col("t1.name")))
    return rows.select(*keys, "track_id", team.alias("team"), F.when(F.col("side") == 0, F.col("t0.color")).otherwise(F.col("t1.color")).alias("color"), "confidence")


def opening_sides(tracks: DataFrame, teams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, team): which team stands left and which right, by the medians of all their tracks' x, if these lie apart."""
    spots = tracks.select(*keys, "track_id", F.explode("positions.x").alias("x")).join(teams.select(*keys, "track_id", "team"), [*keys, "track_id"])
    middle = spots.groupBy(*keys, "team").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    pairs = middle.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", "team"))).alias("t")).where(F.size("t") == 2).where(F.col("t")[1]["m"] - F.col("t")[0]["m"] >= SIDES_APART)
    return pairs.select(*keys, F.explode(F.map_from_arrays(F.array(F.lit("left"), F.lit("right")), F.col("t.team"))).alias("side", "team"))


def share_of(positions: str, inside) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(positions, inside)), F.size(positions)), F.lit(0.0))


def goalkeepers(tracks: DataFrame, teams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, track_id, team, confidence): of the tracks without a team that stay at one goal and wear another colour the best of each side; team is null where the sides are not clear."""
    left, right = share_of("positions", lambda p: p["x"] <= OUTER), share_of("positions", lambda p: p["x"] >= 1 - OUTER)
    side = F.when((left >= right) & (left > 0), "left").when(right > 0, "right")
    kinds = teams.groupBy(*keys).agg(F.collect_set("color").alias("colors"))
    rows = tracks.join(teams.select(*keys, "track_id"), [*keys, "track_id"], "left_anti").where(F.col("duration_seconds") >= KEEPER_SECONDS).join(kinds, list(keys))
    rows = rows.withColumn("side", side).withColumn("share", F.when(side == "left", left).otherwise(right)).where(F.col("share") >= KEEPER_SHARE)
    own = as_lab(F.col("b"), F.col("g"), F.col("r"))
    rows = rows.withColumn("lab", own).withColumn("team_color", F.explode("colors")).withColumn("team_lab", as_lab(F.col("team_color.b"), F.col("team_color.g"), F.col("team_color.r")))
    rows = rows.groupBy(*keys, "track_id", "side", "share", "positions").agg(F.min(apart(of_lab("lab"), of_lab("team_lab"))).alias("look")).where(F.col("look") >= KEEPER_COLOR)
    span = F.array_max("positions.x") - F.array_min("positions.x")
    score = PLACE * F.col("share") * F.greatest(F.lit(0.0), 1 - span / MOVES) + LOOK * F.least(F.lit(1.0), F.col("look") / WHOLE)
    best = rows.withColumn("score", score).groupBy(*keys, "side").agg(F.max_by("track_id", F.struct("score", -F.col("track_id"))).alias("track_id"), F.max("score").alias("score")).where(F.col("score") >= KEEPER_SURE)
    return best.join(opening_sides(tracks, teams, keys), [*keys, "side"], "left").select(*keys, "side", "track_id", "team", F.round("score", 3).alias("confidence"))


def officials(tracks: DataFrame, teams: DataFrame, keepers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, track_id) of the tracks in no team and no goal that stay in the centre, in clips with two teams."""
    (x0, x1), (y0, y1) = CENTRE
    middle = share_of("positions", lambda p: (p["x"] > x0) & (p["x"] < x1) & (p["y"] > y0) & (p["y"] < y1))
    rows = tracks.where((F.col("duration_seconds") >= OFFICIAL_SECONDS) & (middle >= OFFICIAL_SHARE)).join(teams.select(*keys).distinct(), list(keys), "left_semi")
    taken = teams.select(*keys, "track_id").unionByName(keepers.select(*keys, "track_id"))
    return rows.join(taken, [*keys, "track_id"], "left_anti").select(*keys, "track_id")


def initialization(clips: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clips (keys, half, source_start_seconds, starts_at_kickoff) with status (complete, partial or abstained), teams, official_track_ids, goalkeepers, directions and abstention_reasons.

    Without two clear kits a clip abstains; without a kick-off at its start, or without two keepers whose teams are known, it is partial and has no directions. tracks are rows of evidence(); a clip
    without tracks abstains. Evidence, teams and keepers, which several steps read, are kept as they are found: rows of tracks, not of frames.
    """
    tracks = once(tracks)
    teams = once(kits(tracks, keys))
    keepers = once(goalkeepers(tracks, teams, keys))
    listed = lambda df, name, *columns: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))).alias(name))
    per_team = teams.groupBy(*keys, "team", "color", "confidence").agg(F.array_sort(F.collect_list("track_id")).alias("track_ids"))
    rows = clips.join(listed(per_team, "teams", "team", "color", "track_ids", "confidence"), list(keys), "left")
    rows = rows.join(listed(officials(tracks, teams, keepers, keys), "official_track_ids", "track_id"), list(keys), "left")
    rows = rows.join(listed(keepers, "goalkeepers", "side", "track_id", "team", "confidence"), list(keys), "left")
    for c in ("teams", "official_track_ids", "goalkeepers"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    known = F.size("teams") == 2
    affiliated = (F.size("goalkeepers") == 2) & F.forall("goalkeepers", lambda k: k["team"].isNotNull())
    towards = F.array_sort(F.transform("goalkeepers", lambda k: F.struct(k["team"].alias("team"), k["side"].alias("defends_goal"), F.when(k["side"] == "left", "right").otherwise("left").alias("attacks_towards"), k["confidence"].alias("confidence"))))
    rows = rows.withColumn("directions", F.when(known & F.col("starts_at_kickoff") & affiliated, towards).otherwise(F.slice(towards, 1, 0)))
    reasons = F.array_compact(F.array(F.when(~known, NO_TEAMS), F.when(known & ~F.col("starts_at_kickoff"), NO_KICKOFF), F.when(known & F.col("starts_at_kickoff") & ~affiliated, NO_KEEPERS)))
    return rows.withColumn("status", F.when(~known, "abstained").when(F.size("directions") > 0, "complete").otherwise("partial")).withColumn("abstention_reasons", reasons)


def side_switch(halves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side_switch_detected) of matches with rows of initialization() for halves 1 and 2: whether all teams changed their goal; null unless both halves know the sides of the same two teams."""
    goals = F.map_from_entries(F.transform("directions", lambda d: F.struct(d["team"], d["defends_goal"])))
    per = halves.withColumn("goals", goals).groupBy(*keys).agg(*[F.max_by("goals", F.when(F.col("half") == h, F.lit(1))).alias(f"h{h}") for h in (1, 2)])
    teams = lambda c: F.array_sort(F.map_keys(c))
    same = (F.size("h1") == 2) & (teams("h1") == teams("h2"))
    return per.select(*keys, F.when(same, F.forall(F.map_keys("h1"), lambda t: F.element_at("h1", t) != F.element_at("h2", t))).alias("side_switch_detected"))

"""Which team a player belongs to: labels from colours, votes in a time window, roles by region (2B, 2C, 2D, 2E, 2K)."""

from __future__ import annotations

import collections
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldtrace.functions import geometry as g
from fieldtrace.operators import joins


def team_label(profile: str) -> Column:
    """The label of a player's colour shares (blue, white, dark, warm, yellow; null counts as 0) under a pair of team colours."""
    blue, white, dark, warm, yellow = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("blue", "white", "dark", "warm", "yellow"))
    if profile == "red-black":
        reddish = (warm >= 0.12) | ((white >= 0.12) & (warm + yellow >= 0.12))
        return F.when((yellow >= 0.35) & (white < 0.1), "official").when(dark >= 0.3, "black").when(reddish, "red").otherwise("unknown")
    if profile == "blue-white":
        bright = F.when((blue >= 0.2) & (blue > 1.75 * white), "blue").when((white >= 0.2) & (white > 1.25 * blue), "white")
        return F.when((warm >= 0.15) | (yellow >= 0.15), "goalkeeper").when(dark >= 0.35, "official").otherwise(F.coalesce(bright, F.lit("unknown")))
    raise ValueError(f"no such pair of colours: {profile}")


def around(keys: Sequence[str], seconds: float):
    """A window over rows of the same keys at most so many seconds before or after, in milliseconds."""
    half = round(seconds * 1000)
    return Window.partitionBy(*keys).orderBy(F.round(F.col("clip_seconds") * 1000).cast("long")).rangeBetween(-half, half)


def smoothed(observations: DataFrame, keys: Sequence[str], teams: Sequence[str], seconds: float) -> DataFrame:
    """Observations whose team wins the vote of those around (weight 1 / max(0.1, ratio)^2), and those within 0.35 heights whatever the vote."""
    weight = 1 / F.pow(F.greatest(F.lit(0.1), F.col("control_ratio")), F.lit(2))
    w = around(keys, seconds)
    votes = [F.sum(F.when(F.col("team") == t, weight).otherwise(0.0)).over(w) for t in teams]
    own = F.coalesce(*[F.when(F.col("team") == t, v) for t, v in zip(teams, votes, strict=True)])
    best = F.greatest(*votes) if len(votes) > 1 else votes[0]
    return observations.withColumn("vote_", own).withColumn("best_", best).where("vote_ >= best_ OR control_ratio <= 0.35").drop("vote_", "best_")


def receiver_evidence(events: DataFrame, near: DataFrame, keys: Sequence[str], seconds: float, farthest: float = 1.8) -> DataFrame:
    """To each event (event_no, at) the team that players near the ball wear around that time: weights 1 / max(0.25, ratio)^2.

    near: rows (keys, clip_seconds, label, ratio) of players in a ball's frame; labels that are not a team are null.
    """
    some = near.where((F.col("ratio") <= farthest) & F.col("label").isNotNull()).select(*keys, F.col("clip_seconds").alias("near_seconds"), "label", "ratio")
    pairs = joins.within_band(events, some, keys, "at", "near_seconds", seconds)
    per_team = pairs.groupBy(*keys, "event_no", "label").agg(F.sum(1 / F.pow(F.greatest(F.lit(0.25), F.col("ratio")), F.lit(2))).alias("weight"))
    best = per_team.groupBy(*keys, "event_no").agg(F.max_by("label", F.struct("weight", "label")).alias("evidence_team"), F.max("weight").alias("top"), F.sum("weight").alias("support"))
    return best.select(*keys, "event_no", "evidence_team", (F.col("top") / F.col("support")).alias("share"), "support")


def local_majority(asked: DataFrame, points: DataFrame, keys: Sequence[str], seconds: float, least: int, share: float = 0.6) -> DataFrame:
    """Asked (event_no, track_id, at): the label of most of a track's points (clip_seconds, label) around that time, if there are
    `least` and it has that share of them; null labels don't count."""
    labels = points.where(F.col("label").isNotNull()).select(*keys, "track_id", F.col("clip_seconds").alias("label_seconds"), "label")
    pairs = joins.within_band(asked, labels, [*keys, "track_id"], "at", "label_seconds", seconds)
    counts = pairs.groupBy(*keys, "event_no", "track_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "event_no", "track_id").agg(F.sum("n").alias("labels"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("local_team"))
    return best.where((F.col("labels") >= least) & (F.col("top") >= share * F.col("labels"))).select(*keys, "event_no", "track_id", "local_team", "labels")


def confirmed_tracks(asked: DataFrame, points: DataFrame, keys: Sequence[str], seconds: float, least: int = 2) -> DataFrame:
    """Asked (event_no, team, at): tracks that wear the team's colours around that time at least `least` times and more often than any others together."""
    labels = points.where(F.col("label").isNotNull()).select(*keys, "track_id", F.col("clip_seconds").alias("label_seconds"), "label")
    pairs = joins.within_band(asked, labels, keys, "at", "label_seconds", seconds)
    counts = pairs.groupBy(*keys, "event_no", "track_id").agg(F.count_if(F.col("label") == F.col("team")).alias("own"), F.count(F.lit(1)).alias("labels"))
    return counts.where((F.col("own") >= least) & (2 * F.col("own") > F.col("labels"))).select(*keys, "event_no", "track_id", "own", "labels")


def near_ball_teams(players: DataFrame, balls: DataFrame, keys: Sequence[str], heights: float, teams: Sequence[str]) -> DataFrame:
    """Of each ball's frame the teams with a player's box within so many heights, and of each team the nearest track. A label (`label`) that is a team overrides `team`."""
    frame = [*keys, "source_frame"]
    worn = F.when(F.col("label").isin(*teams), F.col("label")).otherwise(F.col("team"))
    b = balls.select(*frame, F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    near = players.withColumn("worn", worn).where(F.col("worn").isin(*teams)).join(b, frame)
    near = near.withColumn("ratio", g.box_distance(F.col("ball_x"), F.col("ball_y"), g.box())).where(F.col("ratio") <= heights)
    per_team = near.groupBy(*frame, "worn").agg(F.min(F.struct("ratio", "track_id")).alias("best"))
    return per_team.groupBy(*frame).agg(F.array_join(F.array_sort(F.collect_set("worn")), ",").alias("teams"), F.max(F.when(F.col("worn") == teams[0], F.col("best.track_id"))).alias("first_team_track"), F.max(F.when(F.col("worn") == teams[1], F.col("best.track_id"))).alias("second_team_track"))


def causal_labels(points: DataFrame, keys: Sequence[str], size: int = 7) -> DataFrame:
    """At each point of a track the label most common among its last `size` known ones; the label before it stays while it is one of the most
    common, else the one of them seen last; "unknown" before the first. keys end with the track's.

    A label depends on the one before, so that the tracks of a clip are a loop over its points; what follows from one state, of which there are few, is worked out once.
    """
    kinds = {f.name: f for f in points.schema}
    schema = StructType([*[kinds[k] for k in (*keys, "source_frame")], StructField("stable_label", StringType())])
    fields = [*keys, "source_frame"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*fields, "label"], kind="stable", na_position="first").reset_index(drop=True)
        track = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        after: dict[tuple, str] = {}
        at, out = -1, []
        for t, label in zip(track.tolist(), pdf["label"].tolist(), strict=True):
            if t != at:
                at, seen, now = t, (), "unknown"
            if label != "unknown":
                seen = (*seen, label)[-size:]
            if seen:
                if (seen, now) not in after:
                    after[seen, now] = leading(seen, now)
                now = after[seen, now]
            out.append(now)
        return pdf[fields].assign(stable_label=pd.Series(out, dtype=object))

    return points.select(*fields, "label").groupBy(*(keys[:-1] or keys)).applyInPandas(fold, schema)


def leading(seen: Sequence[str], now: str) -> str:
    """The label after those seen: the one before, if none is more common, else the last of the most common."""
    count = collections.Counter(seen)
    most = max(count.values())
    return now if count[now] == most else next(s for s in reversed(seen) if count[s] == most)


def by_region(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """C14: tracks (track_id, label, foot_x, foot_y, seconds) with the team of the first region (rule_no) that they lie in, wear an eligible label for and are
    long enough for; else null. Regions are a handful of rows of configuration and are broadcast as such."""
    fits = (F.col("foot_x") >= F.col("x_min")) & (F.col("foot_x") <= F.col("x_max")) & (F.col("foot_y") >= F.col("y_min")) & (F.col("foot_y") <= F.col("y_max"))
    fits = fits & (F.col("seconds") >= F.col("least_seconds")) & F.array_contains("eligible", F.col("label"))
    keys = [c for c in tracks.columns if c in ("clip_id", "track_id")]
    first = tracks.join(F.broadcast(regions), fits).groupBy(*keys).agg(F.min_by("region_team", "rule_no").alias("keeper_team"))
    return tracks.join(first, keys, "left")


def attacking_goals(defended: DataFrame, keys: Sequence[str], teams: Sequence[str]) -> DataFrame:
    """(team, goal) that goalkeepers defend, the last by ordinal for each team: the goal that each team attacks. A team that is not told
    attacks the goal that the other defends; a clip where both would attack one goal has none."""
    last = defended.where(F.col("goal").isin("left", "right") & F.col("team").isin(*teams)).groupBy(*keys, "team").agg(F.max_by("goal", "ordinal").alias("goal"))
    own = last.groupBy(*keys).agg(*[F.max(F.when(F.col("team") == t, F.col("goal"))).alias(t) for t in teams])
    away = lambda t: F.when(F.col(t) == "left", "right").when(F.col(t) == "right", "left")
    a, b = teams
    both = own.select(*keys, F.coalesce(away(a), F.col(b)).alias(f"{a}_attacks"), F.coalesce(away(b), F.col(a)).alias(f"{b}_attacks"))
    return both.where(F.col(f"{a}_attacks") != F.col(f"{b}_attacks"))


def player_summary(points: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """D3: tracks of each label, and the median number of its players in a frame that has any player (0 where it has none)."""
    frames = points.groupBy(*keys, "source_frame").agg(*[F.count_if(F.col("label") == t).alias(t) for t in labels])
    medians = frames.groupBy(*keys).agg(*[F.round(F.percentile(t, 0.5), 2).alias(t) for t in labels])
    wide = medians.unpivot(list(keys), list(labels), "label", "median_visible")
    tracks = points.groupBy(*keys, "label").agg(F.count_distinct("track_id").alias("tracks"))
    return wide.join(tracks, [*keys, "label"], "left").select(*keys, "label", "median_visible", F.coalesce("tracks", F.lit(0)).alias("tracks"))

"""Rules that drop or collapse inferred events (2K), and small mappings of events and colours (2B, 2H)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import once
from fieldtrace.operators import joins
from fieldtrace.operators.control import EVENT, NAMES, looked_up


def comparison_type(kind: Column, shots: bool = False) -> Column:
    """The type under which a predicted event is compared with manual ones; null for those that are not."""
    out = F.when(kind.isin("pass_candidate", "restart_pass_candidate"), "completed_pass").when(kind == "turnover_candidate", "turnover")
    return out.when(kind == "shot_on_target", "shot_on_target") if shots else out


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """H6: CIE L*a*b* of 8-bit sRGB channels under D65, in 8 bits: L * 255 / 100, a + 128, b + 128, rounded."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = linear(r), linear(g), linear(b)
    x, y, z = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.round(light * 255 / 100), F.round(500 * (f(x) - f(y)) + 128), F.round(200 * (f(y) - f(z)) + 128)


def nearest_name(b: Column, g: Column, r: Column, palette: dict[str, tuple[int, int, int]]) -> Column:
    """H6: the name of the palette's colour (blue, green, red) that is nearest in L*a*b*; ties to the first name. The palette is a parameter, so it becomes constants."""
    own = lab(b, g, r)
    far = lambda bgr: sum((o - p) * (o - p) for o, p in zip(own, lab(*[F.lit(float(v)) for v in bgr]), strict=True))
    return F.array_min(F.array(*[F.struct(far(v).alias("d"), F.lit(n).alias("name")) for n, v in sorted(palette.items())]))["name"]


def without_crossing(events: DataFrame, observations: DataFrame, keys: Sequence[str], close: float = 0.5, support: float = 1.0, seconds: float = 0.4) -> DataFrame:
    """Without passes during which an opponent controls the ball: an observation within `close` heights, and another of its track within `support` heights at most `seconds` away, both strictly between
    release and completion."""
    rows = events.withColumn("event_", F.struct(*events.columns))
    passes = rows.where("event_type = 'pass_candidate' AND completion_seconds IS NOT NULL").select(*keys, "event_", (F.col("clip_seconds") + 1e-9).alias("from_"), F.col("completion_seconds").alias("until_"), F.col("team").alias("own_"))
    seen = observations.select(*keys, F.col("clip_seconds").alias("at_"), "team", "track_id", "control_ratio")
    between = joins.in_interval(seen, passes, keys, "at_", "from_", "until_", 2.0).where(F.col("team") != F.col("own_"))
    ms = round(seconds * 1000)
    near = Window.partitionBy("event_", "team", "track_id").orderBy(F.round(F.col("at_") * 1000).cast("long")).rangeBetween(-ms, ms)
    backed = between.withColumn("n_", F.count_if(F.col("control_ratio") <= support).over(near) - (F.col("control_ratio") <= support).cast("int"))
    crossed = backed.where((F.col("control_ratio") <= close) & (F.col("n_") > 0)).select("event_").distinct()
    return rows.join(crossed, "event_", "left_anti").select(*events.columns)


def without_transient(events: DataFrame, spells: DataFrame, motion: DataFrame, observations: DataFrame, keys: Sequence[str], sure: float = 0.75, close: float = 1.0, turn: float = -0.25) -> DataFrame:
    """Without events below `sure` whose receiver's spell, which starts at their completion, has neither an observation within `close` heights nor a turn of the ball (cosine at most
    `turn`) at one of its frames. spells: (start_seconds, end_seconds, track_id, spell_no); observations carry spell_no."""
    turned = motion.where(F.col("turn_cosine") <= turn).select(*keys, "source_frame", F.lit(True).alias("turned_")).distinct()
    proof = observations.join(turned, [*keys, "source_frame"], "left").groupBy(*keys, "spell_no").agg(F.bool_or((F.col("control_ratio") <= close) | F.coalesce("turned_", F.lit(False))).alias("proof_"))
    weak = spells.join(proof, [*keys, "spell_no"]).where(~F.col("proof_")).select(*keys, F.col("track_id").alias("to_track"), F.round("start_seconds", 3).alias("completion_seconds"), F.lit(True).alias("weak_")).distinct()
    rows = events.withColumn("completion_", F.round("completion_seconds", 3))
    rows = rows.join(weak.withColumnRenamed("completion_seconds", "completion_"), [*keys, "to_track", "completion_"], "left")
    return rows.where(~(F.coalesce("weak_", F.lit(False)) & (F.col("confidence") < sure))).select(*events.columns)


def one_reception(events: DataFrame, keys: Sequence[str], seconds: float = 0.5) -> DataFrame:
    """Of passes of one sender and team that complete within `seconds` of one kept before the more confident stays (the earlier one if they are equal). A fold over a clip's events in order of completion."""
    order = F.coalesce("completion_seconds", "clip_seconds")
    kind = f"struct<at:double,e:{EVENT}>"
    listed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.struct(*NAMES).alias("e")).cast(kind))).alias("all_"))

    def step(acc: Column, x: Column) -> Column:
        e = x["e"]
        rival = lambda p: F.coalesce((e["event_type"] == "pass_candidate") & (p["event_type"] == "pass_candidate") & (e["team"] == p["team"]) & (e["from_track"] == p["from_track"]) & (F.abs(e["completion_seconds"] - p["completion_seconds"]) <= seconds), F.lit(False))
        better = lambda at: F.transform(acc, lambda p, k: F.when((k == at - 1) & (e["confidence"] > p["confidence"]), e).otherwise(p))
        return looked_up(F.array_position(F.transform(acc, rival), F.lit(True)), lambda at: F.when(at == 0, F.concat(acc, F.array(e))).otherwise(better(at)).cast(f"array<{EVENT}>"))

    return listed.select(*keys, F.explode(F.aggregate("all_", F.array().cast(f"array<{EVENT}>"), step)).alias("e")).select(*keys, "e.*")


def without_unreturned(events: DataFrame, keys: Sequence[str], seconds: float = 3.0) -> DataFrame:
    """Without passes that complete before they are released, unless the receiver passed to the sender, for the same team, at most `seconds` before."""
    odd = (F.col("event_type") == "pass_candidate") & (F.col("completion_seconds") < F.col("clip_seconds"))
    back = events.where("event_type = 'pass_candidate'").select(*keys, "team", F.col("from_track").alias("to_track"), F.col("to_track").alias("from_track"), F.col("completion_seconds").alias("back_"))
    rows = events.withColumn("odd_", F.coalesce(odd, F.lit(False)))
    returned = joins.exists_within(rows.where("odd_").withColumn("before_", -F.col("clip_seconds")), back.withColumn("back_", -F.col("back_")), [*keys, "team", "from_track", "to_track"], "before_", "back_", seconds)
    return rows.where("NOT odd_").select(*events.columns).unionByName(returned.select(*events.columns))


def without_startup(events: DataFrame, keys: Sequence[str], low: float = 0.55, gap: float = 4.0) -> DataFrame:
    """Without the passes below `low` that open a clip, if the first other event starts at least `gap` seconds after the last of them completes."""
    w = Window.partitionBy(*keys)
    trusted = (F.col("confidence") >= low) | (F.col("event_type") != "pass_candidate")
    rows = events.withColumn("first_", F.min(F.when(trusted, F.col("clip_seconds"))).over(w))
    opening = F.col("clip_seconds") < F.col("first_")
    rows = rows.withColumn("done_", F.max(F.when(opening, F.coalesce("completion_seconds", "clip_seconds"))).over(w))
    return rows.where(~F.coalesce(opening & (F.col("first_") - F.col("done_") >= gap), F.lit(False))).select(*events.columns)


def without_handoffs(events: DataFrame, boxes: DataFrame, keys: Sequence[str], before: float = 0.41, overlap: float = 0.9) -> DataFrame:
    """Events without passes between two tracks of one player: in a frame from `before` seconds before the pass to its completion the boxes (track_id, source_frame, clip_seconds, team, x1 .. y2) of sender and receiver cover each other (by `overlap` of the
    smaller), and the sender's track ends where the receiver's begins, or the receiver wears another team there. Events and boxes, which several steps read, are computed once."""
    events, boxes = once(events), once(boxes.select(*keys, "track_id", "source_frame", "clip_seconds", "team", "x1", "y1", "x2", "y2"))
    passes = events.where("event_type = 'pass_candidate' AND team IS NOT NULL AND completion_seconds IS NOT NULL AND from_track IS NOT NULL AND to_track IS NOT NULL").distinct()
    spans = passes.withColumn("event_", F.struct(*events.columns)).select(*keys, "from_track", "to_track", F.col("team").alias("event_team"), "event_", (F.col("clip_seconds") - before).alias("lo_"), (F.col("completion_seconds") + 1e-9).alias("hi_")).withColumn("until_", F.col("hi_") + 1e-9)
    bounds = boxes.groupBy(*keys, "track_id").agg(F.min("source_frame").alias("first_"), F.max("source_frame").alias("last_"))
    corners = ["x1", "y1", "x2", "y2"]
    mine = boxes.select(*keys, F.col("track_id").alias("to_track"), "source_frame", F.col("clip_seconds").alias("at_"), F.col("team").alias("worn_"), *[F.col(c).alias(f"r_{c}") for c in corners])
    near = joins.in_interval(mine, spans, [*keys, "to_track"], "at_", "lo_", "until_", 4.0).where(F.col("at_") <= F.col("hi_"))
    theirs = boxes.select(*keys, F.col("track_id").alias("from_track"), "source_frame", *[F.col(c).alias(f"s_{c}") for c in corners])
    both = near.join(theirs, [*keys, "from_track", "source_frame"])
    a, b = (g.box(f"{n}_") for n in "rs")
    area = lambda x: F.greatest(F.lit(1.0), (x[2] - x[0]) * (x[3] - x[1]))
    both = both.where(g.overlap(a, b) / F.least(area(a), area(b)) >= overlap)
    both = both.join(bounds.select(*keys, F.col("track_id").alias("from_track"), "last_"), [*keys, "from_track"]).join(bounds.select(*keys, F.col("track_id").alias("to_track"), "first_"), [*keys, "to_track"])
    handed = (F.col("last_") == F.col("source_frame")) & (F.col("first_") == F.col("source_frame"))
    other = F.coalesce(~F.col("worn_").isin("unknown") & (F.col("worn_") != F.col("event_team")), F.lit(False))
    gone = both.where(handed | other).select("event_").distinct()
    return events.withColumn("event_", F.struct(*events.columns)).join(gone, "event_", "left_anti").select(*events.columns)

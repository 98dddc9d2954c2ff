"""Top-k, set operations, review history and jobs, evaluation (2F, 2G, 2M, 2O)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.storage import once, spread
from fieldtrace.operators import joins


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the planner limits each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def differences(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """Keys missing from the stream's result and unexpected ones in it, counted with repeats."""
    keys = batch.columns
    sides = batch.withColumn("n", F.lit(1)).unionByName(stream.withColumn("n", F.lit(-1))).groupBy(*keys).agg(F.sum("n").alias("n"))
    return sides.where("n != 0").select(*keys, F.when(F.col("n") > 0, "missing").otherwise("unexpected").alias("side"), F.abs("n").alias("n"))


def event_key(seconds: str = "clip_seconds") -> Column:
    """Type, seconds to three decimals, team and tracks in one key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(":", F.col("event_type"), F.format_string("%.3f", seconds), part("team"), part("from_track"), part("to_track"))


def revisions(log: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Each entry's revision number under its key, in the order of the log."""
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def latest(log: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """O2, O3: the last entry of each key, by an aggregate that combines before the shuffle."""
    return log.groupBy(*by).agg(F.max_by(F.struct(*values), order).alias("last"), F.count(F.lit(1)).alias("revisions")).select(*by, "revisions", "last.*")


def claimable(jobs: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The first n open jobs of each workflow: highest priority, then oldest."""
    return top(jobs.where("status = 'O'"), by, [F.asc("priority_rank"), F.asc("created_at"), F.asc("job_id")], n)


def status_counts(jobs: DataFrame, by: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Jobs of each status, 0 where there are none."""
    return jobs.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses])


def aligned(manual: DataFrame, predicted: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """One-to-one matches in time order of equal type and team within `tolerance`: as many as possible, then with the least total difference,
    then with the smallest places. A clip's events are few; each clip is a small dynamic program, and clips run in parallel.
    """
    columns = [*keys, "event_no", "seconds", "event_type", "team"]
    both = manual.select(*columns, F.lit(0).alias("side")).unionByName(predicted.select(*columns, F.lit(1).alias("side")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stretches of a clip that are farther apart than the tolerance share no match, and each is a small dynamic program."""
        pdf = pdf.sort_values(["seconds", "event_no"])
        seconds, side, no = (pdf[c].to_numpy() for c in ("seconds", "side", "event_no"))
        kind = pdf.groupby(["event_type", "team"], sort=False).ngroup().to_numpy()  # -1 where one is null, which equals nothing
        out = []
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(~(np.diff(seconds) <= tolerance)) + 1):
            a, b = part[side[part] == 0], part[side[part] == 1]
            fits = (kind[a][:, None] == kind[b]) & (kind[a] >= 0)[:, None]
            if fits.any():
                gap = np.abs(seconds[a][:, None] - seconds[b])
                out += [(no[a[i]], no[b[j]], gap[i, j]) for i, j in paired(gap, fits & (gap <= tolerance))]
        found = pd.DataFrame(out, columns=["manual_no", "predicted_no", "difference"])
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "manual_no", "predicted_no", "difference"]]

    kinds = ", ".join(f"{k} {manual.schema[k].dataType.simpleString()}" for k in keys)
    return spread(both, keys).groupBy(*keys).applyInPandas(match, f"{kinds}, manual_no long, predicted_no long, difference double")


def paired(gap: np.ndarray, fits: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns in order, matched where they fit: as many as possible, then with the least total gap, then with the smallest places."""
    # best[i][j] of what follows: matches first, then the least total difference. Cells of an antidiagonal depend on the next two only.
    n, m = fits.shape
    count, cost = np.zeros((n + 1, m + 1), np.int64), np.zeros((n + 1, m + 1))
    for d in range(n + m - 2, -1, -1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        best, price = count[i + 1, j], cost[i + 1, j]
        for c, p, ok in ((count[i, j + 1], cost[i, j + 1], True), (count[i + 1, j + 1] + 1, cost[i + 1, j + 1] + gap[i, j], fits[i, j])):
            better = ok & ((c > best) | ((c == best) & (p < price)))
            best, price = np.where(better, c, best), np.where(better, p, price)
        count[i, j], cost[i, j] = best, price
    out, i, j = [], 0, 0
    while i < n and j < m:
        if fits[i, j] and (count[i, j], cost[i, j]) == (count[i + 1, j + 1] + 1, cost[i + 1, j + 1] + gap[i, j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif (count[i, j + 1], cost[i, j + 1]) == (count[i, j], cost[i, j]):
            j += 1
        else:
            i += 1
    return out


def event_comparison(manual: DataFrame, predicted: DataFrame, keys: Sequence[str], strict: float, review: float, teams: Sequence[str], types: Sequence[str]) -> DataFrame:
    """M1: strict alignment, then one of the rest with the wider tolerance; one row for each finding, told by `kind`.

    match, review_match; unmatched_manual, unmatched_predicted (after the strict one); unresolved_manual (after both); nearby_disagreement: an unmatched manual event
    whose nearest prediction of any type or team is within the strict tolerance; count: events of a team and type, 0 where there are none. Differences are
    predicted less manual, to three decimals. Events and both alignments are computed once and kept, for all kinds read them. An event_no names one event of its side in a clip.
    """
    sides = {"manual_no": manual, "predicted_no": predicted}
    event = [*keys, "event_no", "seconds", "event_type", "team"]
    named = {no: df.select(*keys, F.col("event_no").alias(no), F.col("seconds").alias(f"{no}_s"), "event_type", "team") for no, df in sides.items()}
    rest = lambda no, pairs: sides[no].select(*event).join(pairs.select(*keys, F.col(no).alias("event_no")), [*keys, "event_no"], "left_anti").select(*event)
    manual, predicted = once(manual), once(predicted)
    found = once(aligned(manual, predicted, keys, strict))
    left = {no: rest(no, found) for no in sides}
    left = {no: once(df) for no, df in left.items()}
    later = once(aligned(left["manual_no"], left["predicted_no"], keys, review))
    unresolved = left["manual_no"].join(later.select(*keys, F.col("manual_no").alias("event_no")), [*keys, "event_no"], "left_anti").select(*event)
    near = joins.within_band(left["manual_no"].withColumnsRenamed({"event_no": "manual_no"}), predicted.select(*keys, F.col("event_no").alias("predicted_no"), F.col("seconds").alias("other_seconds")), keys, "seconds", "other_seconds", strict)
    gap = F.col("other_seconds") - F.col("seconds")
    near = near.groupBy(*keys, "manual_no", "event_type", "team").agg(F.min_by(F.struct("predicted_no", F.round(gap, 3).alias("difference")), F.struct(F.abs(gap), "other_seconds", "predicted_no")).alias("near"))

    def row(df: DataFrame, kind: str, **given: Column) -> DataFrame:
        kinds = {"manual_no": "long", "predicted_no": "long", "difference": "double", "n_manual": "long", "n_predicted": "long", "n_matched": "long", "n_review": "long"}
        return df.select(*keys, F.lit(kind).alias("kind"), "team", "event_type", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def pairs(df: DataFrame, kind: str) -> DataFrame:
        both = df.select(*keys, "manual_no", "predicted_no").join(named["manual_no"], [*keys, "manual_no"]).join(named["predicted_no"].drop("event_type", "team"), [*keys, "predicted_no"])
        return row(both, kind, manual_no=F.col("manual_no"), predicted_no=F.col("predicted_no"), difference=F.round(F.col("predicted_no_s") - F.col("manual_no_s"), 3))

    matches, reviewed = pairs(found, "match"), pairs(later, "review_match")
    # Each event counts once on its side; zero rows of all teams and types are there anyway.
    clips = manual.select(*keys).unionByName(predicted.select(*keys)).distinct()
    grid = clips.withColumn("team", F.explode(F.array(*map(F.lit, teams)))).withColumn("event_type", F.explode(F.array(*map(F.lit, types))))
    sources = {"n_manual": manual, "n_predicted": predicted, "n_matched": matches, "n_review": reviewed}
    marked = grid.withColumn("side", F.lit(None).cast("string"))
    for side, df in sources.items():
        marked = marked.unionByName(df.select(*keys, "team", "event_type", F.lit(side).alias("side")))
    counts = marked.groupBy(*keys, "team", "event_type").agg(*[F.count_if(F.col("side") == c).alias(c) for c in sources])
    out = matches.unionByName(reviewed)
    for df, kind, no in ((left["manual_no"], "unmatched_manual", "manual_no"), (left["predicted_no"], "unmatched_predicted", "predicted_no"), (unresolved, "unresolved_manual", "manual_no")):
        out = out.unionByName(row(df, kind, **{no: F.col("event_no")}))
    out = out.unionByName(row(near, "nearby_disagreement", manual_no=F.col("manual_no"), predicted_no=F.col("near.predicted_no"), difference=F.col("near.difference")))
    return out.unionByName(row(counts, "count", **{c: F.col(c) for c in sources}))

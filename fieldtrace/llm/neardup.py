"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import components, cut, packed, task_groups, unpacked
from fieldtrace.llm.vectors import usable

ADDED = ["n_links", "component_id", "kept"]
#: Rows of the sample that the principal axes are fitted on, leading dimensions of the grid, vectors of a block and of a leaf.
SAMPLE, LEADING, BLOCK, LEAF = 8192, 8, 2048, 256
#: Leading dimensions whose cells are the key under which blocks meet.
KEYED = 3
BLOCKS = "block long, label {label}, dim int, lo array<double>, hi array<double>, cell_lo array<long>, cell_hi array<long>, reps binary, counts binary, vectors binary"
#: Room for rounding where blocks or pairs are ruled out; exact cosines decide.
SLACK = 1e-6


class Join:
    """Recursive join of two sequences in grid order."""

    def __init__(self, a: tuple, b: tuple, same: bool, least: float) -> None:
        (self.ra, self.ca, self.xa), (self.rb, self.cb, self.xb), self.same, self.least = a, b, same, least
        self.na, self.nb = np.sqrt((self.xa**2).sum(axis=1)), np.sqrt((self.xb**2).sum(axis=1))
        self.ua, self.ub = self.xa / self.na[:, None], self.xb / self.nb[:, None]
        self.far = 2 * (1 - least) + SLACK
        self.links_a, self.links_b = np.zeros(len(self.ra), np.int64), np.zeros(len(self.rb), np.int64)
        self.root = np.arange(len(self.ra) + (0 if same else len(self.rb)))

    def run(self, pa: np.ndarray, pb: np.ndarray) -> None:
        self.pa, self.pb = pa, pb
        self.step(0, len(self.ra), 0, len(self.rb))

    def step(self, a0: int, a1: int, b0: int, b1: int) -> None:
        alo, ahi, blo, bhi = self.pa[a0:a1].min(0), self.pa[a0:a1].max(0), self.pb[b0:b1].min(0), self.pb[b0:b1].max(0)
        if (np.maximum(0, np.maximum(alo - bhi, blo - ahi)) ** 2).sum() > self.far:
            return
        if max(a1 - a0, b1 - b0) <= LEAF:
            return self.leaf(a0, a1, b0, b1)
        if self.same and a0 == b0:
            mid = (a0 + a1) // 2
            self.step(a0, mid, a0, mid)
            self.step(a0, mid, mid, a1)
            self.step(mid, a1, mid, a1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self.step(a0, mid, b0, b1)
            self.step(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self.step(a0, a1, b0, mid)
            self.step(a0, a1, mid, b1)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        i, j = np.nonzero(self.ua[a0:a1] @ self.ub[b0:b1].T >= self.least - SLACK)
        i, j = i + a0, j + b0
        if self.same:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", self.xa[i], self.xb[j]) / (self.na[i] * self.nb[j]) >= self.least
        i, j = i[exact], j[exact]
        if not len(i):
            return
        np.add.at(self.links_a, i, self.cb[j])
        np.add.at(self.links_a if self.same else self.links_b, j, self.ca[i])
        if not self.same:
            j = j + len(self.ra)
        while True:
            low = np.minimum(self.root[i], self.root[j])
            if (low == self.root[i]).all() and (low == self.root[j]).all():
                return
            np.minimum.at(self.root, i, low)
            np.minimum.at(self.root, j, low)

    def result(self) -> pd.DataFrame:
        reps, links = (self.ra, self.links_a) if self.same else (np.append(self.ra, self.rb), np.append(self.links_a, self.links_b))
        root = self.root
        while (root[root] != root).any():
            root = root[root]
        some = links > 0
        return pd.DataFrame({"rep": reps[some], "links": links[some], "root": reps[root[some]]})


def link(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) plus n_links, component_id, kept: links join vectors with one label and a cosine >= least.

    Equal vectors of a label are one class, linked among themselves by count, and only the classes are compared: unit
    vectors are sorted by the cells, sqrt(2 - 2 * least) wide, of their leading principal coordinates, cut into blocks, and blocks whose
    boxes are near enough are joined recursively. A block pair returns a row for each vector that it links: the number of links and
    one edge of a spanning forest. The axes are fitted on at most 8,192 vectors; they steer the pruning only.

    Vectors that are null, empty, zero or hold null or non-finite components, or that have no label, have 0 links and are
    their own component; a null vec_id has a null component and is not kept. Vectors of different lengths never link.
    Repeated rows count one by one. Columns of the table named like an added column are replaced. An empty table stays empty.
    """
    rows = packed(vectors, vec_id=F.col("vec_id"), label=F.col("label"), embedding=F.when(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("embedding")))
    classes = cut(rows.where("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")))
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    axes: dict[int, np.ndarray] = {}
    for dim in {len(x) for x in sample}:
        x = np.stack([v for v in sample if len(v) == dim]).astype(float)
        x /= np.sqrt((x**2).sum(axis=1))[:, None]
        axes[dim] = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))[1][:, ::-1][:, :LEADING]
    width = math.sqrt(2 - 2 * least)
    label, kind = (vectors.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    number = np.float64 if "double" in kind else np.float32

    def spot(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        x = x / np.sqrt((x**2).sum(axis=1))[:, None]
        return x @ axes[x.shape[1]] if x.shape[1] in axes else x[:, :LEADING]

    def with_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cells = [None] * len(pdf)
            for dim in pdf["dim"].unique():
                at = np.flatnonzero(pdf["dim"] == dim)
                for k, c in zip(at, np.floor(spot(np.stack(pdf["embedding"].iloc[at].to_numpy())) / width).astype(int), strict=True):
                    cells[k] = c
            yield pdf.assign(cells=cells)

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = 0, pd.DataFrame()
        for pdf in (*frames, None):
            held = pd.concat([held, pdf]) if pdf is not None else held
            done = pdf is None
            while len(held) > BLOCK or done and len(held):
                same = ((held["label"] == held["label"].iloc[0]) & (held["dim"] == held["dim"].iloc[0])).to_numpy()[:BLOCK]
                n = len(same) if same.all() else int(np.argmin(same))
                own, held = held.iloc[:n], held.iloc[n:]
                x = np.stack(own["embedding"].to_numpy())
                p = spot(x)
                yield pd.DataFrame({
                    "block": [TaskContext.get().partitionId() << 32 | made], "label": [own["label"].iloc[0]], "dim": [own["dim"].iloc[0]], "lo": [p.min(0)], "hi": [p.max(0)],
                    "cell_lo": [np.floor(p.min(0)[:KEYED] / width - SLACK).astype(np.int64)], "cell_hi": [np.floor(p.max(0)[:KEYED] / width + SLACK).astype(np.int64)],
                    "reps": [own["rep"].to_numpy(np.int64).tobytes()], "counts": [own["n"].to_numpy(np.int64).tobytes()], "vectors": [x.astype(number).tobytes()],
                })
                made += 1

    celled = classes.mapInPandas(with_cells, f"label {label}, embedding {kind}, rep long, n long, dim int, cells array<int>")
    parts = max(1, math.ceil(classes.count() / (4 * BLOCK)))
    ordered = cut(celled).repartitionByRange(parts, "label", "dim", "cells", "rep").sortWithinPartitions("label", "dim", "cells", "rep")
    stored = cut(ordered.mapInPandas(blocks, BLOCKS.format(label=label)))

    # A block stands in each cell of the leading dimensions that it touches, and in the next one of each; two blocks meet in one cell only.
    near = stored.select("block", "label", "dim", "lo", "hi", "cell_lo", "cell_hi")
    for k in range(KEYED):
        near = near.withColumn(f"cell_{k}", F.explode(F.sequence(F.coalesce(F.get("cell_lo", k), F.lit(0)), F.coalesce(F.get("cell_hi", k), F.lit(0)) + 1)))
    near = near.withColumn("cell", F.array(*[f"cell_{k}" for k in range(KEYED)]))
    a, b = near.alias("a"), near.alias("b")
    apart = F.aggregate(
        F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)), F.lit(0.0), lambda s, x: s + x * x
    )
    meet = F.array(*[F.greatest(*[F.coalesce(F.get(f"{s}.cell_lo", k), F.lit(0)) for s in "ab"]) for k in range(KEYED)])
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", "cell")]
    pairs = a.join(b, [*same, F.col("a.block") <= F.col("b.block"), F.col("a.cell") == meet, apart <= width * width + SLACK])
    pairs = pairs.select(F.col("a.block").alias("left"), F.col("b.block").alias("right"))
    sides = [stored.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("reps", "counts", "vectors")]) for s in ("left", "right")]
    pairs = pairs.join(sides[0], "left").join(sides[1], "right")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                a, b = ((np.frombuffer(i, np.int64), np.frombuffer(n, np.int64), np.frombuffer(x, number)) for i, n, x in ((r.reps_left, r.counts_left, r.vectors_left), (r.reps_right, r.counts_right, r.vectors_right)))
                a, b = ((*s[:2], s[2].reshape(len(s[0]), -1).astype(np.float64)) for s in (a, b))
                task = Join(a, b, r.left == r.right, least)
                task.run(spot(a[2]), spot(b[2]))
                yield task.result()

    spread = pairs.repartition(task_groups(vectors.sparkSession), "left", "right")
    found = cut(spread.mapInPandas(join, "rep long, links long, root long"))
    grouped = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "rep", "left").join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(by_class, ["label", "embedding"], "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0))).withColumn("component_id", F.coalesce("component_id", F.col("vec_id")))
    return unpacked(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), vectors.columns, ADDED)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of one label at a cosine of 0.98."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")).select("vec_id", *ADDED)

"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import cut
from fieldtrace.llm.vectors import usable

GRAPH = "shard long, dim int, places long, vectors binary, sizes array<int>, links binary, member_ends binary, members binary"
QUERIES = "dim int, block long, ids binary, vectors binary"
#: Best unexpanded nodes that a search step follows at once; queries searched together, and cells of the table of what each has seen.
AT_ONCE, TOGETHER, SEEN = 4, 512, 1 << 25


def lifted(x: np.ndarray) -> np.ndarray:
    """One more component makes all lengths equal, so that the largest inner product is the nearest point."""
    lengths = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))[:, None]]).astype(np.float32)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all rows of q in lockstep: ids and inner products of the `width` best found, best first."""
    rows = len(q)
    seen = np.full((rows, len(links)), -1, np.int32)
    ids, sims = np.full((rows, width), -1, np.int64), np.full((rows, width), -np.inf, np.float32)
    tested = np.ones((rows, width), bool)
    fresh_ids = entry
    each = np.arange(rows)[:, None]
    while True:
        fresh = fresh_ids >= 0
        fresh &= seen[each, np.maximum(fresh_ids, 0)] < 0
        r, c = np.nonzero(fresh)
        seen[r, fresh_ids[r, c]] = c
        once = seen[r, fresh_ids[r, c]] == c
        r, c = r[once], c[once]
        new = np.full(fresh_ids.shape, -np.inf, np.float32)
        if len(r):
            new[r, c] = np.einsum("ij,ij->i", x[fresh_ids[r, c]], q[r])
        all_sims = np.hstack([sims, new])
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims = np.take_along_axis(all_sims, best, 1)
        ids = np.take_along_axis(np.hstack([ids, fresh_ids]), best, 1)
        tested = np.take_along_axis(np.hstack([tested, ~np.isfinite(new)]), best, 1) | ~np.isfinite(sims)
        pick = np.argsort(tested, axis=1, kind="stable")[:, :AT_ONCE]
        live = ~np.take_along_axis(tested, pick, 1)
        if not live.any():
            return np.where(np.isfinite(sims), ids, -1), sims
        np.put_along_axis(tested, pick, True, 1)
        at = np.where(live, np.take_along_axis(ids, pick, 1), -1)
        fresh_ids = np.where((at >= 0)[:, :, None], links[np.maximum(at, 0)], -1).reshape(rows, -1).astype(np.int64)


def spread_out(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates of each row, best first, `most` that are nearer to the row than to those chosen before; then the best of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = (ids >= 0) & np.isfinite(sims) & (ids != own[:, None])
    valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    points = x[np.maximum(ids, 0)]
    between = points @ points.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        chosen[:, j] = valid[:, j] & (chosen.sum(axis=1) < most) & ~(chosen & (between[:, j, :] > sims[:, j, None])).any(axis=1)
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(ids, pick, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Nodes stand by falling level, so that a layer's nodes are the first ones; links[l] is an array of its nodes' neighbours."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray]) -> None:
        self.x, self.links = lifted(x), links

    @classmethod
    def built(cls, x: np.ndarray, degree: int, width: int) -> Graph:
        n, log = len(x), 1 / math.log(degree)
        # Node i of n is on level l if i < n / degree ** l: the levels of a draw, in order.
        sizes = [n]
        while sizes[-1] * math.exp(-1 / log) >= 2 * degree:
            sizes.append(int(sizes[-1] * math.exp(-1 / log)))
        g = cls(x, [np.full((s, 2 * degree if k == 0 else degree), -1, np.int32) for k, s in enumerate(sizes)])
        start = 1
        while start < n:
            end = min(n, start + min(start, TOGETHER, max(64, SEEN // n)))
            g.insert(start, end, width)
            start = end
        return g

    def insert(self, start: int, end: int, width: int) -> None:
        new = np.arange(start, end)
        q = self.x[start:end]
        entry = np.zeros((len(new), 1), np.int64)
        for links in reversed(self.links):
            inside = new < len(links)
            found, sims = beam(self.x, links[: min(start, len(links))], q, entry, width if inside.any() else 4)
            entry = found[:, : 8 if inside.any() else 4]
            if not inside.any():
                continue
            own = new[inside]
            among = q[inside] @ q[inside].T
            ids = np.hstack([found[inside], np.broadcast_to(own, among.shape)])
            near = np.hstack([sims[inside], among])
            if near.shape[1] > 2 * width:
                best = np.argpartition(-near, 2 * width, axis=1)[:, : 2 * width]
                ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
            chosen = spread_out(self.x, own, ids, near, links.shape[1] // 2)
            links[own, : chosen.shape[1]] = chosen
            self.link_back(links, np.repeat(own, chosen.shape[1]), chosen.ravel())

    def link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        nodes, first = np.unique(target, return_index=True)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        take = rank < links.shape[1]
        at = np.searchsorted(nodes, target[take])
        ids = np.full((len(nodes), links.shape[1] + int(rank[take].max(initial=-1)) + 1), -1, np.int64)
        ids[:, : links.shape[1]] = links[nodes]
        ids[at, links.shape[1] + rank[take]] = source[take]
        near = np.einsum("ijk,ik->ij", self.x[np.maximum(ids, 0)], self.x[nodes])
        near[ids < 0] = -np.inf
        # A node linked twice stands beside itself in the order of nearness.
        for lo in range(0, len(nodes), TOGETHER):
            some = slice(lo, lo + TOGETHER)
            order = np.lexsort((ids[some], -near[some]), axis=1)
            links[nodes[some]] = spread_out(self.x, nodes[some], np.take_along_axis(ids[some], order, 1), np.take_along_axis(near[some], order, 1), links.shape[1])

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        q = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for k, links in reversed(list(enumerate(self.links))):
            entry = beam(self.x, links, q, entry, width if k == 0 else 8)[0]
        return entry


def number_of(kind: str) -> type:
    """The type that vectors of a column are stored in, so that none loses digits."""
    return np.float32 if "float" in kind else np.float64


def index(vectors: DataFrame, shard_rows: int = 16_384, degree: int = 16, width: int = 80) -> DataFrame:
    """The graphs of vectors (vec_id, embedding), a row a shard: equal vectors are one node with the list of their ids.

    Rows are dealt to shards of about shard_rows by a hash of vec_id, so that copies of one vector spread over all. Each query meets
    each shard, so that larger ones save searches; but a graph of 51,282 nodes took longer to build than four of a quarter, and lost recall. Vectors are stored as they are; the graph is built and searched in single precision. Null
    vec_ids and vectors that are null, empty, zero or hold null or non-finite components are left out; rows that
    repeat a vec_id are members each, with their own vectors. Vectors of different lengths never meet. An empty table gives no graph.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    number = number_of(vectors.schema["embedding"].dataType.simpleString())

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy()).astype(number) + number(0)
        unique, inverse = np.unique(x.view([("", number)] * x.shape[1]).ravel(), return_inverse=True)
        shuffle = np.random.default_rng(len(unique)).permutation(len(unique))
        place = np.argsort(shuffle)[inverse.ravel()]
        order = np.argsort(place, kind="stable")
        nodes = unique.view(number).reshape(len(unique), -1)[shuffle]
        graph = Graph.built(nodes.astype(np.float32), degree, width)
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "dim": [x.shape[1]], "places": [len(nodes)], "vectors": [nodes.tobytes()], "sizes": [[len(a) for a in graph.links]],
            "links": [b"".join(a.tobytes() for a in graph.links)], "member_ends": [np.cumsum(np.bincount(place)).astype(np.int64).tobytes()], "members": [pdf["vec_id"].to_numpy(np.int64)[order].tobytes()],
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("dim", F.size("embedding"))
    return dealt.groupBy("shard", "dim").applyInPandas(build, GRAPH)


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, width: int = 192, block: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (query_id, embedding): the k found in all shards with the largest inner
    products in double precision, best first, ties to the smaller vec_id, rows with the query's own id left out. Of queries with one query_id the smallest vector counts.

    Queries are packed in blocks of about 50,000, a row each, and a block meets each graph in a task of its own, which holds the two. Queries with
    vectors that index() leaves out give no rows; with fewer than k candidates, those there are. Embeddings of both tables have one type.
    """
    number = number_of(queries.schema["embedding"].dataType.simpleString())
    graphs, queries = cut(graphs), queries.where(F.col("query_id").isNotNull() & usable("embedding")).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    queries = cut(queries.withColumn("dim", F.size("embedding")))
    blocks = max(1, math.ceil(queries.count() / block))
    shards = graphs.agg(F.max("shard")).first()[0] or 0

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(number)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    packed = cut(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(pack, QUERIES))
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards).cast("long"))))
    stored = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))))

    def find(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in stored.itertuples() if len(asked) else ():
            nodes = np.frombuffer(r.vectors, number).reshape(r.places, -1)
            ends, members = np.frombuffer(r.member_ends, np.int64), np.frombuffer(r.members, np.int64)
            starts = np.append(0, ends[:-1])
            most = int(np.unique(members, return_counts=True)[1].max())
            flat, links, at = np.frombuffer(r.links, np.int32), [], 0
            for level, n in enumerate(r.sizes):
                wide = 2 * degree_of(r.sizes, len(flat)) if level == 0 else degree_of(r.sizes, len(flat))
                links.append(flat[at : at + n * wide].reshape(n, wide))
                at += n * wide
            graph = Graph(nodes.astype(np.float32), links)
            ids = np.frombuffer(asked["ids"].iloc[0], np.int64)
            given = np.frombuffer(asked["vectors"].iloc[0], number).reshape(len(ids), -1)
            step = max(1, min(TOGETHER, SEEN // max(1, len(nodes))))
            for lo in range(0, len(ids), step):
                q, own = given[lo : lo + step].astype(np.float64), ids[lo : lo + step]
                found = graph.search(q, max(width, 2 * k))
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                score = np.einsum("ij,ij->i", q[row], nodes[node].astype(np.float64))
                counts = np.minimum(ends[node] - starts[node], k + most)  # of equal vectors the smallest ids come first
                row, score = np.repeat(row, counts), np.repeat(score, counts)
                member = members[np.repeat(starts[node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                keep = member != own[row]
                row, score, member = row[keep], score[keep], member[keep]
                order = np.lexsort((member, -score, row))
                row, score, member = row[order], score[order], member[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                parts.append(pd.DataFrame({"query_id": own[row[keep]], "vec_id": member[keep], "score": score[keep]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = asked.groupBy("shard", "dim", "block").cogroup(stored.groupBy("shard", "dim", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def degree_of(sizes: list[int], links: int) -> int:
    """Neighbours of a node in upper layers; the lowest layer has twice as many."""
    return links // (int(sum(sizes)) + int(sizes[0]))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(index(vectors), vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))

"""Packed exchange: what numpy makes of many documents travels as one binary row for each receiving group.

A row is (route, target, blob); the blob holds records of one numpy type. Receivers are as many as the bytes of
the texts ask for (Survey), so that a receiver's share stays the same as data grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import cut, task_groups, tidy, trim

BLOBS = "route int, target int, blob binary"
ARROW = pa.schema([("route", pa.int32()), ("target", pa.int32()), ("blob", pa.binary())])
#: Routes of rows: to a group of keys (or of hashed windows), or on to the documents' group; edges and what is told of documents go on too.
KEYS, DOCS, EDGES, FACTS, WINDOWS = 0, 1, 2, 3, 4
#: Documents with a null doc_id count as numbers below this, in the order of a hash of their texts.
NO_ID = -(1 << 62)
#: Bytes that a task gathers before it sends what it has for each target.
HELD = 12 << 20
#: Bytes of text that a group gets.
GROUP_BYTES = 16 << 20
#: Bits of the filter of document numbers: 8 for each document between these, so that it has 16 MB at most.
SLOTS = 1 << 20, 1 << 27


def doc_key(doc_id: str = "doc_id") -> Column:
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(doc_id).cast("long"), own + F.lit(-(1 << 63)))


def prime_groups(least: int) -> int:
    """The next prime: numbers in any arithmetic progression spread over so many groups by their remainder."""
    n = max(2, least)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@dataclass
class Survey:
    """What a table of documents asks for: groups of about GROUP_BYTES, bits of filters, and the numbers that stand for several texts."""

    groups: int
    slots: int
    repeats: bool
    clashes: DataFrame | None


def survey(docs: DataFrame) -> Survey:
    """One scan and one aggregation by document number; three numbers come to the driver."""
    own = docs.select(doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    per_doc = own.groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    found = per_doc.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.col("low") != F.col("high")).alias("clash")).first()
    slots = min(SLOTS[1], max(SLOTS[0], 1 << (8 * int(found["n"] or 0)).bit_length()))
    groups = prime_groups(max(task_groups(docs.sparkSession), -(-int(found["bytes"] or 0) // GROUP_BYTES)))
    return Survey(groups, slots, found["docs"] != found["n"], cut(per_doc.where("low != high").select("doc")) if found["clash"] else None)


def identified(docs: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """(row, doc, text): row has the columns other than text; doc stands for doc_id, or for doc_id and text where several texts have one."""
    row = F.struct(*[docs[c] for c in docs.columns if c.lower() != "text"])
    texts = docs.select(row.alias("row"), doc_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    if clashes is None:
        return texts
    own = F.xxhash64("doc", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(-(1 << 63))
    marked = texts.join(clashes.select(F.col("doc").alias("clash_")), F.col("doc") == F.col("clash_"), "left")
    return marked.select("row", F.when(F.col("clash_").isNotNull(), own).otherwise(F.col("doc")).alias("doc"), "text")


def in_groups(texts: DataFrame, groups: int) -> DataFrame:
    return texts.withColumn("group", F.pmod("doc", F.lit(groups)).cast("int"))


def unrowed(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """Columns of `row` beside added ones, which win where names clash."""
    taken = {c.lower() for c in added}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() != "text" and c.lower() not in taken], *added)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of values[i:i+size] for every i, from prefix sums modulo 2^64; values are random-looking uint64."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * powers, out=sums[1:])
        back = np.full(n - size + 1, inverse, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mixed((sums[size:] - sums[:-size]) * back)


def dealt(route: int, target: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The records, a row for each target."""
    if not len(records):
        return
    order = np.argsort(target, kind="stable")
    target, records = target[order], records[order]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for lo, hi in zip(first, np.append(first[1:], len(target)), strict=True):
        yield route, int(target[lo]), records[lo:hi].tobytes()


def batch(rows: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(ARROW.types)], schema=ARROW)


def joined(table: pa.Table, kind: np.dtype, route: int | None = None) -> np.ndarray:
    """The records of a group's blobs."""
    blobs = table["blob"].to_pylist()
    if route is not None:
        blobs = [b for b, r in zip(blobs, table["route"].to_pylist(), strict=True) if r == route]
    return np.frombuffer(b"".join(blobs), kind)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal keys in sorted keys."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key)))


def text_slices(batches: Iterable[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, group, texts in UTF-8) of columns (doc, group, text), a few MB at a time."""
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        docs, groups = b.column("doc").to_numpy(zero_copy_only=False), b.column("group").to_numpy(zero_copy_only=False)
        start = size = 0
        for k, text in enumerate(texts):
            if k > start and size + len(text) > most:
                yield docs[start:k], groups[start:k], texts[start:k]
                start, size = k, 0
            size += len(text)
        if start < len(texts):
            yield docs[start:], groups[start:], texts[start:]


def pieces_of(batches: Iterable[pa.RecordBatch], overlap: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, start, bytes) of texts: short ones whole, longer ones in pieces that overlap by so many bytes, about `most` bytes at a time."""
    for docs, _, texts in text_slices(batches, most):
        if len(texts[0]) <= most:
            yield docs, np.zeros(len(docs), np.int64), texts
        else:  # a long text stands alone
            for start in range(0, max(1, len(texts[0]) - overlap), most):
                yield docs, np.array([start]), [texts[0][start : start + most + overlap]]


def gathered(df: DataFrame, slices: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], send: Callable[[np.ndarray], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """The records that slices() makes of df's batches, sent in portions of about HELD bytes, so that send() can combine what is equal in many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for records in slices(batches):
            held.append(records)
            if sum(x.nbytes for x in held) > HELD:
                yield batch(send(np.concatenate(held)))
                held = []
        if held:
            yield batch(send(np.concatenate(held)))
            held = []
        tidy()

    return df.mapInArrow(run, BLOBS)


def mapped(df: DataFrame, work: Callable[[np.ndarray, np.ndarray, list[bytes]], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """work on slices of df (doc, group, text); the rows that it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0
        for docs, groups, texts in text_slices(batches):
            for route, target, blob in work(docs, groups, texts):
                held.setdefault((route, target), []).append(blob)
                size += len(blob)
            if size > HELD:
                yield batch((r, t, b"".join(x)) for (r, t), x in held.items())
                held, size = {}, 0
        yield batch((r, t, b"".join(x)) for (r, t), x in held.items())
        held = {}
        tidy()

    return df.mapInArrow(run, BLOBS)


def passed(route: int, target: int, table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """What is not for a group of keys goes on."""
    return ((route, target, b) for b in table["blob"].to_pylist())


def grouped(df: DataFrame, work: Callable[[pa.Table], Iterable[tuple[int, int, bytes]]], windows: Callable[[pa.Table], Iterable[tuple[int, int, bytes]]] | None = None) -> DataFrame:
    """work on the blobs of each group of keys (and windows on those of hashed windows); the rows that it makes, and those that were for documents."""

    def run(table: pa.Table) -> pa.Table:
        route, target = table["route"][0].as_py(), table["target"][0].as_py()
        made = work(table) if route == KEYS else windows(table) if route == WINDOWS and windows else passed(route, target, table)
        out = pa.Table.from_batches([batch(made)])
        trim()
        return out

    return df.groupBy("route", "target").applyInArrow(run, BLOBS)


def with_text(docs: DataFrame, blobs: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(texts, blobs) for each group of documents, docs being (doc, group, text) and the blobs' targets those groups."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = work(texts, found)
        trim()
        return out

    return docs.groupBy("group").cogroup(blobs.groupBy("target")).applyInArrow(run, schema)


def unpacked_rows(df: DataFrame, kind: np.dtype, names: dict[str, str]) -> DataFrame:
    """The records of blobs as rows of long columns: record field to column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column("blob").to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int64)) for c in names], list(names.values()))

    return df.mapInArrow(run, ", ".join(f"{c} long" for c in names.values()))


def slots(docs: np.ndarray, size: int) -> np.ndarray:
    return (mixed(docs.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def told(df: DataFrame, kind: np.dtype, size: int) -> DataFrame:
    """The documents that blobs (whose records have a field `doc`) tell of, in a filter of `size` bits: pages of 4 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            for x in b.column("blob").to_pylist():
                at = slots(np.frombuffer(x, kind)["doc"], size)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        pages = bits.reshape(-1, 4096)
        some = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pages[k].tobytes() for k in some], pa.binary())], ["page", "bits"])

    return df.mapInArrow(run, "page long, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def split(docs: DataFrame, filters: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc, ...) that a filter of told() may name, and the others."""
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for r in filters.toLocalIterator():  # at most 16 MB
        bits[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.arrow_udf("boolean")
    def named(doc: pa.Array) -> pa.Array:
        at = slots(doc.to_numpy(zero_copy_only=False), size)
        return pa.array((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    marked = docs.withColumn("named", named("doc"))
    return marked.where("named").drop("named"), marked.where("NOT named").drop("named")

"""Substring dedup over words: difference-cover anchors find the passages, window hashes decide."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.blobs import BLOBS, DOCS, KEYS, batch, dealt, gathered, grouped, identified, in_groups, joined, mixed, runs, split, survey, text_slices, told, unrowed, window_hashes, with_text
from fieldtrace.llm.common import cut, small_batches

ADDED = ["n_words", "n_removed", "kept_text", "removed_spans"]
#: Any two positions are both in the cover after the same shift below the period.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Where a run of words stands: the document's number, the crc32 of its text (rows with one doc_id may have several), the word.
ANCHOR = np.dtype([("key", "u8"), ("doc", "i8"), ("mark", "u4"), ("at", "i4")])
WINDOW = np.dtype([("key", "u8"), ("check", "u8"), ("doc", "i8"), ("mark", "u4"), ("at", "i4")])
SPOT = np.dtype([("doc", "i8"), ("mark", "u4"), ("at", "i4")])
#: A spot here tells of a copy of an earlier text.
COPY = -1
#: Bytes of a long text whose words are split at once.
PART = 1 << 20
RESULT = "n_words long, n_removed long, kept_text string, removed_spans array<struct<start:int,end:int>>"
ARROW_RESULT = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time. bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    start = 0
    while len(text) - start > PART:
        end = max(text.rfind(c, start, start + PART) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end < 0:  # one word as long as that
            ends = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := text.find(c, start + PART)) >= 0]
            end = min(ends, default=len(text) - 1)
        yield text[start : end + 1].split()
        start = end + 1
    yield text[start:].split()


def word_hashes(known: Hashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words."""
    words: list[bytes] = []
    made: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for some in [text.split()] if len(text) <= PART else word_parts(text):
            words += some
            counts[k] += len(some)
            if len(words) > PART // 4:
                made.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                words = []
    made.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(made), counts


def spots(docs: np.ndarray, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(docs), SPOT)
    out["doc"], out["mark"], out["at"] = docs, marks, at
    return out


def by_place(rows: np.ndarray) -> np.ndarray:
    """Different spots, by document, text and word."""
    rows = rows[np.lexsort((rows["at"], rows["mark"], rows["doc"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["mark"][1:] != rows["mark"][:-1]) | (rows["at"][1:] != rows["at"][:-1])
    return rows[new]


def spots_of(rows: np.ndarray, doc: int, text: bytes) -> np.ndarray:
    """The words that sorted spots name of this text."""
    own = rows[np.searchsorted(rows["doc"], doc) : np.searchsorted(rows["doc"], doc, "right")]
    return own["at"][own["mark"] == zlib.crc32(text)].astype(np.int64) if len(own) else np.zeros(0, np.int64)


def anchors_of(values: np.ndarray, counts: np.ndarray, docs: np.ndarray, texts: list[bytes], size: int, window: int) -> np.ndarray:
    """Anchors of texts of at least `window` words."""
    hashes = window_hashes(values, size, BASES[0])
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = np.isin(at % PERIOD, COVER) & (at + size <= counts[text]) & (counts[text] >= window)
    place = np.flatnonzero(keep)
    marks = np.array([zlib.crc32(t) for t in texts], np.uint32)
    out = np.empty(len(place), ANCHOR)
    out["key"], out["doc"], out["mark"], out["at"] = hashes[place], docs[text[place]], marks[text[place]], at[place]
    return out


def first_docs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by key, check and doc: the smallest doc of each row's window, and each window's first row."""
    if not len(rows):
        return rows["doc"], np.zeros(0, np.int64)
    new = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])])
    first = np.flatnonzero(new)
    return rows["doc"][first][np.cumsum(new) - 1], first


def result(text: bytes, starts: np.ndarray, window: int) -> tuple[int, int, str, list[dict]]:
    """Counts, kept text and removed spans of a text that loses the windows at starts; COPY stands for all of them."""
    words = text.split()
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    starts = np.arange(max(0, n - window + 1)) if len(starts) and starts[0] == COPY else starts[starts + window <= n]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
    return n, int(gone.sum()), kept, [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text, ...) without text, plus n_words, n_removed, kept_text (kept words joined by a space), removed_spans (of words).

    A word goes if a window of `window` consecutive words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Words are runs of bytes other than \\x20 and \\x09-\\x0D, compared as they are.

    1. Each document hashes the (window - 30)-word runs at the positions of a difference cover modulo 31; two equal windows have an anchor
       in common. Anchors seen in two documents point to passages.
    2. Around those, all windows are hashed (128 bits); the smallest doc_id of each hash is found, and later documents lose the window.
    Both steps first combine what is equal within a portion or group of documents, so that a passage in many documents sends a record or two
    from each. An exact copy of an earlier text needs no windows. Only documents that a filter of bounded size names are shuffled with their text.

    A null text has no words; texts shorter than a window lose none. Null doc_ids count as smaller than any other, in the order of a hash of the
    text. Repeated rows don't remove each other's words, nor do different texts with one doc_id, which each keep their own spans. Columns of docs named like an added column are replaced. An empty table stays empty.
    """
    if window <= PERIOD:
        raise ValueError(f"a window must have more than {PERIOD} words")
    small_batches(docs.sparkSession)
    plan, size = survey(docs), window - PERIOD + 1
    groups = plan.groups
    texts = in_groups(identified(docs, None), groups)
    known = Hashes()

    def to_docs(rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return dealt(DOCS, rows["doc"] % groups, spots(rows["doc"], rows["mark"], rows["at"]))

    def to_keys(rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return dealt(KEYS, (rows["key"] % np.uint64(groups)).astype(np.int64), rows)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (anchors_of(*word_hashes(known, texts), own, texts, size, window) for own, _, texts in text_slices(batches))

    def combine(found: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        found = found[np.lexsort((found["doc"], found["key"]))]
        first, length = runs(found["key"])
        several = np.repeat(found["doc"][first] != found["doc"][first + length - 1], length)
        yield from to_docs(found[several])
        # Of a key of several documents two records go on, and tell the others that it is one.
        ends = np.zeros(len(found), bool)
        ends[first] = ends[first + length - 1] = True
        yield from to_keys(found[~several | ends])

    def shared(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        found = joined(table, ANCHOR)
        found = found[np.lexsort((found["doc"], found["key"]))]
        first, length = runs(found["key"])
        return to_docs(found[np.repeat(found["doc"][first] != found["doc"][first + length - 1], length)])

    def as_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            yield batch(dealt(DOCS, own % groups, spots(own, marks, np.full(len(own), COPY))))

    long_enough = texts.where(F.octet_length("text") >= 2 * window - 1)
    prints = long_enough.select("doc", F.crc32(F.col("text").cast("binary")).alias("mark"), F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"))
    least = prints.groupBy("digest", "bytes").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = cut(prints.join(least, ["digest", "bytes"]).where("doc > least").select("doc", "mark").mapInArrow(as_copies, BLOBS))
    found = cut(grouped(gathered(texts.select("doc", "group", "text"), anchors, combine), shared).unionByName(copies))

    def hash_windows(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        flagged = by_place(joined(blobs, SPOT))
        wanted = texts.filter(pa.array(np.isin(texts["doc"].to_numpy(), flagged["doc"][flagged["at"] != COPY])))
        made = [np.zeros(0, WINDOW)]
        for own, _, raw in text_slices(wanted.to_batches()):
            values, counts = word_hashes(known, raw)
            base = np.cumsum(counts) - counts
            near = np.zeros(len(values) + 1, np.int64)
            for k, doc in enumerate(own):
                at = spots_of(flagged, doc, raw[k])
                if at[:1] == COPY:
                    continue
                np.add.at(near, base[k] + np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(near, base[k] + at + 1, -1)
            text = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(values)) - base[text]
            place = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (at + window <= counts[text]))
            out = np.empty(len(place), WINDOW)
            if len(place):
                out["key"], out["check"] = window_hashes(values, window, BASES[0])[place], window_hashes(mixed(values ^ np.uint64(BASES[1])), window, BASES[1])[place]
            marks = np.array([zlib.crc32(t) for t in raw], np.uint32)
            out["doc"], out["mark"], out["at"] = own[text[place]], marks[text[place]], at[place]
            made.append(out)
        rows = np.concatenate(made)
        rows = rows[np.lexsort((rows["doc"], rows["check"], rows["key"]))]
        smallest = first_docs(rows)[0]
        # The smallest document's windows go on; another group may have a still smaller one.
        return pa.Table.from_batches([batch([*to_docs(rows[rows["doc"] > smallest]), *to_keys(rows[rows["doc"] == smallest])])])

    def earlier(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows = joined(table, WINDOW)
        rows = rows[np.lexsort((rows["doc"], rows["check"], rows["key"]))]
        return to_docs(rows[rows["doc"] > first_docs(rows)[0]])

    near, _ = split(texts.select("doc", "group", "text"), told(found, SPOT, plan.slots), plan.slots)
    removed = cut(grouped(with_text(near, found, hash_windows, BLOBS), earlier).unionByName(copies))
    schema = f"row {texts.schema['row'].dataType.simpleString()}, {RESULT}"

    def finish(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        gone = by_place(joined(blobs, SPOT))
        raw = texts["text"].cast(pa.binary()).to_pylist()
        rows = [result(t, spots_of(gone, doc, t), window) for doc, t in zip(texts["doc"].to_numpy(), raw, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.Table.from_arrays([texts["row"], *(pa.array(c, t) for c, t in zip(columns, ARROW_RESULT, strict=True))], names=["row", *ADDED])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [x.split() for x in b.column("text").cast(pa.binary()).to_pylist()]
            columns = [len(w) for w in words], [0] * len(words), [b" ".join(w).decode() for w in words], [[]] * len(words)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, t) for c, t in zip(columns, ARROW_RESULT, strict=True))], names=["row", *ADDED])

    touched, rest = split(texts, told(removed, SPOT, plan.slots), plan.slots)
    out = with_text(touched, removed, finish, schema).unionByName(rest.select("row", "text").mapInArrow(untouched, schema))
    return unrowed(out, docs.columns, ADDED)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the hash of what dedup() keeps of each document's words, windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed_spans").cast("long").alias("n_spans"))

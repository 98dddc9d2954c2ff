"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.blobs import BLOBS, DOCS, KEYS, WINDOWS, batch, dealt, gathered, grouped, identified, in_groups, joined, mixed, pieces_of, runs, split, survey, text_slices, told, unrowed, window_hashes, with_text
from fieldtrace.llm.common import cut, small_batches
from fieldtrace.llm.suffix_array import permuted_common_prefixes, suffix_array

ADDED = ["n_bytes", "n_removed", "n_spans", "kept"]
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: An anchor: its hash, a hash of its context, where the strings that it stands for start, how many bytes they cover, how often the context was seen.
CONTEXT = np.dtype([("key", "u8"), ("check", "u8"), ("doc", "i8"), ("start", "i4"), ("size", "i4"), ("seen", "i4")])
#: Bytes to remove (key 0) or to send to a shard (its key, whether they go anyway, and whether the key has so many contexts that windows are told apart by hashes).
SPAN = np.dtype([("key", "u8"), ("doc", "i8"), ("start", "i4"), ("size", "i4"), ("gone", "i2"), ("hot", "i2")])
RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"
ARROW_RESULT = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
#: Random-looking numbers for the byte values.
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
#: Bytes of text that numpy works on at once, and bytes of one suffix array.
SLICE, SORTED = 1 << 18, 1 << 19
#: Different contexts of an anchor that meet in one suffix array, 320 bytes each at most.
HOT = 1024
#: Bytes of records of hashed windows that are combined at once.
HELD_WINDOWS = 16 << 20


def lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of values[i:i+size] for every i."""
    out, wide = values, 1
    while 2 * wide <= size:
        out = np.minimum(out[:-wide], out[wide:])
        wide *= 2
    return np.minimum(out[: len(out) - (size - wide)], out[size - wide :]) if size > wide else out


def contexts(texts: list[bytes], docs: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchors of texts, which start at offsets of their documents: for each string of `length` bytes the leftmost of its grams with the lowest hash; strings in a row with one anchor share a record."""
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return np.zeros(0, CONTEXT)
    values = TABLE[data]
    grams = window_hashes(values, gram, BASES[0])
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (lowest(grams & np.uint64(0xFFFFFFFF00000000) | place, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) - base[text] + length <= sizes[text])
    if not len(valid):
        return np.zeros(0, CONTEXT)
    # An anchor lies in one text; so a new anchor also marks a new text.
    first, count = runs(anchor[valid])
    start = valid[first]
    out = np.empty(len(first), CONTEXT)
    out["key"], out["doc"], out["start"], out["size"], out["seen"] = np.maximum(grams[anchor[start]], np.uint64(1)), docs[text[start]], start - (base - offsets)[text[start]], count + length - 1, 1
    # The context's hash: prefix sums of another polynomial, and its length.
    with np.errstate(over="ignore"):
        powers = np.full(len(values) + 1, BASES[1], np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.append(np.uint64(0), np.cumsum(mixed(values) * powers[:-1]))
        back = np.full(len(values) + 1, pow(BASES[1], -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        out["check"] = mixed((sums[start + out["size"]] - sums[start]) * back[start] + out["size"].astype(np.uint64))
    return out


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by key and context; the first of each context; how often each of those was seen."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["check"], rows["key"]))]
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])]))
    return rows, first, np.add.reduceat(rows["seen"].astype(np.int64), first)


def spans(rows: np.ndarray, key: int | np.ndarray = 0, gone: int | np.ndarray = 1, hot: int | np.ndarray = 0) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    for c in ("doc", "start", "size"):
        out[c] = rows[c]
    out["key"], out["gone"], out["hot"] = key, gone, hot
    return out


def merged(doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """What the strings of `length` bytes at these places cover, those in a row as one span."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros(len(first), SPAN)
    out["doc"], out["start"], out["gone"] = doc[first], start[first], 1
    out["size"] = start[np.append(first[1:] - 1, len(doc) - 1)[: len(first)]] - start[first] + length
    return out


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, where in it strings of `length` bytes start that also start elsewhere in the pieces, by suffix array.

    A separator is a symbol of its own, smaller than all bytes. So suffixes that begin with the same `length` bytes are neighbours.
    """
    sizes = np.array([len(x) for x in pieces], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    data[ends] = 0
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)
    room = ends[piece] - np.arange(len(data))
    before, common = permuted_common_prefixes(data, suffix_array(data))
    same = np.flatnonzero((np.minimum(np.minimum(common, room), room[before]) >= length) & (before >= 0))
    hit = np.zeros(len(data), bool)
    hit[same] = hit[before[same]] = True
    place = np.flatnonzero(hit)
    cuts = np.searchsorted(piece[place], np.arange(len(sizes) + 1))
    starts = ends - sizes
    return [place[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]


def windows_of(heads: np.ndarray, pieces: list[bytes], length: int) -> np.ndarray:
    """All strings of `length` bytes of pieces (heads: SPAN), by their hashes, as contexts of their own."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    values = TABLE[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[piece]
    place = np.flatnonzero(at + length <= sizes[piece])
    out = np.empty(len(place), CONTEXT)
    if len(place):
        out["key"], out["check"] = window_hashes(values, length, BASES[0])[place], window_hashes(mixed(values), length, BASES[1])[place]
    own = heads[piece[place]]
    out["doc"], out["start"], out["size"], out["seen"] = own["doc"], own["start"] + at[place], length, 1 + own["gone"]
    return out


def result(text: bytes, own: np.ndarray) -> tuple[int, int, int, bytes]:
    own = own[own["start"] + own["size"] <= len(text)]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, own["start"], 1)
    np.add.at(change, own["start"] + own["size"], -1)
    gone = np.cumsum(change[:-1]) > 0
    return len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id, text, ...) without text, plus n_bytes, n_removed, n_spans (runs removed), kept (bytes that stay).

    A byte of the UTF-8 text goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or
    another; strings don't cross documents, may overlap, and are judged on the input. All occurrences go.

    1. Each string of `length` bytes is stood for by the lowest-hashed of its grams; strings in a row with one such anchor make one context.
       Contexts with an equal (128-bit hashed) content go at once; an anchor with several different contexts needs a closer look.
    2. One context of each content travels to its anchor's shard. A shard builds suffix arrays of the contexts of some anchors at a time by induced
       sorting (the reduced string of leftmost-smaller substrings is ordered by doubling, for induced sorting in numpy wants few buckets), computes
       permuted common prefixes, and marks starts that share `length` bytes with a neighbour.
    3. Of an anchor with more than 1,024 different contexts (a line that very many documents share) no task sorts all: its strings
       of `length` bytes are hashed (128 bits) where the documents are, and dealt by hash.
    Steps 1 and 3 first combine what is equal within a portion of documents, so that a passage in many documents sends a record or two from each;
    only documents that a filter of bounded size names are shuffled with their text.

    A null text is an empty one; texts shorter than `length` lose nothing, and texts of any length are worked on in pieces of 256 KB. Repeated rows
    are copies of each other; rows with one doc_id but different texts are different documents, and so are rows without doc_id. What is kept of a text
    need not be whole characters. Columns of docs named like an added column are replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    plan, gram = survey(docs), max(1, length * 2 // 5)
    groups = plan.groups
    texts = in_groups(identified(docs, plan.clashes), groups)

    def to_docs(rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return dealt(DOCS, rows["doc"] % groups, rows)

    def to_keys(rows: np.ndarray, route: int = KEYS) -> Iterator[tuple[int, int, bytes]]:
        return dealt(route, (rows["key"] % np.uint64(groups)).astype(np.int64), rows)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (contexts(raw, own, offsets, length, gram) for own, offsets, raw in pieces_of(batches, length - 1, SLICE))

    def combine(rows: np.ndarray, route: int = KEYS) -> Iterator[tuple[int, int, bytes]]:
        """What is seen twice goes; one of each content goes on, and tells whether it was seen twice."""
        rows, first, seen = combined(rows)
        several = rows[np.repeat(seen > 1, np.diff(np.append(first, len(rows))))]
        yield from to_docs(spans(several) if route == KEYS else merged(several["doc"], several["start"], length))
        rows = rows[first]
        rows["seen"] = np.minimum(seen, 2)
        yield from to_keys(rows, route)

    def compare(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows, first, seen = combined(joined(table, CONTEXT))
        counts = np.diff(np.append(first, len(rows)))
        yield from to_docs(spans(rows[np.repeat(seen > 1, counts)]))
        one = rows[first]
        key_count = runs(one["key"])[1]
        count = np.repeat(key_count, key_count)
        ask = count > 1
        yield from to_docs(spans(one[ask], one["key"][ask], seen[ask] > 1, count[ask] > HOT))

    found = cut(grouped(gathered(texts.select("doc", "text", "group"), anchors, combine), compare))

    def only(df: DataFrame, asked: bool) -> DataFrame:
        """The blobs' records with a key (requests), or without (bytes to remove)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for target, blob in zip(b.column("target").to_pylist(), b.column("blob").to_pylist(), strict=True):
                    rows = np.frombuffer(blob, SPAN)
                    if len(rows := rows[(rows["key"] != 0) == asked]):
                        made.append((DOCS, target, rows.tobytes()))
                yield batch(made)

        return df.mapInArrow(run, BLOBS)

    requests, removed = only(found, True), only(found, False)

    def by_place(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows["start"], rows["doc"]))]

    def fetch(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        rows = by_place(joined(blobs, SPAN))
        made: dict[int, list[bytes]] = {}
        hot: tuple[list, list[bytes]] = ([], [])
        hashed: list[np.ndarray] = []
        out: list[tuple[int, int, bytes]] = []

        def flush(most: int) -> None:
            if sum(map(len, hot[1])) > most:
                hashed.append(windows_of(np.array(hot[0], SPAN), hot[1], length))
                hot[0].clear()
                hot[1].clear()
            if hashed and (not most or sum(x.nbytes for x in hashed) > HELD_WINDOWS):
                out.extend(combine(np.concatenate(hashed), WINDOWS))
                hashed.clear()

        done = -(1 << 64), 0
        for own, _, raw in text_slices(texts.sort_by("doc").to_batches()):
            for doc, text in zip(own, raw, strict=True):
                for r in rows[np.searchsorted(rows["doc"], doc) : np.searchsorted(rows["doc"], doc, "right")]:
                    mark = int(r["doc"]), int(r["start"])
                    if mark > done:  # repeated rows answer once
                        done = mark
                        piece = text[r["start"] : r["start"] + r["size"]]
                        if r["hot"]:
                            hot[0].append(tuple(r))
                            hot[1].append(piece)
                            flush(SLICE)
                        else:
                            made.setdefault(int(r["key"] % np.uint64(groups)), []).append(r.tobytes() + piece)
        flush(0)
        return pa.Table.from_batches([batch([*out, *((KEYS, t, b"".join(x)) for t, x in made.items())])])

    def heads_and_pieces(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        heads, pieces = [np.zeros(0, SPAN)], []
        for blob in table["blob"].to_pylist():
            at = 0
            while at < len(blob):
                heads.append(np.frombuffer(blob, SPAN, 1, at))
                at += SPAN.itemsize + int(heads[-1]["size"][0])
                pieces.append(blob[at - int(heads[-1]["size"][0]) : at])
        return np.concatenate(heads), pieces

    def sort(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows, pieces = heads_and_pieces(table)
        order = np.argsort(rows["key"], kind="stable")
        part: list[int] = []
        size = 0
        for first, count in zip(*runs(rows["key"][order]), strict=True):
            own = order[first : first + count]
            if part and size + int(rows["size"][own].sum()) > SORTED:
                yield from marked(rows[part], [pieces[k] for k in part])
                part, size = [], 0
            part += own.tolist()
            size += int(rows["size"][own].sum())
        yield from marked(rows[part], [pieces[k] for k in part])

    def marked(rows: np.ndarray, pieces: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        some = [(r["doc"], r["start"] + hit) for r, hit in zip(rows, repeated(pieces, length) if pieces else [], strict=True) if len(hit) and not r["gone"]]
        if some:
            yield from to_docs(merged(np.repeat([d for d, _ in some], [len(h) for _, h in some]), np.concatenate([h for _, h in some]), length))

    def same_windows(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows, first, seen = combined(joined(table, CONTEXT))
        several = rows[np.repeat(seen > 1, np.diff(np.append(first, len(rows))))]
        return to_docs(merged(several["doc"], several["start"], length))

    needed, _ = split(texts.select("doc", "group", "text"), told(requests, SPAN, plan.slots), plan.slots)
    removed = cut(removed.unionByName(grouped(with_text(needed, requests, fetch, BLOBS), sort, same_windows)))
    schema = f"row {texts.schema['row'].dataType.simpleString()}, {RESULT}"

    def finish(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        gone = by_place(joined(blobs, SPAN))
        cuts = [np.searchsorted(gone["doc"], texts["doc"].to_numpy(), side) for side in ("left", "right")]
        rows = [result(t, gone[a:b]) for t, a, b in zip(texts["text"].cast(pa.binary()).to_pylist(), *cuts, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.Table.from_arrays([texts["row"], *(pa.array(c, t) for c, t in zip(columns, ARROW_RESULT, strict=True))], names=["row", *ADDED])

    touched, rest = split(texts, told(removed, SPAN, plan.slots), plan.slots)
    whole = rest.select("row", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return unrowed(with_text(touched, removed, finish, schema).unionByName(whole), docs.columns, ADDED)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the hash of what dedup() keeps of each document's bytes, strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.blobs import BLOBS, DOCS, EDGES, FACTS, KEYS, NO_ID, Survey, batch, dealt, doc_key, grouped, identified, in_groups, joined, mapped, mixed, runs, split, survey, text_slices, told, unpacked_rows, unrowed, window_hashes, with_text
from fieldtrace.llm.common import components, cut, small_batches
from fieldtrace.llm.passages import Hashes, word_hashes
from fieldtrace.llm.signatures import Tree, bitmap, close, linked, pair_chunks, width_for

ADDED = ["n_shingles", "component_id"]
BASE = 0x9E3779B97F4A7C15
FACT = np.dtype([("doc", "i8"), ("size", "i8"), ("one", "i8"), ("two", "i8")])
PREFIX = np.dtype([("key", "u8"), ("set", "u8"), ("doc", "i8"), ("size", "i4")])
KEYED = np.dtype([("doc", "i8"), ("key", "u8"), ("size", "i4")])
GROUPED = np.dtype([("doc", "i8"), ("key", "u8"), ("size", "i4"), ("component", "i8"), ("seen", "i4")])
COMPONENT = np.dtype([("doc", "i8"), ("component", "i8")])
EDGE = np.dtype([("doc", "i8"), ("other", "i8")])
PAIR = np.dtype([("a", "i8"), ("b", "i8")])
#: A text or bitmap on its way: its document, the key it goes to, number of shingles, component, bytes that follow.
HEAD = np.dtype([("doc", "i8"), ("key", "u8"), ("size", "i4"), ("component", "i8"), ("length", "i4")])


def signed(width: int) -> np.dtype:
    """A class under one of its keys, with a bitmap of that width."""
    return np.dtype([*GROUPED.descr, ("bits", "u8", (width // 64,))])


#: Texts of one key that reach the first comparison, which is a short cut, and of each group of documents at least; sets of one key
#: compared at once, and how many of those before them.
SENT, SENT_EACH, TOGETHER, AGAIN = 8192, 4, 2048, 64
#: Bytes of texts of one key that reach the first comparison, from all groups of documents.
SENT_BYTES = 64 << 20
#: Classes of one key that meet in one group; of a key with more, pairs of blocks meet.
MEET = 4096
#: Up to so many sets of a key are a leaf of the tree: all pairs are tested.
SMALL = 48


def shingles(known: Hashes, text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased; of the whole sequence if it is shorter."""
    values = word_hashes(known, [text.lower()])[0]
    if not len(values):
        return values
    if len(values) < n:
        return mixed(window_hashes(values, len(values), BASE) + np.uint64(len(values)))
    return np.unique(window_hashes(values, n, BASE))


def all_shingles(known: Hashes, texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """shingles() of each text, hashed together."""
    values, counts = word_hashes(known, [t.lower() for t in texts])
    hashes = window_hashes(values, n, BASE)
    for start, count, text in zip(np.cumsum(counts) - counts, counts, texts, strict=True):
        yield np.unique(hashes[start : start + count - n + 1]) if count >= n else shingles(known, text, n)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    return int(mixed(tokens).sum(dtype=np.uint64).astype(np.int64)), int(mixed(tokens ^ np.uint64(BASE)).sum(dtype=np.uint64).astype(np.int64))


def bands(sizes: np.ndarray, least: int) -> np.ndarray:
    """Sizes that may go together are in the same band or neighbouring ones."""
    return np.floor(np.log(sizes.astype(float)) / -math.log(least / 100) + 1e-9).astype(np.int64)


def spare(sizes: np.ndarray) -> np.ndarray:
    """How many more of its lowest tokens a set sends than one in common would need: so many must be in common."""
    return np.maximum(1, sizes // 20)


def paired(key: np.ndarray, band: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For rows sorted by key and band: is there a row of another group with the same key in this band or one beside it?"""
    if not len(key):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
    count = np.diff(np.append(first, len(key)))
    low, high = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
    mixed_run = low != high
    beside = np.zeros(len(first), bool)
    step = (key[first][1:] == key[first][:-1]) & (np.diff(band[first]) == 1)
    differ = step & ((low[1:] != low[:-1]) | mixed_run[1:] | mixed_run[:-1])
    beside[1:] |= differ
    beside[:-1] |= differ
    return np.repeat(mixed_run | beside, count)


def heads_and_bodies(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    heads, bodies = [np.zeros(0, HEAD)], []
    for blob in table["blob"].to_pylist():
        at = 0
        while at < len(blob):
            heads.append(np.frombuffer(blob, HEAD, 1, at))
            at += HEAD.itemsize
            bodies.append(blob[at : at + int(heads[-1]["length"][0])])
            at += len(bodies[-1])
    return np.concatenate(heads), bodies


def headed(doc: int, key: int, size: int, component: int, body: bytes) -> bytes:
    return np.array([(doc, key, size, component, len(body))], HEAD).tobytes() + body


def edges_of(rows: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    return [(EDGES, -1, np.array(rows, EDGE).tobytes())] if rows else []


def link(docs: DataFrame, n: int = 5, least: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) plus n_shingles and component_id: the smallest doc_id reachable over links, its own included.

    Two documents link when their sets of n-word shingles have a Jaccard similarity of at least `least` percent, exactly. Words are runs
    of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased; a document with fewer than n words has its whole sequence as
    its one shingle; without words or text it has no shingle and no link.

    Equal sets are one class, told by a 128-bit fingerprint. Of each set the lowest-hashed shingles count, 100 - least percent and 5 more. Sets
    that link have about 5 percent of theirs among those in common. Such shingles in two classes of possible sizes are keys, and a class with fewer
    keys than that links with nothing: a passage in common is not enough.
    1. Short cut: each class takes its text to its lowest and its highest shingle only, where a signature tree proposes pairs and
       exact sets decide. Whole groups of near copies come together there, without all their pairs.
    2. The rest: keys that still hold different components, without each class's most frequent ones, get a bitmap of each class; the trees' pairs
       between components are decided by their texts. So no link between different components is lost, and no pair within one is made.
    Step 1 combines within groups of documents first and is no more than a short cut, so it sends about 8,192 texts
    of a key at most, or 4 from each group.

    Repeated rows are one document; rows with one doc_id but different texts are different documents, each with its own set and links. Null doc_ids count as
    smaller than any other: their component is null, and so is that of what they link with. Columns of docs named like an added column are replaced. An empty table stays empty.
    """
    plan = survey(docs)
    out = linked_rows(docs, plan, n, least)
    return unrowed(out.withColumn("component_id", F.when(F.col("component_id") > F.lit(NO_ID), F.col("component_id"))), docs.columns, ["text", *ADDED])


def one_of_each(docs: DataFrame, n: int = 5, least: int = 80) -> DataFrame:
    """One row of docs for each group of linked documents: that with the smallest doc_id (null counts as smallest; of rows with it, that with
    the smallest hash of all columns). Every row without words links with nothing and stays, but for rows that repeat one with a doc_id."""
    plan = survey(docs)
    rows = linked_rows(docs, plan, n, least).where("doc = node")
    if plan.repeats:
        free = (F.col("n_shingles") == 0) & (F.col("doc") <= F.lit(NO_ID))
        best = F.min_by(F.struct("row", "text"), F.struct(F.xxhash64("row", "text"), F.crc32(F.to_json("row").cast("binary"))))
        once = rows.where(~free).groupBy("doc").agg(best.alias("one")).select("one.row", "one.text")
        rows = once.unionByName(rows.where(free).select("row", "text"))
    given = docs.columns
    return rows.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in given])


def linked_rows(docs: DataFrame, plan: Survey, n: int, least: int) -> DataFrame:
    """(row, text, doc, node, n_shingles, component_id): doc and node number a document and the smallest one that it is linked with; component_id
    is the smallest number that stands for a doc_id there."""
    small_batches(docs.sparkSession)
    groups = plan.groups
    texts = in_groups(identified(docs, plan.clashes), groups)
    slim = texts.select("doc", "group", "text")
    known = Hashes()

    def by_doc(rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return dealt(DOCS, rows["doc"] % groups, rows)

    def by_key(rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return dealt(KEYS, (rows["key"] % np.uint64(groups)).astype(np.int64), rows)

    def prefixes(own: np.ndarray, _: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        facts, made = [], [np.zeros(0, PREFIX)]
        seen: dict[tuple, int] = {}
        for doc, tokens in zip(own, all_shingles(known, texts, n), strict=True):
            marks = fingerprint(tokens)
            facts.append((doc, len(tokens), *marks))
            # Of equal sets in a slice the smallest document stands for all; a later slice may still have a smaller one.
            if len(tokens) and seen.get((len(tokens), *marks), doc + 1) > doc:
                seen[(len(tokens), *marks)] = doc
                most = len(tokens) - (least * len(tokens) + 99) // 100 + int(spare(np.int64(len(tokens))))
                rows = np.empty(most, PREFIX)
                rows["key"], rows["set"], rows["doc"], rows["size"] = tokens[:most], np.int64(marks[0]).astype(np.uint64), doc, len(tokens)
                made.append(rows)
        yield from dealt(FACTS, own % groups, np.array(facts, FACT))
        yield from by_key(np.concatenate(made))

    def keys(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows = joined(table, PREFIX)
        rows = rows[np.lexsort((rows["doc"], rows["set"], rows["size"], rows["key"]))]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["set"][1:] != rows["set"][:-1]) | (rows["size"][1:] != rows["size"][:-1])])]
        keep = rows[paired(rows["key"], bands(rows["size"], least), rows["set"])]
        out = np.empty(len(keep), KEYED)
        for c in ("doc", "key", "size"):
            out[c] = keep[c]
        return by_doc(out)

    def sifted(df: DataFrame, kind: np.dtype) -> DataFrame:
        """The keys of documents that have enough of them. If the records tell how often a key is seen, the most frequent ones go, one fewer
        than must be in common: of the keys that two sets have in common the rarest always stays."""

        def run(table: pa.Table) -> pa.Table:
            rows = np.unique(joined(table, kind))
            if "seen" in kind.names:
                rows = rows[np.lexsort((rows["key"], rows["seen"], rows["doc"]))]
            first, count = runs(rows["doc"])
            needed = spare((least * rows["size"][first].astype(np.int64) + 99) // 100)
            keep = np.repeat(count >= needed, count)
            if "seen" in kind.names:
                keep &= np.arange(len(rows)) - np.repeat(first, count) < np.repeat(count - needed + 1, count)
            return pa.Table.from_batches([batch(by_doc(rows[keep]))])

        return df.groupBy("target").applyInArrow(run, BLOBS)

    found = cut(grouped(mapped(slim, prefixes), keys))
    facts = unpacked_rows(found.where(F.col("route") == FACTS), FACT, {"doc": "doc", "size": "n_shingles", "one": "one", "two": "two"})
    keyed = cut(sifted(found.where(F.col("route") == DOCS), KEYED))

    def first_texts(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        wanted = np.unique(joined(blobs, KEYED)["doc"])
        mine: dict[int, list[tuple[int, bytes]]] = {}
        done: set[int] = set()
        for own, _, raw in text_slices(texts.to_batches()):
            for doc, text in zip(own, raw, strict=True):
                if int(doc) not in done and doc in wanted[np.searchsorted(wanted, doc) :][:1]:
                    done.add(int(doc))
                    tokens = shingles(known, text, n)
                    for key in {int(t) for t in (tokens[:1], tokens[-1:]) if len(t)}:
                        mine.setdefault(key, []).append((int(doc), text))
        made = []
        for key, some in mine.items():
            edges = local(some)
            joined_docs = {b for _, b in edges}
            made += edges_of(edges)
            sent = [x for x in some if x[0] not in joined_docs][: max(SENT_EACH, SENT // groups)]
            size = np.cumsum([len(t) for _, t in sent])
            made += [(KEYS, key % groups, headed(d, key, 0, 0, t)) for (d, t), so_far in zip(sent, size, strict=True) if so_far <= max(1, SENT_BYTES // groups)]
        return pa.Table.from_batches([batch(made)])

    def local(some: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        """Edges (a, b) among documents with their texts; each b is joined to what an a stands for."""
        out: list[tuple[int, int]] = []
        sets = [shingles(known, t, n) for _, t in some]
        some, sets = [x for x, s in zip(some, sets, strict=True) if len(s)], [s for s in sets if len(s)]
        order = np.argsort([len(s) for s in sets], kind="stable")
        for lo in range(0, len(some), TOGETHER):
            part = order[max(0, lo - AGAIN) : lo + TOGETHER]
            if len(part) > 1:
                root = np.arange(len(part))
                linked([sets[k] for k in part], least, root)
                out += [(some[part[r]][0], some[part[i]][0]) for i, r in enumerate(root) if r != i]
        return out

    def first_compare(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        heads, bodies = heads_and_bodies(table)
        order = np.lexsort((heads["doc"], heads["key"]))
        for first, count in zip(*runs(heads["key"][order]), strict=True):
            if count > 1:
                yield from edges_of(local([(int(heads["doc"][k]), bodies[k]) for k in order[first : first + count]]))

    needed, _ = split(slim, told(keyed, KEYED, plan.slots), plan.slots)
    near = cut(grouped(with_text(needed, keyed, first_texts, BLOBS), first_compare))
    edge_rows = unpacked_rows(near.where(F.col("route") == EDGES), EDGE, {"doc": "src", "other": "dst"})
    grouped_docs = cut(components(edge_rows))

    def as_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.empty(b.num_rows, COMPONENT)
            rows["doc"], rows["component"] = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component"))
            yield batch(dealt(FACTS, rows["doc"] % groups, rows))

    def with_components(table: pa.Table) -> pa.Table:
        rows, known_ = joined(table, KEYED, DOCS), np.sort(joined(table, COMPONENT, FACTS), order="doc")
        out = np.zeros(len(rows), GROUPED)
        for c in ("doc", "key", "size"):
            out[c] = rows[c]
        at = np.minimum(np.searchsorted(known_["doc"], rows["doc"]), max(0, len(known_) - 1))
        out["component"] = np.where(known_["doc"][at] == rows["doc"], known_["component"][at], rows["doc"]) if len(known_) else rows["doc"]
        return pa.Table.from_batches([batch(by_key(out))])

    def still_apart(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        rows = joined(table, GROUPED)
        rows = rows[np.lexsort((rows["size"], rows["key"]))]
        rows = rows[paired(rows["key"], bands(rows["size"], least), rows["component"])]
        count = runs(rows["key"])[1]
        rows["seen"] = np.repeat(count, count)
        return by_doc(rows)

    told_of = keyed.unionByName(grouped_docs.mapInArrow(as_blobs, BLOBS)).groupBy("target").applyInArrow(with_components, BLOBS)
    apart = cut(sifted(grouped(told_of, still_apart), GROUPED))

    def blocks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which records go, and the keys that they go to: a key that more than MEET classes have is split by neighbouring bands of sizes and by
        pairs of blocks of half that many, so that any two classes of possible sizes meet under one key and no group holds all."""
        parts = -(-rows["seen"].astype(np.int64) // (MEET // 2))
        at, keys = [np.flatnonzero(rows["seen"] <= MEET)], [rows["key"][rows["seen"] <= MEET]]
        band = bands(np.maximum(rows["size"], 1), least)
        for n_parts in np.unique(parts[rows["seen"] > MEET]):
            some = np.flatnonzero((parts == n_parts) & (rows["seen"] > MEET))
            own = (mixed(rows["doc"][some].astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
            for step in (0, 1):
                for other in range(n_parts):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    place = (((band[some] - step + 1) * n_parts + low) * n_parts + high).astype(np.uint64)
                    at.append(some)
                    keys.append(mixed(rows["key"][some] ^ mixed(place + np.uint64(1))))
        return np.concatenate(at), np.concatenate(keys)

    def send_bitmaps(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        rows = np.sort(joined(blobs, GROUPED), order=["doc", "key"])
        by_width: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        done: set[int] = set()
        for own, _, raw in text_slices(texts.to_batches()):
            for doc, text in zip(own, raw, strict=True):
                mine = rows[np.searchsorted(rows["doc"], doc) : np.searchsorted(rows["doc"], doc, "right")]
                if len(mine) and int(doc) not in done:
                    done.add(int(doc))
                    width = width_for(int(mine["size"][0]))
                    by_width.setdefault(width, []).append((mine, bitmap(shingles(known, text, n), width)))
        made = []
        for width, some in by_width.items():  # a blob begins with its width
            out = np.empty(sum(len(m) for m, _ in some), signed(width))
            own = np.concatenate([m for m, _ in some])
            for c in GROUPED.names:
                out[c] = own[c]
            out["bits"] = np.repeat(np.stack([x for _, x in some]), [len(m) for m, _ in some], axis=0)
            at, meet = blocks(own)
            out = out[at]
            out["key"] = meet
            made += [(k, t, np.int64(width).tobytes() + x) for k, t, x in by_key(out)]
        return pa.Table.from_batches([batch(made)])

    def propose(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        parts: dict[int, list[np.ndarray]] = {}
        for blob in table["blob"].to_pylist():
            width = int(np.frombuffer(blob, np.int64, 1)[0])
            parts.setdefault(width, []).append(np.frombuffer(blob, signed(width), offset=8))
        if not parts:
            return
        signatures = {w: np.concatenate(x) for w, x in parts.items()}
        heads = np.concatenate([x[list(GROUPED.names)].astype(GROUPED) for x in signatures.values()])
        widths = np.concatenate([np.full(len(x), w) for w, x in signatures.items()])
        place = np.concatenate([np.arange(len(x)) for x in signatures.values()])
        order = np.lexsort((heads["doc"], heads["size"], heads["key"]))
        heads, widths, place = heads[order], widths[order], place[order]

        def bits_of(some: np.ndarray, width: int) -> np.ndarray:
            out = np.empty((len(some), width // 64), np.uint64)
            for w in np.unique(widths[some]):
                at = np.flatnonzero(widths[some] == w)
                out[at] = np.bitwise_or.reduce(signatures[int(w)]["bits"][place[some[at]]].reshape(len(at), -1, width // 64), axis=1)
            return out

        size, component = heads["size"].astype(np.int64), heads["component"]
        first, count = runs(heads["key"])
        run = np.repeat(np.arange(len(first)), count)
        small = (count <= SMALL)[run]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, SMALL):  # all pairs of the small runs
            x = np.flatnonzero(small[:-step] & (run[:-step] == run[step:]) & (component[:-step] != component[step:]) & (100 * size[:-step] >= least * size[step:]))
            left.append(x)
            right.append(x + step)
        x, y = np.concatenate(left), np.concatenate(right)
        a, b = np.minimum(heads["doc"][x], heads["doc"][y]), np.maximum(heads["doc"][x], heads["doc"][y])
        by_pair = np.lexsort((b, a))
        a, b = a[by_pair], b[by_pair]
        once = by_pair[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(x) else x
        x, y = x[once], y[once]
        narrow = np.minimum(widths[x], widths[y])
        wanted = [np.zeros((2, 0), np.int64)]
        for width in np.unique(narrow):
            i, j = x[narrow == width], y[narrow == width]
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            bits = bits_of(used, int(width))
            excess = size[used] - np.bitwise_count(bits).sum(axis=1)
            m, n_ = at[: len(i)], at[len(i) :]
            for lo in range(0, len(i), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                most = np.bitwise_count(bits[m[part]] & bits[n_[part]]).sum(axis=1) + np.minimum(excess[m[part]], excess[n_[part]])
                keep = (100 + least) * most >= least * (size[i[part]] + size[j[part]])
                wanted.append(np.stack([heads["doc"][i[part]][keep], heads["doc"][j[part]][keep]]))
        band = bands(np.maximum(size, 1), least)
        for f, c in zip(first[count > SMALL], count[count > SMALL], strict=True):
            own = np.arange(f, f + c)
            for k in np.unique(band[own]):
                some = own[(band[own] == k) | (band[own] == k + 1)]
                if len(some) < 2 or (component[some] == component[some[0]]).all():
                    continue
                width = int(widths[some].min())
                bits = bits_of(some, width)
                for x, y in pair_chunks(Tree(size[some], bits), least):
                    x, y = some[x], some[y]
                    different = component[x] != component[y]
                    wanted.append(np.stack([heads["doc"][x[different]], heads["doc"][y[different]]]))
        both = np.sort(np.concatenate(wanted, axis=1), axis=0)
        pairs = np.empty(both.shape[1], PAIR)
        pairs["a"], pairs["b"] = both
        pairs = distinct(pairs)
        return dealt(KEYS, (pair_key(pairs) % np.uint64(groups)).astype(np.int64), pairs)

    def distinct(pairs: np.ndarray) -> np.ndarray:
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
        return pairs[new]

    def pair_key(pairs: np.ndarray) -> np.ndarray:
        return mixed(mixed(pairs["a"].astype(np.uint64)) ^ pairs["b"].astype(np.uint64))

    def ask(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        """Two sets have many keys in common, and each key's group names the pair: here it counts once. Both texts go to a group that the pair names."""
        pairs = distinct(joined(table, PAIR))
        rows = np.zeros(2 * len(pairs), KEYED)
        rows["doc"], rows["key"] = np.concatenate([pairs["a"], pairs["b"]]), np.tile(pair_key(pairs), 2)
        return by_doc(rows)

    needed, _ = split(slim, told(apart, GROUPED, plan.slots), plan.slots)
    asked = cut(grouped(grouped(with_text(needed, apart, send_bitmaps, BLOBS), propose), ask))

    def send_texts(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        rows = np.unique(joined(blobs, KEYED))
        made: dict[int, list[bytes]] = {}
        done: set[int] = set()
        for own, _, raw in text_slices(texts.to_batches()):
            for doc, text in zip(own, raw, strict=True):
                mine = rows[np.searchsorted(rows["doc"], doc) : np.searchsorted(rows["doc"], doc, "right")]
                if len(mine) and int(doc) not in done:
                    done.add(int(doc))
                    for r in mine:
                        made.setdefault(int(r["key"] % np.uint64(groups)), []).append(headed(doc, r["key"], 0, 0, text))
        return pa.Table.from_batches([batch((KEYS, t, b"".join(x)) for t, x in made.items())])

    def decide(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        heads, bodies = heads_and_bodies(table)
        order = np.lexsort((heads["doc"], heads["key"]))
        for first, count in zip(*runs(heads["key"][order]), strict=True):
            some = order[first : first + count]
            sets = [shingles(known, bodies[k], n) for k in some]
            for i in range(len(some)):  # two, unless hashes of pairs meet
                yield from edges_of([(int(heads["doc"][some[i]]), int(heads["doc"][some[j]])) for j in range(i) if len(sets[i]) and len(sets[j]) and close(sets[i], sets[j], least)])

    needed, _ = split(slim, told(asked, KEYED, plan.slots), plan.slots)
    late = cut(grouped(with_text(needed, asked, send_texts, BLOBS), decide))
    late_rows = unpacked_rows(late.where(F.col("route") == EDGES), EDGE, {"doc": "src", "other": "dst"})
    joins = grouped_docs.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(late_rows)
    final = components(joins)

    marks = ["n_shingles", "one", "two"]
    classes = facts.where("n_shingles > 0").groupBy(*marks).agg(F.min("doc").alias("low"))
    classes = classes.join(final.select(F.col("node").alias("low"), "component"), "low", "left").select(*marks, F.coalesce("component", "low").alias("component"))
    result = facts.join(classes, marks, "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("node")).dropDuplicates(["doc"])
    row = F.struct(*[docs[c] for c in docs.columns if c.lower() != "text"])
    if plan.clashes is None:
        return docs.select(row.alias("row"), "text", doc_key().alias("doc")).join(result, "doc").withColumn("component_id", F.col("node"))
    out = identified(docs, plan.clashes).join(result, "doc").withColumn("real_", doc_key("row.doc_id"))
    smallest = out.groupBy("node").agg(F.min(F.struct("real_", "doc")).alias("low"))
    return out.join(smallest, "node").select("row", "text", "doc", F.col("low.doc").alias("node"), "n_shingles", F.col("low.real_").alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of four words, at 85 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link(docs, n=4, least=85).select("doc_id", *ADDED)

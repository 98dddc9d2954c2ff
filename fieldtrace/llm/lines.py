"""Line dedup: lines that many documents hold go, but for those of one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fieldtrace.llm.common import packed, small_batches, stored, task_groups, tidy, unpacked

ADDED = ["n_lines", "n_dropped", "kept"]
#: What is stripped off a line's ends, and what A-Z becomes.
BLANKS = b" \t\n\v\f\r"
#: Bits that a key sets in a filter, bits of a filter for each key, and the least and most bits of one.
HASHES, BITS_EACH, BITS = 2, 16, (1 << 20, 1 << 28)
#: Bytes of text for which a filter is laid out to hold a key.
LINE_BYTES = 64
#: Bytes of a page of a filter; bytes of keys that a task holds before it sends them; bytes of text for a group of documents.
PAGE, HELD, GROUP_BYTES = 4096, 16 << 20, 16 << 20
#: Keys that a task tells apart at a time when it fills its filters.
AT_ONCE = 1 << 18
PAGES = "page long, once binary, twice binary"
SUSPECTS = "grp long, key binary, docs long, last long"
PAGES_ARROW = pa.schema([("page", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
SUSPECTS_ARROW = pa.schema([("grp", pa.int64()), ("key", pa.binary()), ("docs", pa.int64()), ("last", pa.int64())])
#: Stands below every doc_id for a null one.
NO_ID = -(1 << 63)


def key_of(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z lower-cased, if it has at least so many code points."""
    line = line.strip(BLANKS)
    if len(line) < least:
        return None
    # bytes.lower() leaves all but A-Z as it is; the bytes 10xxxxxx go on a code point.
    if len(line) < 4 * least and not line.isascii() and len(line.decode("utf-8", "replace")) < least:
        return None
    return line.lower()


def keys_of(text: bytes, least: int) -> list[bytes | None]:
    return [key_of(x, least) for x in text.split(b"\n")]


def hashed(keys: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bits of a filter of `size` bits for each hash, a row each: the low and the high half of it."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return np.stack([((low + np.uint64(k) * (high | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64) for k in range(HASHES)], axis=1)


class Filters:
    """Two Bloom filters: of keys that were seen once, and of keys that were seen twice."""

    def __init__(self, size: int) -> None:
        self.size, self.once, self.twice = size, np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """One key of one document for each hash."""
        hashes, counts = np.unique(hashes, return_counts=True)
        at = places(hashes, self.size)
        known = (self.once[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1) | (counts > 1)
        for bits, some in ((self.once, at), (self.twice, at[known])):
            some = some.ravel()
            np.bitwise_or.at(bits, some >> 3, np.left_shift(1, some & 7).astype(np.uint8))

    def pages(self) -> pa.RecordBatch:
        """The pages with any bit; filters of two tasks are merged page by page."""
        once, twice = self.once.reshape(-1, PAGE), self.twice.reshape(-1, PAGE)
        some = np.flatnonzero(once.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([squeezed(x[k]) for k in some], pa.binary()) for x in (once, twice))], schema=PAGES_ARROW)


def squeezed(page: np.ndarray) -> bytes:
    return pa.compress(page.tobytes(), codec="zstd", asbytes=True)


def opened(page: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(page, PAGE, codec="zstd"), np.uint8)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of many tasks, one at a time: a key is seen twice if a task saw it twice, or two tasks saw it."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for page, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
            once, twice = opened(once), opened(twice)
            if page in held:
                before, again = held[page]
                once, twice = before | once, again | twice | (before & once)
            held[page] = once, twice
    numbers = sorted(held)
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(pa.array([squeezed(held[k][i]) for k in numbers], pa.binary()) for i in (0, 1))], schema=PAGES_ARROW)
    held.clear()
    tidy()


def documents(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(group, doc, different keys) of each document that has keys."""
    for b in batches:
        for grp, doc, text in zip(*(b.column(c).to_pylist() for c in ("grp", "doc", "text")), strict=True):
            keys = set(keys_of(text, least))
            keys.discard(None)
            if keys:
                yield grp, doc, list(keys)


class Spread:
    """A filter on the executors: its bytes are at most BITS[1] / 8, whatever the corpus."""

    def __init__(self, spark: SparkSession, pages: DataFrame, column: str, size: int) -> None:
        bits = np.zeros((size // 8 // PAGE, PAGE), np.uint8)
        for r in pages.toLocalIterator():
            bits[r["page"]] = opened(bytes(r[column]))
        self.size, self.shared = size, spark.sparkContext.broadcast(bits.tobytes())

    def has(self) -> Callable[[np.ndarray], np.ndarray]:
        bits = np.frombuffer(self.shared.value, np.uint8)

        def look(hashes: np.ndarray) -> np.ndarray:
            at = places(hashes, self.size)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)

        return look


def filter_size(keys: int) -> int:
    return min(BITS[1], max(BITS[0], 1 << (BITS_EACH * keys).bit_length()))


def filters_of(rows: DataFrame, size: int, keys_in: Callable[[Iterator[pa.RecordBatch]], Iterator[list[bytes]]]) -> DataFrame:
    """The merged pages of the two filters over all the lists of different keys that keys_in() finds."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held, n = Filters(size), [], 0
        for keys in keys_in(batches):
            held.append(hashed(keys))
            n += len(keys)
            if n > AT_ONCE:
                filters.add(np.concatenate(held))
                held, n = [], 0
        if held:
            filters.add(np.concatenate(held))
        yield filters.pages()
        del filters
        tidy()

    return rows.mapInArrow(fill, PAGES).repartition(task_groups(rows.sparkSession), "page").mapInArrow(merged, PAGES)


def suspects_of(rows: DataFrame, twice: Spread, least: int) -> DataFrame:
    """(grp, key, docs, last) for the keys that the second filter has: how many documents of a task and a group hold the key, and the largest doc_id of them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = twice.has()
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in held], pa.int64()), pa.array([k for _, k in held], pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], schema=SUSPECTS_ARROW
            )

        for grp, doc, keys in documents(batches, least):
            for key, found in zip(keys, has(hashed(keys)), strict=True):
                if found:
                    own = held.get((grp, key))
                    if own is None:
                        held[grp, key] = [1, doc]
                        size += len(key) + 200
                    else:
                        own[0] += 1
                        own[1] = max(own[1], doc)
            if size > HELD:
                yield rows_of()
                held.clear()
                size = 0
        yield rows_of()
        held.clear()
        tidy()

    return rows.mapInArrow(look, SUSPECTS)


def dedup(docs: DataFrame, least: int = 20, documents_at_least: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) plus n_lines, n_dropped and kept, the text of the lines that stay.

    A text is cut at every \\n; a null text is an empty one, and an empty one has one empty line. A line's key is the line without blanks at its ends, A-Z lower-cased. A key of
    `least` code points or more that `documents_at_least` documents hold loses all its lines but those in the document with the largest doc_id of them; a key that comes
    several times in one document counts once. Each row is a document: rows that repeat a doc_id count each, and all rows with the largest doc_id keep their lines; a null
    doc_id is smaller than any.

    Every task fills two filters, of keys seen once and of keys seen twice; merged, the second names every key that two documents hold, and few others. Only the keys that it
    names are shuffled, once for each task and group of documents, and counted as they are, so that a filter never decides. Then a filter of the keys
    that lose lines tells the documents that need a look; only these are shuffled, to meet what their group asks for. Filters have 16 bits a key and 32 MB
    at most: where a corpus has far more lines than that, more keys are named and shuffled, and results are the same.

    keep names the columns of docs to return, all unless given; columns named like an added column are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    plain = docs.select(text.alias("text"), doc.alias("doc"))
    size = int(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = max(task_groups(spark), -(-size // GROUP_BYTES))
    group = F.pmod(F.xxhash64("doc", "text"), F.lit(groups)).alias("grp")
    plain = plain.select(group, "doc", "text")

    size = filter_size(size // LINE_BYTES)
    filters = filters_of(plain, size, lambda batches: (keys for _, _, keys in documents(batches, least)))
    suspects = stored(suspects_of(plain, Spread(spark, filters.select("page", "twice"), "twice", size), least), "lines-suspects")
    lost = suspects.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= documents_at_least).select("key", "last")
    lost = stored(lost, "lines-lost")
    size = filter_size(lost.count())
    filters = filters_of(lost.select("key"), size, lambda batches: (b.column("key").to_pylist() for b in batches))
    losing = Spread(spark, filters.select("page", "once"), "once", size)

    @F.arrow_udf("struct<lines:bigint,named:boolean>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        has = losing.has()
        for texts in batches:
            lines, named = [], []
            for t in texts.to_pylist():
                keys = [k for k in keys_of(t, least) if k is not None]
                lines.append(t.count(b"\n") + 1)
                named.append(bool(keys) and bool(has(hashed(keys)).any()))
            yield pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(named, pa.bool_())], ["lines", "named"])
        tidy()

    columns = docs.columns if keep is None else list(keep)
    rows = packed(docs, keep, text=text, doc=doc).withColumn("seen", look("text"))
    clean = rows.where("NOT seen.named").select("row", F.col("seen.lines").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    named = rows.where("seen.named").select("row", "doc", "text", F.col("seen.lines").alias("n_lines"), group)
    asked = suspects.select("grp", "key").distinct().join(lost, "key").select("grp", "key", "last")

    def drop(texts: pa.Table, asked: pa.Table) -> pa.Table:
        last = dict(zip(asked["key"].to_pylist(), asked["last"].to_pylist(), strict=True))
        kept, dropped = [], []
        for doc, text in zip(texts["doc"].to_pylist(), texts["text"].to_pylist(), strict=True):
            lines = text.split(b"\n")
            stay = [x for x in lines if (k := key_of(x, least)) is None or last.get(k, doc) == doc]
            kept.append(b"\n".join(stay))
            dropped.append(len(lines) - len(stay))
        return pa.table([texts["row"], texts["n_lines"], pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["row", *ADDED])

    schema = StructType([rows.schema["row"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType())])
    changed = named.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(drop, schema)
    return unpacked(clean.unionByName(changed).withColumn("kept", F.col("kept").cast("string")), columns, ADDED)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that three documents hold, each kept in the last of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, keep=["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (
  SELECT doc_id, i, x[i] AS line, translate(regexp_replace(x[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), k AS (
  SELECT key, max(doc_id) AS winner FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (winner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (winner IS NULL OR winner = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""

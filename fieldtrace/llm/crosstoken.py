"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often each two ids meet in the corpus."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldtrace.llm.bpe import REMEMBERED, Encoder, Remembered, Vocabulary, gathered
from fieldtrace.llm.common import packed, small_batches, stored, tidy, unpacked

ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
COUNTS = ADDED[:4]
#: Characters that one step handles; bytes of text that share one table of windows and pairs.
STEP, PORTION = 500_000, 16 << 20
#: A word with the spaces before it, or spaces alone: no piece of the second tokenizer reaches over the end of one.
SEGMENT = re.compile(r" *[^ ]+| +")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
#: What stands after a token in the text of groups: within a side, between the sides, between groups, between windows.
SEPARATORS = [",", "|", ";", "\n"]


class Pieces:
    """The second tokenizer: a SentencePiece model that puts a space before a text and takes bytes for what it does not know."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = []
        for piece in map(self.model.id_to_piece, range(self.model.get_piece_size())):
            byte = BYTE.fullmatch(piece)
            parts.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.space = np.array([x.startswith(b" ") for x in parts])
        self.alone = self.model.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known = Remembered()
        self.tokens, self.at, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        new, self.known.new = self.known.new, []
        if not new:
            return
        # The model puts the first space back; of one space alone nothing is left to put it before.
        found = [ids if s != " " else [self.alone] for s, ids in zip(new, self.model.encode([s[1:] for s in new], num_threads=1), strict=True)]
        counts = np.array([len(x) for x in found], np.int64)
        self.at = np.concatenate([self.at, len(self.tokens) + np.cumsum(counts) - counts])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum()))
        self.tokens = np.concatenate([self.tokens, flat])
        self.counts = np.concatenate([self.counts, counts])

    def batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, each of which begins with a space, and how many each has: those of the words one after the other."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words += SEGMENT.findall(text)
            ends[k] = len(words)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.learn()
        counts = self.counts[number]
        total = np.concatenate([[0], np.cumsum(counts)])
        return gathered(self.tokens, self.at[number], counts), np.diff(total[np.concatenate([[0], ends])])


class Aligner:
    """Aligns documents by windows of tokens, and remembers each window by its ids."""

    def __init__(self, a: Vocabulary, model: bytes) -> None:
        self.a, self.b, self.encoder = a, Pieces(model), Encoder(a)
        self.encoder.special = None  # strings of special tokens are plain text
        self.space_a = np.array([n > 0 and a.pool[s] == 32 for s, n in zip(a.starts, a.lengths, strict=True)])
        self.first_b = len(a.lengths)
        self.names = [str(k) for k in range(max(self.first_b, len(self.b.lengths)))]
        self.begin()

    def begin(self) -> None:
        """A new portion: windows and pairs are numbered anew."""
        self.windows, self.texts, self.bytes = Remembered(), [], 0
        self.links: list[np.ndarray] = []
        self.per_window = np.zeros((len(COUNTS), 0), np.int64)
        self.seen = np.zeros(0, np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[str]]:
        """The counts of each text, the windows it is made of, and its groups as text."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        self.bytes += sum(map(len, raw))
        some = [" " + t for t in texts if t]
        places = [k for k, t in enumerate(texts) if t]
        ids_a, n_a = self.encoder.batch(some)
        ids_b, n_b = self.b.batch(some)
        size_a, size_b = self.a.lengths[ids_a], self.b.lengths[ids_b]
        owner_a, owner_b = np.repeat(np.arange(len(some)), n_a), np.repeat(np.arange(len(some)), n_b)
        good = self.true_to(raw, places, (self.a, ids_a, size_a, owner_a), (self.b, ids_b, size_b, owner_b))
        keep_a, keep_b = good[owner_a], good[owner_b]
        ids_a, size_a, owner_a, ids_b, size_b, owner_b = ids_a[keep_a], size_a[keep_a], owner_a[keep_a], ids_b[keep_b], size_b[keep_b], owner_b[keep_b]
        refs = [np.zeros(0, np.int32)] * len(texts)
        if not len(ids_a):
            return np.zeros((len(COUNTS), len(texts)), np.int64), refs, [""] * len(texts)

        # Verified ends that both share, before tokens of both that begin with a space, or at the end of a document.
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        both = ends_of(ends_a, ends_b) == 3
        at_a, at_b = np.flatnonzero(both[ends_a]), np.flatnonzero(both[ends_b])
        next_a, next_b = np.minimum(at_a + 1, len(ids_a) - 1), np.minimum(at_b + 1, len(ids_b) - 1)
        over = (at_a == len(ids_a) - 1) | (owner_a[next_a] != owner_a[at_a])
        anchor = over | (self.space_a[ids_a[next_a]] & self.b.space[ids_b[next_b]])
        to_a, to_b = at_a[anchor] + 1, at_b[anchor] + 1
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])

        # A window is the ids of the first tokenizer, then those of the second, numbered after all of the first.
        mixed = np.empty(len(ids_a) + len(ids_b), np.int32)
        mixed[np.arange(len(ids_a)) + np.repeat(from_b, to_a - from_a)] = ids_a
        mixed[np.arange(len(ids_b)) + np.repeat(to_a, to_b - from_b)] = ids_b + self.first_b
        flat, cuts = mixed.tobytes(), (4 * np.append(0, to_a + to_b)).tolist()
        number = np.fromiter(map(self.windows.__getitem__, (flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False))), np.int32, len(to_a))
        self.learn()
        self.seen += np.bincount(number, minlength=len(self.seen))

        counts = np.zeros((len(COUNTS), len(texts)), np.int64)
        groups = [""] * len(texts)
        owner = owner_a[to_a - 1]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for lo, hi in zip(first, np.append(first[1:], len(owner)), strict=True):
            k, own = places[owner[lo]], number[lo:hi]
            refs[k] = own
            counts[:, k] = self.per_window[:, own].sum(axis=1)
            groups[k] = ";".join(map(self.texts.__getitem__, own.tolist()))
        return counts, refs, groups

    def true_to(self, raw: list[bytes], places: list[int], *sides: tuple) -> np.ndarray:
        """Which texts both tokenizers' bytes give back."""
        good = np.ones(len(places), bool)
        wanted = b"".join(raw)
        for side, ids, sizes, owner in sides:
            got = gathered(side.pool, side.starts[ids], sizes).tobytes()
            if got != wanted:
                ends = np.append(0, np.cumsum(np.bincount(owner, sizes, minlength=len(places)).astype(np.int64)))
                good &= np.array([got[ends[k] : ends[k + 1]] == raw[p] for k, p in enumerate(places)], bool)
        return good

    def learn(self) -> None:
        """Aligns the windows that are new, all at once: their bytes stand one after the other for both tokenizers."""
        new, self.windows.new = self.windows.new, []
        if not new:
            return
        flat = np.frombuffer(b"".join(new), np.int32)
        window = np.repeat(np.arange(len(new)), [len(x) >> 2 for x in new])
        second = flat >= self.first_b
        a, b, in_a, in_b = flat[~second], flat[second] - self.first_b, window[~second], window[second]
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        marks = ends_of(ends_a, ends_b)
        # Between two ends next to each other lie bytes of one token of each: a link.
        ends = np.flatnonzero(marks)
        of_a, of_b, of_both = (marks[ends] & 1).astype(bool), (marks[ends] & 2).astype(bool), marks[ends] == 3
        link_a, link_b, group = (np.cumsum(x) - x for x in (of_a, of_b, of_both))
        self.links.append(a[link_a].astype(np.int64) << 32 | b[link_b])
        of = lambda x: np.bincount(x, minlength=len(new))
        counts = np.stack([of(in_a), of(in_b), of(in_a[link_a[of_both]]), of(in_a[link_a])])
        self.per_window = np.concatenate([self.per_window, counts], axis=1)
        self.seen = np.append(self.seen, np.zeros(len(new), np.int64))

        group_a, group_b, groups = group[of_a], group[of_b], int(of_both.sum())
        in_group_a, in_group_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        at_a = np.arange(len(a)) + (np.cumsum(in_group_b) - in_group_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_group_a)[group_b]
        ids, after = np.empty(len(flat), np.int64), np.zeros(len(flat), np.int64)
        ids[at_a], ids[at_b] = a, b
        after[at_a[of_both[of_a]]] = 1
        last = at_b[of_both[of_b]]
        after[last] = 2
        after[at_b[np.append(in_b[1:] != in_b[:-1], True)]] = 3
        out = [""] * (2 * len(flat))
        out[::2], out[1::2] = map(self.names.__getitem__, ids.tolist()), map(SEPARATORS.__getitem__, after.tolist())
        self.texts += "".join(out).split("\n")[:-1]

    def pairs(self) -> tuple[pa.ListArray, bytes, bytes]:
        """The portion's different pairs with their links, the pairs of each window, and where each window's end."""
        links = np.concatenate([np.zeros(0, np.int64), *self.links])
        different, number = np.unique(links, return_inverse=True)
        n = np.bincount(number, np.repeat(self.seen, self.per_window[3]), minlength=len(different)).astype(np.int64)
        arrays = [pa.array((different >> 32).astype(np.int32)), pa.array((different & 0xFFFFFFFF).astype(np.int32)), pa.array(n)]
        found = pa.StructArray.from_arrays(arrays, fields=list(PAIRS.value_type))
        return pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), number.astype(np.int32).tobytes(), np.cumsum(self.per_window[3]).tobytes()


def ends_of(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each byte offset 1 if a token of the first ends there, 2 for the second, 3 for both."""
    marks = np.zeros(max(ends_a[-1], ends_b[-1]) + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] += 2
    return marks


def runs_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about STEP characters; a longer text stands alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > STEP:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def settle(docs: pa.Table, values: pa.Table) -> pa.Table:
    """The sums over each document's links, from the corpus-wide count of each pair of its portion."""
    about = docs.filter(pc.is_valid(docs["ends"]))
    docs = docs.filter(pc.is_null(docs["ends"]))
    out = np.zeros((2, len(docs)), np.int64)
    if len(about) and len(values):
        links, ends = np.frombuffer(about["links"][0].as_py(), np.int32), np.frombuffer(about["ends"][0].as_py(), np.int64)
        at = values["i"].to_numpy()
        for k, name in enumerate(("best", "count")):
            value = np.zeros(int(at.max()) + 1, np.int64)
            value[at] = values[name].to_numpy()
            total = np.append(0, np.cumsum(value[links]))
            window = np.diff(total[np.append(0, ends)])
            out[k] = [window[np.frombuffer(r, np.int32)].sum() for r in docs["refs"].to_pylist()]
    columns = [docs["row"], *(docs[c] for c in COUNTS), pa.array(out[0]), pa.array(out[1]), docs["groups"]]
    return pa.table(columns, ["row", *ADDED])


def align(docs: DataFrame, a_path: str, b_path: str, keep: Sequence[str] | None = None, groups: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs (text, ...) plus n_a, n_b (tokens of the two tokenizers), n_groups, n_links, n_best, count_sum and groups, such as `7,8|3;9|4,5`: ids of the first and of the second tokenizer
    that cover the same bytes, cut wherever tokens of both end.

    a_path is a tokenizer file with byte-level BPE, which encodes a space and the text; b_path a SentencePiece model that puts a space before a text and falls back to bytes. Strings
    of special tokens are plain text. Two tokens are linked where their bytes overlap; the count of two ids is how many links of the whole corpus hold them; n_best counts the
    links whose count is the highest of their second id, ties included, and count_sum sums the counts of all links. `groups` maps the groups' column to what is kept of it, such as a hash, where it is
    made: the groups of a corpus are larger than its texts.

    Texts that are null, empty or whose tokens' bytes differ from a space and the text have zeros and ''. Every text is aligned by itself: it is tokenised whole, cut into windows at ends that both share
    before tokens that begin with a space, and each window of ids is aligned once in about 16 MB of texts, a portion. A portion asks for the counts of its own pairs, once each, so a frequent pair sends a row a portion;
    a task's memory follows a portion or its longest text. Repeated rows count each; columns of docs named like an added column are replaced; keep names those to return, all unless given. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(b_path, "rb") as f:
        shared = spark.sparkContext.broadcast((Vocabulary(a_path), f.read()))
    rows = packed(docs, keep, text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    row = StructField("row", rows.schema["row"].dataType)  # null in the row of a portion
    own = StructType([StructField("portion", LongType()), row, *[StructField(c, LongType()) for c in COUNTS], StructField("groups", StringType())])
    for_portions = StructType.fromDDL("refs binary, pairs array<struct<a:int,b:int,n:bigint>>, links binary, ends binary")
    schema = StructType([*own, *for_portions])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        portion, kind = TaskContext.get().partitionId() << 24, None

        def closed() -> pa.RecordBatch:
            pairs, links, ends = aligner.pairs()
            nothing = [pa.nulls(1, t) for t in (kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([portion]), *nothing, pairs, pa.array([links], pa.binary()), pa.array([ends], pa.binary())], names=schema.names)

        for b in batches:
            kind = b.column("row").type
            texts = b.column("text").to_pylist()
            for lo, hi in runs_of(texts):
                counts, refs, made = aligner.align(texts[lo:hi])
                n = hi - lo
                rows = [pa.array([portion] * n), b.column("row").slice(lo, n), *map(pa.array, counts), pa.array(made, pa.string()), pa.array([r.tobytes() for r in refs], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, PAIRS), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=schema.names)
                if aligner.bytes > PORTION:
                    yield closed()
                    aligner.begin()
                    portion += 1
        if kind is not None:
            yield closed()
        del aligner
        tidy()

    made = rows.mapInArrow(run, schema)
    text = F.col("groups") if groups is None else F.when(F.col("groups") == "", "").otherwise(groups(F.col("groups")))
    aligned, beside = stored(made.withColumn("groups", text), "alignment", 2)
    pairs = beside.where("pairs IS NOT NULL").select("portion", F.posexplode("pairs").alias("i", "pair")).select("portion", "i", "pair.a", "pair.b", "pair.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long"))
    values = pairs.select("portion", "i", "a", "b").join(counts, ["a", "b"]).select("portion", "i", "count", "best")
    out = StructType([row, *[StructField(c, LongType()) for c in ADDED[:-1]], StructField("groups", StringType())])
    portions = aligned.select("portion", "row", *COUNTS, "groups", "refs", "links", "ends").groupBy("portion")
    done = portions.cogroup(values.groupBy("portion")).applyInArrow(settle, out)
    return unpacked(done, docs.columns if keep is None else list(keep), ADDED)


def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents' tokens, groups as their hash."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(docs, *paths, keep=["doc_id"], groups=lambda c: F.sha2(c, 256)).withColumnRenamed("groups", "groups_sha256")

"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import small_batches, tidy

#: How byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 characters alone, which the faster module can take.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN = f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Characters that one step handles, and words that a worker remembers.
STEP, REMEMBERED = 1_000_000, 150_000
NONE = np.iinfo(np.int64).max


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Sorted pair keys with their ranks and results, and the bytes of each token, as flat arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, characters = file["model"]["vocab"], byte_characters()
        added = {x["content"]: x["id"] for x in file.get("added_tokens", ())}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bytes = np.zeros(256, np.int64)
        for c, b in characters.items():
            self.bytes[b] = ids[c]
        tokens = {i: bytes(characters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.added = added


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of pool one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def merge_rounds(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many words: symbols holds the words' bytes as tokens, one word after the other. Gives the tokens and each word's count.

    Each round joins, in every word, all places of its lowest-ranked pair; words without a pair leave.
    """
    words = len(lengths)
    word = np.repeat(np.arange(words), lengths)
    done_word, done_symbol = [], []
    while len(symbols):
        last = np.empty(len(word), bool)
        last[-1], last[:-1] = True, word[1:] != word[:-1]
        pair = symbols << 32
        pair[:-1] |= symbols[1:]
        at = np.searchsorted(v.keys, pair)
        at[at == len(v.keys)] = 0
        rank = np.where((v.keys[at] == pair) & ~last, v.ranks[at], NONE)
        first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        sizes = np.diff(np.append(first, len(word)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
        over = lowest == NONE
        if over.any():
            done_word.append(word[over])
            done_symbol.append(symbols[over])
            stay = ~over
            word, symbols, rank, lowest = word[stay], symbols[stay], rank[stay], lowest[stay]
            if not len(word):
                break
        join = rank == lowest
        # Of overlapping places, as in "aaa", every second one counts.
        run = join.copy()
        run[1:] &= ~join[:-1]
        index = np.arange(len(join))
        join &= (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
        symbols = np.where(join, v.merged[np.where(join, rank, 0)], symbols)
        keep = np.ones(len(join), bool)
        keep[1:] = ~join[:-1]
        word, symbols = word[keep], symbols[keep]
    if not done_word:
        return symbols, np.zeros(words, np.int64)
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=words)


class Remembered(dict):
    """Numbers words as they come; new ones wait in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.fast, self.full = re.compile(LATIN), regex.compile(WORDS)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.forget()

    def forget(self) -> None:
        self.known = Remembered()
        self.pool, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full.findall(text)
        return self.fast.findall(text)

    def words(self, text: str) -> list:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return [w for k, x in enumerate(parts) for w in ((("added", x),) if k % 2 else self.plain(x))]

    def learn(self) -> None:
        new, self.known.new = self.known.new, []
        if not new:
            return
        raw = [b"" if isinstance(w, tuple) else w.encode() for w in new]
        lengths = np.array([len(x) for x in raw], np.int64)
        tokens, counts = merge_rounds(self.v, self.v.bytes[np.frombuffer(b"".join(raw), np.uint8)], lengths)
        special = [k for k, w in enumerate(new) if isinstance(w, tuple)]
        if special:
            ends = np.cumsum(counts)
            tokens = np.insert(tokens, [ends[k] for k in special], [self.v.added[new[k][1]] for k in special])
            counts[special] = 1
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, tokens.astype(np.int32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, counts])

    def batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words: list = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words += self.words(text)
            ends[k] = len(words)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.learn()
        lengths = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return gathered(self.pool, self.starts[at], lengths), np.diff(total[np.concatenate([[0], ends])])


def slices(texts: list[str], most: int = STEP) -> Iterator[list[str]]:
    """Runs of texts with about `most` characters; a longer text stands alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts[start:]:
        yield texts[start:]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df plus the column ids, array<int>: the tokens of the whole text, a null text as an empty one: [].

    path is a tokenizer file with byte-level BPE. Strings of its added tokens become those tokens. Every text is
    encoded by itself, so ties, repeats and other columns play no part; a column named like ids is replaced.
    """
    small_batches(df.sparkSession)
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(v.value)
        for texts in batches:
            parts, counts = [], [np.zeros(1, np.int64)]
            for some in slices(texts.to_pylist()):
                got, n = encoder.batch(some)
                parts.append(got)
                counts.append(n)
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(tokens.astype(np.int32)))
        del encoder
        tidy()

    return df.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df plus the column text: what the tokens stand for; bytes that are not UTF-8 become U+FFFD. Null ids give null, [] gives ''; null, negative and too large
    numbers among the ids stand for nothing."""
    small_batches(df.sparkSession)
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            if lists.null_count:
                lists = pa.array(lists.to_pylist(), pa.list_(pa.int32()))
            ends = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            out: list[str | None] = []
            for k in range(len(ends) - 1):
                own = tokens[ends[k] : ends[k + 1]]
                own = own[(own >= 0) & (own < len(v.value.starts))]
                out.append(None if missing[k] else gathered(v.value.pool, v.value.starts[own], v.value.lengths[own]).tobytes().decode("utf-8", "replace"))
            yield pa.array(out, pa.string())
        tidy()

    return df.withColumn(text, run(F.col(ids)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hashes of all documents' tokens, and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(tokens, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Toxicity by nearest labelled examples: exact TF-IDF cosine of whole texts over an inverted index of all terms of the examples."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import cut, small_batches, tidy

ADDED = ["held_out", "score", "predicted", "evidence"]
TERM = re.compile(r"[^\W_]+")
#: Examples of each class at most.
EXAMPLES = 4000
#: Bytes of all examples' texts together.
EXAMPLE_BYTES = 64 << 20
#: Examples of a block of postings, neighbours that vote, evidence shown, distance that is added to each.
BLOCK, NEIGHBOURS, SHOWN, NEAR = 64, 25, 3, 0.05
#: Terms in most examples, whose weights are dense blocks, texts that meet them at once, and blocks that every text meets first.
DENSE, AT_ONCE, FIRST = 512, 128, 4
FOUND = "struct<mark:bigint,own:double,places:array<int>,dots:array<double>>"
FOUND_ARROW = pa.struct([("mark", pa.int64()), ("own", pa.float64()), ("places", pa.list_(pa.int32())), ("dots", pa.list_(pa.float64()))])
SCORE = "struct<score:double,evidence:array<struct<doc_id:bigint,similarity:double,toxic:int>>>"
SCORE_ARROW = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))])


class Index:
    """All terms of the examples, their weights (`idf`), and of each term its postings: places of examples and the unit vectors' weights there.

    Examples of one label and one heaviest term stand together, in blocks of BLOCK; places are padded to whole blocks. The terms that most
    examples have are dense: of each block its weights and its largest ones, made where they are used.
    """

    def __init__(self, terms: dict[str, int], idf: np.ndarray, docs: np.ndarray, toxic: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, prior: float) -> None:
        """terms: the place of each; counts: of each example its terms and how often it has each."""
        idle = np.array([not len(c[0]) for c in counts], bool)
        self.rest = float((weight[idle] * toxic[idle]).sum()) / float(weight[idle].sum() + 1)
        self.terms, self.idf, self.prior = terms, idf, prior
        heaviest = np.array([t[np.argmax((1 + np.log(c)) * idf[t])] if len(t) else -1 for t, c in counts], np.int64)
        order = np.lexsort((docs, heaviest, toxic))
        order = order[~idle[order]]
        sizes = np.array([len(counts[k][0]) for k in order], np.int64)
        place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        term = np.concatenate([np.zeros(0, np.int64), *(counts[k][0] for k in order)]).astype(np.int64)
        raw = (1 + np.log(np.concatenate([np.zeros(0), *(counts[k][1] for k in order)]))) * idf[term]
        length = np.sqrt(np.bincount(place, raw * raw, minlength=len(order)))
        by_term = np.argsort(term, kind="stable")
        self.places, self.values = place[by_term], (raw / length[place])[by_term]
        self.starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))))
        pad = -len(order) % BLOCK
        self.docs, self.toxic, self.weight = (np.append(x[order], np.full(pad, fill, x.dtype)) for x, fill in ((docs, np.iinfo(np.int64).max), (toxic, 0), (weight, 0.0)))
        self.common = np.argsort(-np.diff(self.starts), kind="stable")[:DENSE]
        self.blocks = None

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[terms]

    def dense(self) -> None:
        """The blocks' weights of the common terms, and the largest of each term in each block."""
        whole = np.zeros((len(self.common), len(self.docs)))
        self.column = np.full(len(self.terms), -1)
        self.column[self.common] = np.arange(len(self.common))
        for k, t in enumerate(self.common):
            at = slice(self.starts[t], self.starts[t + 1])
            whole[k, self.places[at]] = self.values[at]
        whole = whole.reshape(len(self.common), -1, BLOCK)
        self.largest = whole.max(axis=2, initial=0.0)
        self.blocks = np.ascontiguousarray(whole.transpose(1, 0, 2))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the places of the k examples with the largest products, ties to the smaller doc_id, and the products.

        The rarer terms' postings are summed up whole. A block's products are then at most its largest such sum and the weighted largest
        weights of the common terms; only blocks that may reach the k-th best product so far meet the query with all their weights.
        """
        if not len(self.docs):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if self.blocks is None:
            self.dense()
        common, sums = np.zeros((len(queries), len(self.common))), np.zeros((len(queries), len(self.docs)))
        for row, total, (terms, weights) in zip(common, sums, queries, strict=True):
            column = self.column[terms]
            row[column[column >= 0]] = weights[column >= 0]
            terms, weights = terms[column < 0], weights[column < 0]
            size = self.starts[terms + 1] - self.starts[terms]
            at = np.repeat(self.starts[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if len(at):
                total += np.bincount(self.places[at], self.values[at] * np.repeat(weights, size), minlength=len(total))
        sums = sums.reshape(len(queries), -1, BLOCK)
        bound = (common @ self.largest + sums.max(axis=2)) * (1 + 1e-12)
        out = np.full(sums.shape, -1.0)

        def meet(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                out[rows, b] = sums[rows, b] + common[rows] @ self.blocks[b]

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        meet(first)
        flat = out.reshape(len(queries), -1)
        so_far = np.partition(flat, flat.shape[1] - min(k, flat.shape[1]), axis=1)[:, flat.shape[1] - min(k, flat.shape[1])]
        meet(~first & (bound > 0) & (bound >= so_far[:, None] * (1 - 1e-10)))
        return [self.best(row, k) for row in flat]

    def best(self, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k largest of a query's products above 0, ties (to 12 decimals of the largest) to the smaller doc_id."""
        k = min(k, len(products))
        if not k or products.max() <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        least = np.partition(products, len(products) - k)[len(products) - k]
        some = np.flatnonzero((products >= least - 1e-11 * products.max()) & (products > 0))
        step = 1e-12 * products.max()
        some = some[np.lexsort((self.docs[some], -np.round(products[some] / step)))][:k]
        return some, products[some]

    def score(self, own: float, ids: np.ndarray, dots: np.ndarray) -> tuple[float, list[dict]]:
        """From the length of a whole text's weights, and its products with the nearest examples."""
        if not own:
            return self.rest, []
        if not len(ids):
            return self.prior, []
        sims = np.minimum(1.0, dots / own)
        votes = self.weight[ids] / (np.maximum(0, 1 - sims) + NEAR)
        score = float(min(1.0, max(0.0, (votes @ self.toxic[ids] + self.prior) / (votes.sum() + 1))))
        return score, [{"doc_id": int(self.docs[i]), "similarity": float(s), "toxic": int(self.toxic[i])} for i, s in zip(ids[:SHOWN], sims[:SHOWN], strict=True)]


def counted(words: list[str], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of words, and how often each stands there."""
    return np.unique(np.array([t for t in map(terms.get, words) if t is not None], np.int64), return_counts=True)


def text_mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def texts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    return ((b, b.column("text").to_pylist()) for b in batches)


class Fitted:
    """An index, and of the texts that it was fitted on the squared weights of terms that no example has (mark, beside)."""

    def __init__(self, index: Index, beside: DataFrame) -> None:
        self.index, self.beside = index, beside

    def __getattr__(self, name: str):
        return getattr(self.index, name)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES) -> Fitted:
    """The index of at most `examples` labelled texts of each class (those with the smallest hashes of doc_id); all that it holds is so bounded.

    Of the texts drawn, those count that stand, in the order of their hashes, before example_bytes bytes are used up, in all; so neither rows nor bytes
    of the driver grow with the corpus. Labels are 0 or 1, of any type that casts to a number, or booleans. Only labels whose crc32(doc_id as text) mod 5 is not 0 count. Of several labels of one document the larger counts; null labels and
    labels without a document don't. Equal texts are one example with the smallest doc_id of them, labelled 1 if one of them is. The index holds
    every term of the examples (runs of letters and digits, lower-cased); a term weighs its inverse document frequency, counted over all of docs, times 1 and the
    log-likelihood ratio of its shares in the two classes, so that terms that tell the classes apart weigh more and none is left out.
    """
    known = labels.select("doc_id", F.expr("try_cast(toxic AS double)").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = cut(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    drawn = F.broadcast(cut(drawn[0].unionByName(drawn[1])))  # at most 2 * examples rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id")

    one = texts.groupBy(F.md5("text").alias("digest"), F.octet_length("text").alias("bytes")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    one = cut(one)
    before = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most 2 * examples rows of two numbers
    within = F.broadcast(one.select("doc_id", before.alias("used")).where(F.col("used") <= example_bytes).select("doc_id"))
    texts = cut(one.join(within, "doc_id").select("doc_id", "toxic", "text"))
    found = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, some in texts_in(batches):
            seen: Counter = Counter()
            for text, toxic in zip(some, b.column("toxic").to_pylist(), strict=True):
                seen.update((w, toxic) for w in set(TERM.findall(text.lower())))
            words = sorted({w for w, _ in seen})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w, 1] for w in words], pa.int64()), pa.array([seen[w, 0] for w in words], pa.int64())], ["term", "a", "b"])

    per_term = texts.mapInArrow(terms_of, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(max(1, n1 + n0))
    surprise = lambda x, of: F.when(x > 0, x * F.log(x * n / ((a + b) * float(max(1, of))))).otherwise(0.0)
    clear = F.greatest(F.lit(0.0), 2 * (surprise(a, n1) + surprise(b, n0)))
    per_term = per_term.select("term", clear.alias("clear")).toArrow().sort_by("term")  # the vocabulary of at most 2 * examples texts
    terms, clear = {t: k for k, t in enumerate(per_term["term"].to_pylist())}, per_term["clear"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(null, place, texts with it), the number of texts under the place after the last; and (mark of a text, hash of a term that no example has, how often)."""
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        kinds = [pa.int64()] * 3
        for _, some in texts_in(batches):
            total[-1] += len(some)
            rows: tuple[list, list, list] = ([], [], [])
            for text in some:
                words = Counter(TERM.findall(text.lower()))
                total[np.array([t for t in map(known.get, words) if t is not None], np.int64)] += 1
                strange = [w for w in words if w not in known]
                if strange:
                    rows[0].extend([text_mark(text)] * len(strange))
                    rows[1].extend([xxhash.xxh3_64_intdigest(w) >> 1 for w in strange])
                    rows[2].extend([words[w] for w in strange])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["mark", "term", "n"])
        at = np.flatnonzero(total)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at), pa.array(total[at])], ["mark", "term", "n"])

    whole = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    seen = cut(whole.mapInArrow(frequencies, "mark long, term long, n long"))
    in_docs = np.zeros(len(terms) + 1, np.int64)
    of_terms = seen.where("mark IS NULL").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    in_docs[of_terms["term"].to_numpy()] = of_terms["n"].to_numpy()
    all_docs = int(in_docs[-1])
    idf = (np.log((1 + all_docs) / (1 + in_docs[:-1])) + 1) * (1 + clear)
    # Squared weights of each text's terms that no example has; equal texts are one mark.
    strange = seen.where("mark IS NOT NULL").groupBy("mark", "term").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    strange_idf = strange.groupBy("term").agg((F.log(F.lit(1.0 + all_docs) / (1 + F.sum("texts"))) + 1).alias("idf"))
    beside = cut(strange.join(strange_idf, "term").groupBy("mark").agg(F.sum(F.pow((1 + F.log("n")) * F.col("idf"), 2)).alias("beside")))

    def example_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b, some in texts_in(batches):
            counts = [counted(TERM.findall(t.lower()), known) for t in some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *(pa.array([c[k] for c in counts], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "toxic", "terms", "counts"])

    rows = texts.mapInArrow(example_counts, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")  # at most 2 * examples
    shared.unpersist()
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    counts = [(t.values.to_numpy(), c.values.to_numpy()) for t, c in zip(rows["terms"], rows["counts"], strict=True)]
    share = {y: sizes.get(y, 0) / max(1, found.get(y, 0)) for y in (0, 1)}
    index = Index(terms, idf, rows["doc_id"].to_numpy().astype(np.int64), toxic, counts, np.array([share[int(y)] for y in toxic], float), prior)
    return Fitted(index, beside)


def score(docs: DataFrame, fitted: Fitted, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) plus held_out, score (0 to 1), predicted (score >= 0.5), evidence (the nearest examples).

    docs are rows of the table that was fitted on. The whole text is compared with every example that has a term in common, by cosine of weights
    (1 + log tf) * idf; terms that no example has count in the length of the text. The 25 nearest vote, weighted by 1 / (distance + 0.05) and by how many
    labelled documents an example stands for, with the share of label 1 as one more vote. A text without any term, an empty or null one among them,
    scores as the examples without terms do, or 0. held_out tells the rows that fit() never learns from; a null doc_id is one of them. Columns of docs named like an added
    column are replaced; keep names the columns of docs to return, all unless given. Rows are scored one by one, so repeated rows get equal scores and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted.index)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, known = shared.value, {}
        for texts in batches:
            texts = texts.to_pylist()
            marks = [text_mark(t) for t in texts]
            if len(known) > 10_000:
                known.clear()
            new = list({m: t for m, t in zip(marks, texts, strict=True) if m not in known}.items())
            for lo in range(0, len(new), AT_ONCE):
                some = new[lo : lo + AT_ONCE]
                terms = [counted(TERM.findall(t.lower()), index.terms) for _, t in some]
                queries = [(t, index.weights(t, n)) for t, n in terms]
                for (mark, _), (_, weights), (ids, dots) in zip(some, queries, index.nearest(queries, NEIGHBOURS), strict=True):
                    known[mark] = float(weights @ weights), ids, dots
            own, ids, dots = zip(*(known[m] for m in marks), strict=True) if marks else ((), (), ())
            lists = lambda x, t: pa.array(x, pa.list_(t))
            yield pa.StructArray.from_arrays([pa.array(marks, pa.int64()), pa.array(own, pa.float64()), lists(ids, pa.int32()), lists(dots, pa.float64())], fields=list(FOUND_ARROW))
        index.blocks = None
        known.clear()
        tidy()

    @F.arrow_udf(SCORE)
    def vote(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = shared.value
        for own, places, dots in batches:
            own = np.sqrt(own.to_numpy(zero_copy_only=False))
            out = [index.score(o, p.values.to_numpy(), d.values.to_numpy(zero_copy_only=False)) for o, p, d in zip(own, places, dots, strict=True)]
            yield pa.array([{"score": s, "evidence": e} for s, e in out], SCORE_ARROW)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    row = F.struct(*[docs[c] for c in kept]) if kept else F.lit(0)
    near = docs.select(row.alias("row"), held_out.alias("held_out"), run(F.coalesce("text", F.lit(""))).alias("found_"))
    beside = fitted.beside.select(F.col("mark").alias("mark_"), F.col("beside").alias("beside_"))
    near = near.join(beside, F.col("found_.mark") == F.col("mark_"), "left")
    scored = near.select("row", "held_out", vote(F.col("found_.own") + F.coalesce("beside_", F.lit(0.0)), F.col("found_.places"), F.col("found_.dots")).alias("scored"))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in kept], "held_out", F.col("scored.score").alias("score"), (F.col("scored.score") >= 0.5).cast("int").alias("predicted"), F.col("scored.evidence").alias("evidence"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, index, keep=["doc_id"]).select("doc_id", *ADDED)

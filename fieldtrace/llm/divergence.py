"""Source divergence audit: which terms a source uses more than its language does, and how far the sources of a language lie apart."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import small_batches, stored, task_groups, tidy

#: What each byte of a text counts as: letters and bytes beyond ASCII make up terms, A-Z lower-cased; all else parts them.
FOLDED = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))
#: Bytes of a text that are split at a time; entries (of a group and a term) and bytes of terms that a task holds before it sends them.
PIECE, ENTRIES, HELD = 4 << 20, 600_000, 24 << 20
#: Shares are whole numbers of 1 / UNIT; every term counts SMOOTH times more than it occurs.
UNIT, SMOOTH = 1_000_000_000, 5
#: Sources whose vectors one task compares with so many others.
SOURCES = 256
COUNTED = "lang string, term binary, docs long, sources array<string>, counts array<long>"
COUNTED_ARROW = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some MB at a time."""
    folded, at = text.translate(FOLDED), 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            end = folded.rfind(b" ", at, end) + 1 or folded.find(b" ", end) + 1 or len(folded)
        yield folded[at:end].split()
        at = end


class Tally:
    """Occurrences and documents of each term by group (lang, source)."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        seen: set[bytes] = set()
        counts = self.counts[lang, source]
        for terms in terms_of(text):
            counts.update(terms)
            seen.update(terms)
        self.docs[lang, source].update(seen)

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > ENTRIES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each lang and term with its sources; and one without a term that names the groups."""
        for lang in {g[0] for g in self.counts}:
            own = [g[1] for g in self.counts if g[0] == lang]
            parts = []
            for source in own:
                n, d = self.counts[lang, source], self.docs[lang, source]
                parts.append(pa.table({"term": pa.array(list(n), pa.binary()), "docs": pa.array([d[t] for t in n], pa.int64()), "n": pa.array(n.values(), pa.int64()), "source": pa.array([source] * len(n), pa.string())}))
            merged = pa.concat_tables(parts).group_by("term").aggregate([("docs", "sum"), ("source", "list"), ("n", "list")])
            yield from pa.table([pa.array([lang] * len(merged), pa.string()), merged["term"], merged["docs_sum"], merged["source_list"], merged["n_list"]], schema=COUNTED_ARROW).to_batches(max_chunksize=20_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.binary()), pa.array([0]), pa.array([own]), pa.array([[0] * len(own)])], schema=COUNTED_ARROW)


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, size = Tally(), 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            tally.add(lang, source, text)
            size += len(text)
            if size > HELD:
                size = 0
                if tally.full():
                    yield from tally.rows()
                    tally = Tally()
    yield from tally.rows()
    del tally
    tidy()


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n) of the terms that at least `least` documents of the lang hold, and a row with a null term for each group.

    Tasks count before they send, so a frequent term or a large source comes as a row a task; one shuffle by (lang, term) serves the documents' count and the
    sources' counts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(tallied, COUNTED).repartition("lang", "term")
    known = counted.withColumn("in_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("term").isNull() | (F.col("in_docs") >= least))
    pairs = known.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("one")).groupBy("lang", "term", F.col("one.sources").alias("source")).agg(F.sum("one.counts").alias("n"))
    return pairs.select("lang", "source", F.col("term").cast("string").alias("term"), "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact however large the counts; 0 without terms."""
    whole = "decimal(20,0)"
    units = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast(whole)
    return F.when(terms > 0, 1 + F.call_function("div", units, total.cast(whole) + (SMOOTH * terms).cast(whole))).otherwise(F.lit(0)).cast("long")


def top_terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Part `term`: cells of terms with equal counts in the group and in the lang share one value; the cells of the best values that hold `top` terms
    are expanded, and no others. A group's values meet in one window only after each task has kept its best `top` of them."""
    lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("m"))
    cells = counts.join(lang, ["lang", "term"]).groupBy("lang", "source", "n", "m").agg(F.count(F.lit(1)).alias("terms"))
    cells = cells.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("m"), F.col("lang_total"), F.col("v"))
    cells = cells.select("lang", "source", "n", "m", "terms", (p - q).alias("value")).where("value > 0")
    group = Window.partitionBy("lang", "source")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("place") <= top)
    before = F.coalesce(F.sum("terms").over(group.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    best = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "m", "value")
    found = counts.join(lang, ["lang", "term"]).join(best, ["lang", "source", "n", "m"])
    ranked = found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def apart(shares: pa.Table, sources: pa.Table) -> pa.Table:
    """For the sources of one block pair and the terms of one bucket: what the terms add to the distance that two sources without any of them have."""
    places, none = sources["place"].to_numpy(), sources["none"].to_numpy()
    order = np.argsort(places)
    places, none, left = places[order], none[order], sources["left"].to_numpy()[order]
    out = []
    if sources["bucket"][0].as_py() < 0:  # the distance of two sources in a term that neither has, times all terms
        terms = sources["v"][0].as_py()
        for i in range(len(places) - 1):
            out.append((i, np.arange(i + 1, len(places)), terms * np.abs(none[i + 1 :] - none[i])))
    elif len(shares):
        term = np.unique(shares["key"].to_numpy(), return_inverse=True)[1]
        matrix = np.tile(none, (int(term.max()) + 1, 1))
        matrix[term, np.searchsorted(places, shares["place"].to_numpy())] = shares["p"].to_numpy()
        for i in range(len(places) - 1):
            sums = np.abs(matrix[:, i + 1 :] - matrix[:, i : i + 1]).sum(axis=0) - len(matrix) * np.abs(none[i + 1 :] - none[i])
            out.append((i, np.arange(i + 1, len(places)), sums))
    # Two sources of one block meet in that block's own pair alone.
    own = sources["lo"][0].as_py() == sources["hi"][0].as_py() if len(sources) else True
    rows = [(i, j, v) for i, js, vs in out for j, v in zip(js, vs, strict=True) if v and (own or left[i] != left[j])]
    a, b, v = zip(*rows, strict=True) if rows else ((), (), ())
    lang = sources["lang"][0].as_py() if len(sources) else None
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(places[list(a)], pa.int64()), "b": pa.array(places[list(b)], pa.int64()), "value": pa.array(v, pa.int64())})


def distances(counts: DataFrame, placed: DataFrame, beside: DataFrame) -> DataFrame:
    """Part `pair`: for each two sources of a lang the sum of abs(p - q) over all kept terms.

    Terms are dealt to buckets by a hash, sources to blocks of SOURCES by their order; a task fills a matrix of the shares of one bucket and two blocks, so no task gets
    a whole lang and none a whole source. What all buckets add to the distance of two sources that have no term at all is summed up. Gives (lang, a, b, value), a < b being places of
    sources. placed and beside are one table, read twice.
    """
    buckets = task_groups(counts.sparkSession)

    def met(df: DataFrame) -> DataFrame:
        """Each row once for every block that its own meets."""
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
        return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("left", F.col("block") == F.col("lo"))

    shares = counts.join(placed, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), F.xxhash64("term").alias("key"), "place", "block", "blocks", share(F.col("n"), F.col("total"), F.col("v")).alias("p")
    )
    sides = met(beside).withColumn("bucket", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(buckets - 1).cast("long"))))
    keys = ["lang", "bucket", "lo", "hi"]
    found = met(shares).select(*keys, "key", "place", "p").groupBy(*keys).cogroup(sides.select(*keys, "left", "place", "none", "v").groupBy(*keys))
    return found.applyInArrow(apart, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs (text, lang, source, ...), nulls read as ''.

    A term is a run of letters of ASCII, lower-cased, and characters beyond ASCII. A lang keeps the terms that `least` of its documents hold; a group (lang, source), or the lang, gives each
    the share 1 + floor(10^9 * (count + 5) / (N + 5 * terms)). Part `pair` has every other source of the lang and the sum of the shares' differences, all ranks; part
    `term` has the `top` kept terms that the group holds and whose share is above the lang's. Ranks go by value, the largest first, ties by item in UTF-8 order.

    All arithmetic is in whole numbers. Groups without kept terms have pairs alone; a lang without kept terms has pairs of value 0. Texts may be of any length; each row counts as a document, so repeated rows count
    again. Other columns play no part. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kept = stored(kept_counts(docs, least), "divergence")
    counts = kept.where("term IS NOT NULL")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("m")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("lang_total"))
    groups = totals.join(langs, "lang", "left").select("lang", "source", "total", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    lang = Window.partitionBy("lang")  # a row a source
    placed = groups.withColumn("place", F.row_number().over(lang.orderBy("source")).cast("long") - 1).withColumn("last", F.count(F.lit(1)).over(lang) - 1)
    placed = placed.withColumn("blocks", (F.col("last") / SOURCES).cast("long")).withColumn("block", (F.col("place") / SOURCES).cast("long")).withColumn("none", share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups, beside = stored(placed, "divergence-groups", 2)
    return pair_rows(counts, groups, beside).unionByName(top_terms(counts, groups, top))


def pair_rows(counts: DataFrame, placed: DataFrame, beside: DataFrame) -> DataFrame:
    found = distances(counts, placed, beside)
    # Pairs at distance 0 come from no task: every pair of places is a row of the result.
    numbers = placed.select("lang", F.col("place").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("b")).where("a != b")
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda c, n: placed.select("lang", F.col("place").alias(c), F.col("source").alias(n))
    rows = numbers.join(both, ["lang", "a", "b"], "left").join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    rows = rows.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS m FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(m) AS total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(n, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (g.total::HUGEINT + 5 * l.v))::BIGINT AS p,
    (1 + (1000000000 * (k.m::HUGEINT + 5)) // (l.total::HUGEINT + 5 * l.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z ON z.lang = a.lang AND s = a.source AND o = b.source
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, p - q, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INT AS rank
FROM p WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= 50
"""

"""From raw documents to tokens: toxic texts go, one of each group of near copies stays, repeated passages go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and all but the last return the columns of documents, others that docs has
among them, whatever their names. Null and empty texts go through all stages; an empty table stays empty. The stages for near copies, substrings and tokens cannot be written in
SQL, so the tests compare every stage with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import bpe, jaccard, mixing, substrings, toxicity
from fieldtrace.llm.common import shared_folder

ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not predicted toxic; the classifier is fitted on the labels of these documents. Equal texts, and so repeated rows, stay or go together; without
    labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "text")
    return toxicity.score(rows, toxicity.fit(docs, labels), keep=["row_"]).where("predicted = 0").select("row_.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by a Jaccard similarity of 0.8 or more over five words: that with the smallest doc_id, null before
    all. Repeated rows are one document; rows with one doc_id and different texts are several, and so are those without words and without doc_id."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start twice; n_chars follows the text. A cut character becomes U+FFFD. Repeated rows are copies that
    lose each other's bytes; a null text becomes an empty one."""
    kept = substrings.dedup(docs.select("doc_id", "text", *[F.col(c).alias(f"own_{c}") for c in docs.columns if c != "text"]))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    computed = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[computed[c].alias(c) if c in computed else F.col(f"own_{c}").alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times; one of a null source belongs to a source of its own. Documents without words are taken or not like
    others; ties in size go by doc_id, and repeated rows count one by one."""
    rows = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "text", "source")
    return mixing.repeated(mixing.mix(rows, keep=["row_"]), ["row_.*"])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text, row by row; none for a null or empty one."""
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", clean), ("jaccard", one_of_each), ("substrings", without_repeats), ("mixing", mixed), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

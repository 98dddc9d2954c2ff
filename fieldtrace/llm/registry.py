"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtrace.llm import bpe, crosstoken, divergence, hnsw, jaccard, lines, mixing, neardup, passages, sharding, substrings, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_hnsw": hnsw.op3_hnsw,
        "op4_sharding": sharding.op4_sharding,
        "op5_neardup": neardup.op5_neardup,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_bpe": bpe.op7_bpe,
        "op8_substrings": substrings.op8_substrings,
        "op9_warc": warc.op9_warc,
        "op10_passages": passages.op10_passages,
        "op11_crosstoken": crosstoken.op11_crosstoken,
        "op12_divergence": divergence.op12_divergence,
        "op13_lines": lines.op13_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op9_warc": warc.OP9_SQL, "op12_divergence": divergence.OP12_SQL, "op13_lines": lines.OP13_SQL}

"""The queries of this subpackage and the SQL that checks them; __spark_entry__ adds both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratapack.llm import bpe_stream, exact_dedup, imatch, license_scan, line_dedup, near_dedup, ngram_lm, retrieval_pack, role_repair, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_retrieval_pack": retrieval_pack.op1_retrieval_pack,
    "op2_imatch": imatch.op2_imatch,
    "op3_ngram_lm": ngram_lm.op3_ngram_lm,
    "op4_minmax_near_dedup": near_dedup.op4_minmax_near_dedup,
    "op5_role_repair": role_repair.op5_role_repair,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_bpe_stream": bpe_stream.op9_bpe_stream,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}

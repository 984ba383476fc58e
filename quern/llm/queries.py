"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import fingerprint, jaccard_join, langid, line_dedup, mixing, packing, quality, secret_scan, substring_dedup, vptree

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_packing": packing.op1_packing,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op2_neighbours": vptree.op2_neighbours,
        "op3_language": langid.op3_language,
        "op4_secrets": secret_scan.op4_secrets,
        "op5_mixing": mixing.op5_mixing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_quality": quality.op7_quality,
        "op8_fingerprints": fingerprint.op8_fingerprints,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.OP6_SQL}

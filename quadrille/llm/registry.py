"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, embed_dedup, licenses, mixing, quality, simhash, suffix_dedup, token_files, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        embed_dedup.op1_embedding_near_dedup,
        bpe.op2_byte_bpe,
        suffix_dedup.op3_suffix_dedup,
        token_files.op4_token_files,
        mixing.op5_mixing,
        licenses.op6_license_scan,
        simhash.op7_simhash_near_dedup,
        ann.op8_approximate_nearest_neighbours,
        urls.op9_url_filter,
        quality.op10_quality,
    )
}
SQL: dict[str, str] = {"op6_license_scan": licenses.SQL, "op9_url_filter": urls.SQL}

"""Registering of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Queries whose work on each text is worth spreading over all cores first.
HEAVY = frozenset(
    "doc_tokens word_counts doc_entropy doc_shares dict_hit doc_compress scan_clean "
    "term_hits vocab_min3 nb_log_ratio nb_features date_scores century_guess word_windows token_windows span_shards "
    "span_shards_check lookahead_chunks lookahead_report ngram_distinct rouge_pool located_lines located_altered text_splits".split()
)


def query(*tables: str, sql: str | None = None, name: str | None = None):
    """Register f(spark, *tables as DataFrames) under its name, with its SQL if there is one."""

    def wrap(f):
        key = name or f.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            read = [table(spark, folder, t) for t in tables]
            return f(spark, *[spread(d) if key in HEAVY and t in ("documents", "docvalue") else d for t, d in zip(tables, read, strict=True)])

        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return f

    return wrap

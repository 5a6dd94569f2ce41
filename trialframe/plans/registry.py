"""All registered queries but those of the llm folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.plans import scoring_queries, sequence_queries, state_queries, text_queries, tree_queries, trials, workflow_queries

MODULES = (trials, sequence_queries, text_queries, tree_queries, workflow_queries, state_queries, scoring_queries)


def _wide(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Integer results as 64-bit ones, the width that the SQL gives."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.col(f"`{n}`").cast("bigint").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes))

    query.__name__ = f.__name__
    query.__doc__ = f.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _wide(f) for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.SQL.items()}

"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftcorpus.plans import accounts, corpus, dedup, jobs, overlap, streams, texts, tokens, training, web

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [corpus, dedup, texts, tokens, jobs, overlap, web, accounts, training, streams]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.REGISTER.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.REGISTER.sql.items()}

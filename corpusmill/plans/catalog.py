"""Every registered query of the retrieval engine, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import q_agent, q_chunking, q_evaluation, q_retrieval, q_rules, q_sources, q_text
from corpusmill.plans.registry import ORACLES, REGISTERED

MODULES = (q_text, q_retrieval, q_chunking, q_evaluation, q_rules, q_agent, q_sources)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = REGISTERED
ORACLE_SQL: dict[str, str] = ORACLES

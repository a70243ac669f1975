"""All queries of the engine itself, by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cmdlake.plans import assembly_queries, baseline_queries, behaviour_queries, command_queries, curation_queries, dataset_queries, evaluation_queries, learning_queries, resolution_queries, split_queries, triage_queries

MODULES = (command_queries, dataset_queries, evaluation_queries, triage_queries, curation_queries, behaviour_queries, assembly_queries, split_queries, baseline_queries, resolution_queries, learning_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

"""Names of the queries over the star-schema tables, each with its DataFrame form and its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solvarium.plans import answers, architectures, choices, formats, large, measures, orders, parts, streams, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return orders.QUERIES | answers.QUERIES | parts.QUERIES | texts.QUERIES | measures.QUERIES | formats.QUERIES | architectures.QUERIES | choices.QUERIES | large.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return orders.SQL | answers.SQL | parts.SQL | texts.SQL | measures.SQL | formats.SQL | architectures.SQL | choices.SQL | large.SQL | streams.SQL

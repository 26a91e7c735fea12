"""Registry of named queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def per_row(name: str, of: str, key: str, said: dict[str, str]) -> Callable[[Callable[[], dict]], Callable[[], dict]]:
    """Registers a query of one row for each row of a relation: its key and the columns that the decorated function gives, and the SQL of each.

    of: "det" for detections, or a table's name.
    """
    from brightline.sources.tables import DETECTIONS_SQL, detections, table

    columns = ", ".join(f"{sql} AS {c}" for c, sql in said.items())
    sql = f"WITH {DETECTIONS_SQL} SELECT {key}, {columns} FROM det" if of == "det" else f"SELECT {key}, {columns} FROM {of}"

    def add(f: Callable[[], dict]) -> Callable[[], dict]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = detections(spark, sf_dir) if of == "det" else table(spark, sf_dir, of)
            return rows.select(key, *[c.alias(n) for n, c in f().items()])

        query(name, sql)(run)
        return f

    return add

"""Where plans register: a query and, where SQL can express it, the same in SQL for a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows a task gets where they are dealt out by number.
TASK_ROWS = 1 << 16


def parts(rows: DataFrame, a_task: int = TASK_ROWS) -> int:
    """Tasks for the rows of a table: two for each core at least, then one for each a_task rows."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // a_task))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out to as many tasks as their number asks for, where few bytes bring much work."""
    return rows.repartition(parts(rows), *keys)


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register

"""Code lists and forbidden paths, both as broadcast joins against tables as long as the rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in_list(rows: DataFrame, value: str, codes: list[str]) -> DataFrame:
    """Rows whose value is no code; a null, or a value with a space in it, is none. The list is part of the rule set."""
    table = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in codes], "_code string"))
    return rows.join(table, F.col(value) == F.col("_code"), "left_anti")


def forbidden(rows: DataFrame, path: str, keys: list[str], paths: dict[str, str]) -> DataFrame:
    """keys and rule_id: one finding for each forbidden path that a context holds. ``paths`` maps rule to path."""
    table = rows.sparkSession.createDataFrame(sorted(paths.items()), "rule_id string, _path string")
    return rows.join(F.broadcast(table), F.col(path) == F.col("_path")).select(*keys, "rule_id").distinct()


def cardinality(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Groups with more than ``most`` rows: keys, n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)

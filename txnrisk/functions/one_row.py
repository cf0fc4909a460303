"""Values of a one-row result beside other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of ``row`` as a scalar subquery: no join, and more than one row is an error."""
    values = row.select(F.struct(*row.columns)).scalar()
    beside = df.select("*", values.alias("_row"))
    return beside.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])

"""Columns that are computed once, whatever refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row each.

    The optimizer merges successive projections and then repeats an expression
    wherever its column is used; a generator keeps large ones, such as a fold
    over a plan, in one place. Nulls stay nulls, no row is lost.
    """
    row = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, row.alias("_settled")).select(*keep, *(F.col(f"_settled.{k}").alias(k) for k in columns))

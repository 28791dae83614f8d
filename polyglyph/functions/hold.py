"""Computing a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row.

    The optimizer puts a column's expression in place of its name wherever it is used, and expressions with lambda
    functions are then computed again at each place. A one-row Generate keeps the projections on its two sides apart.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")
    return df.select("*", made).select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it: for columns inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

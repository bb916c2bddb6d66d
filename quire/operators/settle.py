"""Keep costly columns from being computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows, but with every column computed here.

    Catalyst pushes a filter on a derived column down to the scan by writing the column's whole expression into the
    filter, and then computes it again for the output. For parsed markup that doubles the work, or worse where the
    expression is used several times. The same happens when an array column is exploded: Spark adds a size test and
    pushes it down. A generator yielding the row itself is a step filters are not pushed through.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))

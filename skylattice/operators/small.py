"""Tables that are small by their nature, checked to be so before every executor gets them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of suns, directions, offsets or runs that are sent to every executor.
MOST_ROWS = 200_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` for a broadcast, failing where it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of more than {most} rows is not sent to every executor")
    return F.broadcast(df)

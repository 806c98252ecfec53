"""As-of operators: sample hold between two sensors, last-known location."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import HOT_ROWS, carried


def sample_hold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    emits: Column,
    held: dict[str, Column],
    initial: float = 0.0,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Rows of the emitting sensor, each with the latest value of the held sensor (``initial`` before any).

    ``df`` is the union of both sensors; ``held`` maps an output name to a value that is NULL on the emitting rows.
    """
    out = carried(df.withColumn("_emits", emits), keys, order, along, held, limit)
    return out.where("_emits").drop("_emits").withColumns({n: F.coalesce(n, F.lit(initial)) for n in held})


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], along: Column, location: str = "location",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """The most recent non-empty location of the key on every row."""
    return carried(df, keys, order, along, {"last_location": F.col(location)}, limit)

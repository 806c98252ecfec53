"""Ordered per-key operators (numbering, carried values) that keep working when one key holds most rows.

A plain ``row_number() OVER (PARTITION BY key)`` puts a whole key into one task. Here the few keys above
``limit`` rows are found first (one column-pruned, map-side combined count); only those keys are cut into chunks
along their order, each chunk is processed on its own, and a small per-chunk summary supplies what the earlier
chunks contribute. Keys below the limit keep the plain plan with a single exchange.

``keys`` must not hold NULLs. ``along`` is a LONG expression that never decreases along ``order``; rows where it is NULL
come first, as in any ascending order.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
# Up to so many split keys their table is broadcast; a longer one is joined as Spark sees fit.
BROADCAST_KEYS = 10_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def hot_keys(df: DataFrame, keys: Sequence[str], along: Column, limit: int = HOT_ROWS) -> DataFrame | None:
    """``keys, _lo, _width`` for every key above ``limit`` rows (so at most one row in ``limit`` input rows), or None."""
    stats = (
        df.select(*keys, along.alias("_along"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_along").alias("_lo"), F.max("_along").alias("_hi"))
        .where(F.col("_n") > limit)
    )
    # A key whose order is NULL throughout is one chunk.
    found = stats.fillna(0, ["_lo", "_hi"]).collect()
    if not found:
        return None
    schema = df.select(*keys).schema.add("_lo", "long").add("_width", "long")

    def table(pieces: dict) -> DataFrame:
        rows = [
            (*(r[k] for k in keys), r["_lo"], max(1, math.ceil((r["_hi"] - r["_lo"] + 1) / pieces[i])))
            for i, r in enumerate(found)
        ]
        made = df.sparkSession.createDataFrame(rows, schema)
        return F.broadcast(made) if len(rows) <= BROADCAST_KEYS else made

    pieces = {i: math.ceil(r["_n"] / limit) for i, r in enumerate(found)}
    index = {tuple(r[k] for k in keys): i for i, r in enumerate(found)}
    # Rows are rarely spread evenly along the order: narrow the chunks until the densest one fits. Every pass at least
    # triples the pieces of a key that is still too dense, up to one per value.
    while True:
        densest = (
            chunked(df.select(*keys, along.alias("_along")), keys, F.col("_along"), table(pieces))
            .where(F.col("_chunk") > 0)
            .groupBy(*keys, "_chunk").count()
            .groupBy(*keys).agg(F.max("count").alias("_max"))
            .where(F.col("_max") > 2 * limit)
            .collect()
        )
        grown = False
        for r in densest:
            i = index[tuple(r[k] for k in keys)]
            span = found[i]["_hi"] - found[i]["_lo"] + 1
            finer = min(pieces[i] * math.ceil(r["_max"] / limit), span)
            grown |= finer > pieces[i]
            pieces[i] = finer
        if not grown:
            break
    return table(pieces)


def chunked(df: DataFrame, keys: Sequence[str], along: Column, hot: DataFrame | None) -> DataFrame:
    """Add ``_chunk``: -1 for ordinary keys; for split keys 0 where the order is NULL and 1.. along the order."""
    if hot is None:
        return df.withColumn("_chunk", F.lit(-1).cast("long"))
    return (
        df.join(hot, list(keys), "left")
        .withColumn(
            "_chunk",
            F.when(F.col("_width").isNull(), -1)
            .otherwise(F.coalesce(F.floor((along - F.col("_lo")) / F.col("_width")) + 1, F.lit(0))).cast("long"),
        )
        .drop("_lo", "_width")
    )


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
    find_hot: bool = True,
) -> DataFrame:
    """Add ``rn`` (1-based arrival counter per key), ``n_rows`` (rows of the key) and ``_chunk``."""
    if hot is None and find_hot:
        hot = hot_keys(df, keys, along, limit)
    keys = list(keys)
    if hot is None:
        per_key = Window.partitionBy(*keys)
        return (
            df.withColumn("rn", F.row_number().over(per_key.orderBy(*order)).cast("long"))
            .withColumn("n_rows", F.count(F.lit(1)).over(per_key))
            .withColumn("_chunk", F.lit(-1).cast("long"))
        )
    parts = chunked(df, keys, along, hot)
    local = Window.partitionBy(*keys, "_chunk")
    sizes = (
        parts.where(F.col("_chunk") >= 0)
        .groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
        .drop("_size")
    )
    return (
        parts.withColumn("rn", F.row_number().over(local.orderBy(*order)).cast("long"))
        .withColumn("n_rows", F.count(F.lit(1)).over(local))
        .join(sizes, [*keys, "_chunk"], "left")
        .withColumn("rn", F.col("rn") + F.coalesce("_offset", F.lit(0)))
        .withColumn("n_rows", F.coalesce("_total", "n_rows"))
        .drop("_offset", "_total")
    )


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    held: dict[str, Column],
    limit: int = HOT_ROWS,
    forward: bool = True,
    hot: DataFrame | None = None,
    find_hot: bool = True,
) -> DataFrame:
    """Add, per entry of ``held``, the latest non-NULL value up to and including the row (or the next, backward)."""
    if hot is None and find_hot:
        hot = hot_keys(df, keys, along, limit)
    keys = list(keys)
    source = df.select("*", *[c.alias(f"_v_{n}") for n, c in held.items()])
    parts = chunked(source, keys, along, hot)
    span = Window.partitionBy(*keys, "_chunk") if hot is not None else Window.partitionBy(*keys)
    # Backward runs over the reversed order: a growing frame costs one step per row, a shrinking one a whole pass.
    span = span.orderBy(*order) if forward else span.orderBy(*[F.desc(o) for o in order])
    span = span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside = Window.partitionBy(*keys).orderBy("_chunk" if forward else F.desc("_chunk"))
    outside = outside.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by if forward else F.min_by
    out = parts.select("*", *[F.last(f"_v_{n}", True).over(span).alias(n) for n in held])
    if hot is not None:
        place = F.struct(*order)
        summary = (
            parts.where(F.col("_chunk") >= 0)
            .groupBy(*keys, "_chunk")
            .agg(*[edge(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in held])
            .select(*keys, "_chunk", *[F.last(f"_e_{n}", True).over(outside).alias(f"_o_{n}") for n in held])
        )
        out = out.join(summary, [*keys, "_chunk"], "left").withColumns(
            {n: F.coalesce(n, f"_o_{n}") for n in held}
        )
    return out.select(*df.columns, *held)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    previous: dict[str, Column],
    limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
    find_hot: bool = True,
) -> DataFrame:
    """Add, per entry of ``previous``, the value the preceding row of the key has (NULL on its first row)."""
    if hot is None and find_hot:
        hot = hot_keys(df, keys, along, limit)
    keys = list(keys)
    source = df.select("*", *[c.alias(f"_v_{n}") for n, c in previous.items()])
    parts = chunked(source, keys, along, hot)
    span = (Window.partitionBy(*keys, "_chunk") if hot is not None else Window.partitionBy(*keys)).orderBy(*order)
    out = parts.select("*", *[F.lag(f"_v_{n}").over(span).alias(n) for n in previous])
    if hot is not None:
        out = out.withColumn("_first", F.row_number().over(span) == 1)
        last = (
            parts.where(F.col("_chunk") >= 0)
            .groupBy(*keys, "_chunk")
            .agg(F.max_by(F.struct(*[f"_v_{n}" for n in previous]), F.struct(*order)).alias("_last"))
            .select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_last"))
        )
        out = out.join(last, [*keys, "_chunk"], "left").withColumns(
            {n: F.when(F.col("_first"), F.col("_last").getField(f"_v_{n}")).otherwise(F.col(n)) for n in previous}
        )
    return out.select(*df.columns, *previous)

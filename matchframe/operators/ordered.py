"""Ordered work within a key that stays exact when one key holds a large share of all rows.

Below a size limit the plain window is used. Beyond it the fullest key is counted, and where it would not
fit a task the rows are range-partitioned over (key, order) into chunks of bounded size. A chunk then needs
only what comes before it in its key: the last few rows (``prior_rows``) or one combined value (``running``).
``order`` must end in a unique column, so that every key can be cut anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from matchframe.session import ROWS_PER_TASK, WINDOW_BYTES, durable, hottest_key, input_bytes, setting

CHUNK = "_chunk"


def range_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame | None:
    """``df`` with a chunk number that rises along (keys, order), or None where whole keys fit a task."""
    spark = df.sparkSession
    if input_bytes(df) <= setting(spark, WINDOW_BYTES):
        return None
    per_task = setting(spark, ROWS_PER_TASK)
    rows, hottest = hottest_key(df, keys)
    if hottest <= per_task:
        return None
    ranged = df.repartitionByRange(rows // per_task + 1, *keys, *order)
    # Stored once: the range bounds come from a sample, so chunk numbers must not be computed twice.
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def prior_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, columns: Callable[[WindowSpec], dict[str, Column]]
) -> DataFrame:
    """Add columns that look back at most ``n`` rows within the key."""
    chunks = range_chunks(df, keys, order)
    if chunks is None:
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(*order)))

    part = [*keys, CHUNK]
    row = F.struct(*[F.col(c) for c in df.columns])
    newest = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        chunks.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("_row")))).alias("_tail"))
    )
    # n earlier chunks of a key hold at least n rows, so they are all a chunk can need.
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-n, -1)
    before = F.flatten(F.collect_list("_tail").over(earlier))
    halo = (
        tails.select(*part, before.alias("_before"))
        .select(CHUNK, F.explode(F.slice("_before", F.greatest(F.size("_before") - n, F.lit(0)) + 1, n)).alias("_b"))
        .select(*[F.col("_b._row")[c].alias(c) for c in df.columns], CHUNK, F.lit(True).alias("_halo"))
    )
    widened = chunks.withColumn("_halo", F.lit(False)).unionByName(halo)
    return (
        widened.withColumns(columns(Window.partitionBy(*part).orderBy(*order)))
        .filter(~F.col("_halo"))
        .drop("_halo", CHUNK)
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Add running values over the key's earlier rows (and this one, if ``inclusive``).

    Kinds: ``sum`` (0 where nothing came before), ``max`` and ``last`` (last non-null), both null then.
    """
    end = 0 if inclusive else -1

    def over(kind: str, value: Column, window: WindowSpec) -> Column:
        if kind == "sum":
            return F.coalesce(F.sum(value).over(window), F.lit(0))
        return (F.max(value) if kind == "max" else F.last(value, ignorenulls=True)).over(window)

    chunks = range_chunks(df, keys, order)
    if chunks is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({name: over(kind, value, frame) for name, (kind, value) in values.items()})

    part = [*keys, CHUNK]

    def partial(name: str, kind: str, value: Column) -> Column:
        if kind == "last":
            at = F.when(value.isNotNull(), F.struct(*order))
            return F.max_by(value, at).alias(f"_p_{name}")
        return (F.sum(value) if kind == "sum" else F.max(value)).alias(f"_p_{name}")

    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.groupBy(*part)
        .agg(*[partial(name, kind, value) for name, (kind, value) in values.items()])
        .select(
            *part, *[over(kind, F.col(f"_p_{name}"), earlier).alias(f"_c_{name}") for name, (kind, _) in values.items()]
        )
    )
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = chunks.withColumns({name: over(kind, value, frame) for name, (kind, value) in values.items()})

    def combine(name: str, kind: str) -> Column:
        here, carry = inside[name], carried[f"_c_{name}"]
        if kind == "sum":
            return here + carry
        return F.greatest(here, carry) if kind == "max" else F.coalesce(here, carry)

    return inside.join(carried, _same(inside, carried, part)).select(
        *[inside[c] for c in df.columns], *[combine(name, kind).alias(name) for name, (kind, _) in values.items()]
    )


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each group. Filtering the row number lets Spark keep k rows per group before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(rank or "_rank", F.row_number().over(window)).filter(F.col(rank or "_rank") <= k)
    return top if rank else top.drop("_rank")

"""Profiles of a match log: counts, shares, summary statistics, coverage."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions import scores
from matchframe.session import small_table, written


def label_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Rows per label, largest first; a missing label is not counted."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col)
    return counts.limit(n) if n else counts


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def goals_per_year(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(
        F.avg("home_score").alias("home_score"), F.avg("away_score").alias("away_score")
    )


def outcome_shares(df: DataFrame) -> DataFrame:
    """Share of home wins, draws and away wins."""
    result = scores.outcome(F.col("home_score"), F.col("away_score"))
    names = {"home": scores.HOME, "draw": scores.DRAW, "away": scores.AWAY}
    shares = df.agg(*[F.avg((result == label).cast("double")).alias(name) for name, label in names.items()])
    return shares.unpivot([], list(names), "result", "share")


def both_present(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both values present, of all rows."""
    return df.agg(
        F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("present"), F.count(F.lit(1)).alias("rows")
    )


def grouped_coverage(df: DataFrame, by: list, cols: list[str], distinct: list[str] = ()) -> DataFrame:
    """Rows, non-null counts and distinct counts per group (year, league, season)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count(c).alias(f"with_{c}") for c in cols],
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct],
    )


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of the rows where both are present."""
    return df.agg(F.corr(a, b).alias("corr"))


#: Bits by which a pass narrows the place of a wanted value.
_BITS = 16


def order_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column as 64-bit whole numbers in the order of its doubles; null stays null, NaN is above all others."""
    numbers = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for column in b.columns:
                missing = column.is_null().to_numpy(zero_copy_only=False)
                x = column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
                bits = np.where(np.isnan(x), np.nan, x).view(np.int64)  # one NaN
                out.append(pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), pa.int64(), mask=missing))
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return numbers.mapInArrow(run, ", ".join(f"c{i} long" for i in range(len(cols))))


def _value(key: int) -> float:
    bits = key if key >= 0 else key ^ (2**63 - 1)
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], counts: list[int] | None = None) -> list[list[float | None]]:
    """Exact quantiles (linear interpolation) of each column, by radix selection.

    The ranks wanted of all columns are narrowed together: a pass counts the values that share a rank's leading bits by
    their next ``_BITS`` bits, and keeps for each rank the bin that holds it. So four aggregates find every value, whatever
    the number of rows, and no values are gathered. Missing values are left out, NaN is the greatest value; a column
    without values has null quantiles. ``counts`` are the columns' numbers of values where they are known.
    """
    keys = written(order_keys(df, cols))
    names = keys.columns
    found = counts or list(keys.agg(*[F.count(c) for c in names]).first())
    # (column, rank) -> (leading bits found so far, values below them)
    place = {
        (c, r): (None, 0) for c, n in enumerate(found) if n for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
    }
    values = keys.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("key")) for i, n in enumerate(names)])).alias("v")).select("v.*")
    values = values.where(F.col("key").isNotNull())
    for shift in range(64 - _BITS, -1, -_BITS):
        if not place:
            break
        asked = sorted({(c, prefix if prefix is not None else 0, r - below) for (c, r), (prefix, below) in place.items()})
        # the high bits of all values are 0 in the first pass, where they are shifted out
        high = F.lit(0).cast("long") if shift == 64 - _BITS else F.shiftright("key", shift + _BITS)
        prefixes = small_table(df.sparkSession, sorted({(c, prefix) for c, prefix, _ in asked}), "c int, prefix long")
        counted = values.withColumn("prefix", high).join(prefixes, ["c", "prefix"]).groupBy("c", "prefix", F.shiftright("key", shift).alias("bin")).count()
        # at most 2^_BITS bins a prefix
        upto = F.sum("count").over(Window.partitionBy("c", "prefix").orderBy("bin"))
        ranks = small_table(df.sparkSession, asked, "c int, prefix long, rank long")
        held = counted.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("count")).join(ranks, ["c", "prefix"])
        held = held.where((F.col("under") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        bins = {(r["c"], r["prefix"], r["rank"]): (r["bin"], r["under"]) for r in held.collect()}
        for (c, r), (prefix, below) in place.items():
            bin_, under = bins[c, prefix if prefix is not None else 0, r - below]
            place[c, r] = (bin_, below + under)
    out = []
    for c, n in enumerate(found):
        row: list[float | None] = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            position = p * (n - 1)
            low, high_ = (_value(place[c, r][0]) for r in (math.floor(position), math.ceil(position)))
            row.append(low if low == high_ or position == math.floor(position) else low + (high_ - low) * (position - math.floor(position)))
        out.append(row)
    return out


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of each column, exact. NaN counts as the greatest value."""
    numbers = df.select([F.col(c).cast("double").alias(c) for c in cols])
    summary = numbers.agg(*[f(c) for c in cols for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]).first()
    quartiles = exact_quantiles(numbers, cols, [0.25, 0.5, 0.75], [summary[5 * i] for i in range(len(cols))])
    rows = []
    for i, c in enumerate(cols):
        n, mean, sd, low, high = summary[5 * i : 5 * i + 5]
        rows.append((c, n, mean, sd, low, *quartiles[i], high))
    return small_table(
        df.sparkSession, rows, "name string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )

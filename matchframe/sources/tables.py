"""Reading, appending, resuming and writing flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from matchframe.functions.constants import LEAGUES
from matchframe.operators.ordered import top_per_group


def read_table(
    spark: SparkSession, path: str, schema: str | StructType | None = None, columns: list[str] | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """CSV (typed by ``schema``, never inferred) or parquet; NaN becomes null, only ``columns`` are scanned."""
    fmt = fmt or ("csv" if ".csv" in path else "parquet")
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    return nan_to_null(df.select(*columns) if columns else df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is always null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def union_latest(base: DataFrame, extra: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """``extra`` appended to ``base``; per key the base row wins, then the first by ``tie``."""
    tagged = base.withColumn("_source", F.lit(0)).unionByName(extra.withColumn("_source", F.lit(1)))
    return top_per_group(tagged, keys, [F.col("_source"), *[F.col(c) for c in tie]]).drop("_source")


def incremental_after(df: DataFrame, target: DataFrame, ts: str) -> DataFrame:
    """Rows strictly newer than the newest one already held; all rows where nothing is held."""
    newest = target.select(F.max(ts)).scalar()
    return df.filter(newest.isNull() | (F.col(ts) > newest))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def resume_progress(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total, already done, still to do."""
    held = done.select(*keys).distinct().withColumn("_held", F.lit(1))
    flagged = work.join(held, keys, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_held").alias("already_done"),
        F.count_if(F.col("_held").isNull()).alias("to_do"),
    )


def coverage(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of non-null values of each column, fullest first."""
    columns = columns or df.columns
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "name", "share").orderBy(F.desc("share"), "name")


def scope(
    leagues: DataFrame, fixtures: DataFrame, league_ids: list[int] | None = None,
    league: str = "league_id", season: str = "season", seasons: str = "seasons", fixture: str = "fixture_id",
) -> DataFrame:
    """(league, season, fixture) of every fixture in the listed leagues' own seasons.

    ``leagues`` holds one row per league with an array of its seasons.
    """
    wanted = leagues.filter(F.col(league).isin(league_ids if league_ids is not None else list(LEAGUES)))
    in_scope = wanted.select(league, F.explode(seasons).alias(season)).distinct()
    return fixtures.join(in_scope, [league, season]).select(league, season, fixture)


"""Pairwise matchup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchframe.operators.outcome import TRIPLE
from matchframe.session import small_table, written


#: Entrants that are paired with each other at a time.
BLOCK = 1024


def numbered(df: DataFrame, by: str, name: str = "i") -> DataFrame:
    """``df`` with numbers from 1 in ascending order of ``by``, which is unique and not null.

    Rows are range-partitioned and stored; a row's number is its place in its part and the rows of earlier parts. The
    driver holds a number for each part.
    """
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    offsets = small_table(spark, before, "_part int, _before long")
    return ranged.withColumn("_place", place).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def unordered_pairs(teams: DataFrame, team: str = "team") -> DataFrame:
    """(team_a, team_b) of all unordered pairs of an event's entrants, in name order.

    Numbered entrants form blocks; each entrant names the blocks from its own on, and meets the entrants of a block that
    come after it. The table is as large as the event has pairings, which is what a matchup table is. A missing name is
    no entrant.
    """
    entrants = teams.select(F.col(team).alias("t")).where("t is not null").distinct()
    ranked = numbered(entrants, "t").withColumn("block", ((F.col("i") - 1) / BLOCK).cast("int"))
    last = ranked.select(F.max("block")).scalar()
    first = ranked.select(F.col("t").alias("team_a"), F.col("i").alias("a"), F.explode(F.sequence("block", last)).alias("block"))
    second = ranked.select(F.col("t").alias("team_b"), F.col("i").alias("b"), "block")
    return first.join(second, "block").where("a < b").select("team_a", "team_b")


def both_orientations(pairs: DataFrame, snapshot: DataFrame, cols: list[str], team: str = "team") -> DataFrame:
    """Each pair twice, once with either team at home, with home_/away_ snapshot columns; the venue is neutral."""
    def entry(home: str, away: str, swapped: bool):
        return F.struct(F.col(home).alias("home_team"), F.col(away).alias("away_team"), F.lit(swapped).alias("swapped"))

    turned = F.explode(F.array(entry("team_a", "team_b", False), entry("team_b", "team_a", True)))
    rows = pairs.select("team_a", "team_b", turned.alias("_o")).select("team_a", "team_b", "_o.*")
    for side in ("home", "away"):
        part = snapshot.select(F.col(team).alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        rows = rows.join(part, f"{side}_team")
    return rows.withColumn("neutral", F.lit(True))


def matchup_grid(scored: DataFrame) -> DataFrame:
    """Venue-free probabilities of each pair from both scored orientations, averaged and renormalised."""
    def side(straight: str, turned: str):
        return F.avg(F.when(F.col("swapped"), F.col(turned)).otherwise(F.col(straight)))

    away, draw, home = TRIPLE
    mean = scored.groupBy("team_a", "team_b").agg(
        side(home, away).alias("a"), F.avg(draw).alias("d"), side(away, home).alias("b")
    )
    total = F.col("a") + F.col("d") + F.col("b")
    return mean.select(
        "team_a", "team_b", (F.col("a") / total).alias("p_a_wins"), (F.col("d") / total).alias("p_draw"),
        (F.col("b") / total).alias("p_b_wins"),
    )

"""Tournament tables over result replicates, and the queries a viewer runs on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.operators.ordered import top_per_group
from matchframe.session import small_table, written


def _best_first(tie: str) -> list[Column]:
    return [F.col("pts").desc(), F.col("gd").desc(), F.col("gf").desc(), F.col(tie)]


def standings(results: DataFrame, keys: list[str], tie: Column | None = None) -> DataFrame:
    """Table of each group: 3/1/0 points, goal difference, goals for; position by pts, gd, gf, then a fixed hash.

    Results are added up per team on the map side; only the teams of a group meet in the ranking.
    """
    def row(team: str, gf: str, ga: str) -> Column:
        return F.struct(F.col(team).alias("team"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))

    both = F.array(row("home_team", "home_score", "away_score"), row("away_team", "away_score", "home_score"))
    long = results.select(*keys, F.explode(both).alias("_r")).select(*keys, "_r.*")
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    table = long.groupBy(*keys, "team").agg(
        F.sum(points).alias("pts"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf")
    )
    keyed = table.withColumn("_tie", F.xxhash64("team", *keys) if tie is None else tie)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_best_first("_tie")))
    return keyed.withColumn("position", place).drop("_tie")


def best_of_rank(
    table: DataFrame, per: list[str], position: int = 3, k: int = 8, tie: Column | None = None
) -> DataFrame:
    """Best ``k`` of the teams that finished at one position, across the groups of a replicate."""
    same = table.filter(F.col("position") == position).withColumn("_tie", F.xxhash64("team", *per) if tie is None else tie)
    return top_per_group(same, per, _best_first("_tie"), k, rank="best").drop("_tie")


def finish_distribution(table: DataFrame, replicate: str, team: str = "team") -> DataFrame:
    """Per (team, position): share of the team's replicates and its mean points, goal difference and goals there.

    ``p_advance`` is the share of first and second places, the same on every row of a team.
    """
    cells = table.groupBy(team, "position").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("pts").alias("mean_pts"), F.avg("gd").alias("mean_gd"), F.avg("gf").alias("mean_gf")
    )
    totals = cells.groupBy(team).agg(
        F.sum("_n").alias("_total"), F.coalesce(F.sum(F.when(F.col("position") <= 2, F.col("_n"))), F.lit(0)).alias("_up")
    )
    return cells.join(totals, team).select(
        team, "position", (F.col("_n") / F.col("_total")).alias("p"),
        (F.col("_up") / F.col("_total")).alias("p_advance"), "mean_pts", "mean_gd", "mean_gf",
    )


def replicates(results: DataFrame, replicate: str) -> Column:
    """Number of replicates of a result table, as a scalar."""
    return results.select(F.count_distinct(replicate)).scalar()


def stage_probabilities(paths: DataFrame, stages: list[str], n: Column | int, team: str = "team", stage: str = "stage"):
    """Share of the ``n`` replicates in which a team reached each stage; ``paths`` has a row per (replicate, team, stage)."""
    n = n if isinstance(n, Column) else F.lit(n)
    reached = paths.groupBy(team).agg(
        *[F.count_if(F.col(stage) == s).alias(s) for s in stages]
    )
    return reached.select(team, *[(F.col(s) / n).alias(f"p_{s}") for s in stages]).orderBy(F.desc(f"p_{stages[-1]}"), team)


def slot_occupancy(
    paths: DataFrame, slot: list[str], n: Column | int, team: str = "team", k: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Per slot: the ``k`` most frequent teams with their share of ``n`` replicates, and the modal team with its share."""
    n = n if isinstance(n, Column) else F.lit(n)
    shares = paths.groupBy(*slot, team).agg((F.count(F.lit(1)) / n).alias("p"))
    top = top_per_group(shares, slot, [F.col("p").desc(), F.col(team)], k, rank="place")
    modal = shares.groupBy(*slot).agg(F.min(F.struct((-F.col("p")).alias("q"), F.col(team))).alias("_m")).select(
        *slot, F.col(f"_m.{team}").alias("mode_team"), (-F.col("_m.q")).alias("p_mode")
    )
    return top, modal


def slot_table(spark, pairs: list[tuple], first: int = 1) -> DataFrame:
    """Slot list as rows (slot, side, grp, position, third); thirds are numbered in slot order."""
    rows, third = [], 0
    for i, sides in enumerate(pairs):
        for side, (grp, position) in zip("ab", sides):
            if position is None:
                third += 1
            rows.append((first + i, side, None if position is None else grp, position, third if position is None else None))
    return small_table(spark, rows, "slot int, side string, grp string, position int, third int")


def resolve_slots(table: DataFrame, slots: DataFrame, per: list[str], grp: str = "grp", tie: Column | None = None):
    """Fixtures of the first knockout round: group places and best thirds put into the slots of each replicate."""
    placed = table.join(slots.filter(F.col("third").isNull()), [grp, "position"]).select(*per, "slot", "side", "team")
    seats = slots.filter(F.col("third").isNotNull()).count()
    thirds = best_of_rank(table, per, 3, max(seats, 1), tie).select(*per, "team", F.col("best").alias("third"))
    assigned = thirds.join(slots.filter(F.col("third").isNotNull()).select("slot", "side", "third"), "third").select(
        *per, "slot", "side", "team"
    )
    return placed.unionByName(assigned).groupBy(*per, "slot").agg(
        F.max(F.when(F.col("side") == "a", F.col("team"))).alias("team_a"),
        F.max(F.when(F.col("side") == "b", F.col("team"))).alias("team_b"),
    )


def next_round(winners: DataFrame, wiring: DataFrame, per: list[str]) -> DataFrame:
    """Fixtures of a later round from the winners (``per``, slot, team); ``wiring`` rows: slot, from_a, from_b."""
    feeds = wiring.select(
        F.col("slot").alias("_to"),
        F.explode(
            F.array(
                F.struct(F.col("from_a").alias("slot"), F.lit("a").alias("side")),
                F.struct(F.col("from_b").alias("slot"), F.lit("b").alias("side")),
            )
        ).alias("_f"),
    ).select("_to", "_f.*")
    return winners.join(feeds, "slot").groupBy(*per, F.col("_to").alias("slot")).agg(
        F.max(F.when(F.col("side") == "a", F.col("team"))).alias("team_a"),
        F.max(F.when(F.col("side") == "b", F.col("team"))).alias("team_b"),
    )


def bracket_probabilities(fixtures: DataFrame, beats: DataFrame, wiring: list[tuple], per: list[str], first_stage: str) -> DataFrame:
    """(per, stage, slot, team, p_play, p_win): exact chances of each team in each match of a knockout bracket.

    ``fixtures`` (per, slot, team_a, team_b) is the first round, ``beats`` (team, other, p) the chance that a team beats
    another, ``wiring`` the later matches in order of play: (stage, slot, slot that feeds side a, slot that feeds side b).
    A team wins a match if it plays there and beats whoever comes from the other side, so a round is one join of the two
    sides of its matches and one sum over the opponents. Where the other side stays empty, the team goes through.
    """
    def side(name: str) -> Column:
        return F.struct(F.lit(name).alias("side"), F.col(f"team_{name}").alias("team"))

    sides = fixtures.select(*per, "slot", F.explode(F.array(side("a"), side("b"))).alias("s")).select(*per, "slot", "s.*", F.lit(1.0).alias("p_play"))
    sides = sides.where(F.col("team").isNotNull())
    stages, out = list(dict.fromkeys([first_stage, *[w[0] for w in wiring]])), []
    for k, stage in enumerate(stages):
        other = sides.select(*per, "slot", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), F.col("team").alias("other"), F.col("p_play").alias("q"))
        met = sides.join(other, [*per, "slot", "side"], "left").join(beats, ["team", "other"], "left")
        chance = F.coalesce(F.sum(F.col("q") * F.col("p")), F.lit(0.0)) + 1 - F.coalesce(F.sum("q"), F.lit(0.0))
        played = written(met.groupBy(*per, "slot", "side", "team", "p_play").agg((F.col("p_play") * chance).alias("p_win")))
        out.append(played.select(*per, F.lit(stage).alias("stage"), "slot", "team", "p_play", "p_win"))
        if k + 1 == len(stages):
            break
        feeds = [(source, name, slot) for later, slot, a, b in wiring if later == stages[k + 1] for name, source in (("a", a), ("b", b))]
        feeds = small_table(fixtures.sparkSession, feeds, "slot int, into string, next int")
        sides = played.drop("side", "p_play").join(feeds, "slot").select(*per, F.col("next").alias("slot"), F.col("into").alias("side"), "team", F.col("p_win").alias("p_play"))
    return reduce(DataFrame.unionByName, out)


def top_contenders(summary: DataFrame, by: str = "p_winner", n: int = 16, team: str = "team", lowest: bool = False):
    order = F.asc(by) if lowest else F.desc(by)
    return summary.orderBy(order, team).limit(n)


def group_table(members: DataFrame, summary: DataFrame, grp: str, by: str, team: str = "team") -> DataFrame:
    """Summary rows of each group's members, best first; members without a summary drop out."""
    joined = members.select(grp, team).join(summary, team)
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(grp).orderBy(F.desc(by), F.col(team))))


def pair_lookup(asked: DataFrame, matchups: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Matchup of an unordered pair; wins are swapped where it is stored the other way round, a pair of one team has none."""
    stored = matchups.select(
        F.least("team_a", "team_b").alias("_lo"), F.greatest("team_a", "team_b").alias("_hi"),
        "team_a", "p_a_wins", "p_draw", "p_b_wins",
    )
    pairs = asked.filter(F.col(a) != F.col(b))
    joined = pairs.join(
        stored, (F.least(pairs[a], pairs[b]) == stored["_lo"]) & (F.greatest(pairs[a], pairs[b]) == stored["_hi"])
    )
    straight = F.col("team_a") == F.col(a)
    return joined.select(
        *[pairs[c] for c in pairs.columns],
        F.when(straight, F.col("p_a_wins")).otherwise(F.col("p_b_wins")).alias("p_first"),
        "p_draw",
        F.when(straight, F.col("p_b_wins")).otherwise(F.col("p_a_wins")).alias("p_second"),
    )


"""Coach careers, and attaching per-team features to a match log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.operators.ordered import running
from matchframe.operators.squads import attach_to_sides


def primary_per_group(
    appearances: DataFrame, group: list[str], person: str, match: str = "match_id", date: str = "match_date"
) -> DataFrame:
    """Person with most distinct matches per group; the earliest first date, then the lowest id, breaks ties."""
    counts = appearances.groupBy(*group, person).agg(F.count_distinct(match).alias("n_matches"), F.min(date).alias("first_date"))
    best = F.min(F.struct(-F.col("n_matches"), F.col("first_date"), F.col(person))).alias("_b")
    return counts.groupBy(*group).agg(best).select(
        *group, F.col(f"_b.{person}").alias(person), (-F.col("_b.col1")).alias("n_matches"), F.col("_b.first_date").alias("first_date")
    )


def prior_career(
    results: DataFrame, person: str, tournament: str, date: str = "match_date", win: str = "win", draw: str = "draw",
    starts: DataFrame | None = None,
) -> DataFrame:
    """Matches, wins and draws of each person strictly before the start of each tournament they took part in.

    A tournament starts on its own first match date. Results are added up per (person, date) first, then the starts
    are lined up among those dates and read a running total: no person's history is joined with itself.
    """
    starts = results.groupBy(tournament).agg(F.min(date).alias("_start")) if starts is None else starts
    asked = results.select(person, tournament).distinct().join(starts, tournament)
    daily = results.groupBy(person, F.col(date).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(win).alias("_w"), F.sum(draw).alias("_d")
    )
    lines = daily.select(
        person, "_at", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(results.schema[tournament].dataType).alias(tournament),
        "_n", "_w", "_d",
    ).unionByName(
        asked.select(
            person, F.col("_start").alias("_at"), F.lit(0).alias("_side"), F.xxhash64(tournament).alias("_tie"), tournament
        ),
        allowMissingColumns=True,
    )
    totals = running(
        lines, [person], ["_at", "_side", "_tie"],
        {"prior_matches": ("sum", F.col("_n")), "prior_wins": ("sum", F.col("_w")), "prior_draws": ("sum", F.col("_d"))},
    ).filter(F.col("_side") == 0)
    rate = F.when(F.col("prior_matches") > 0, F.col("prior_wins") / F.col("prior_matches")).otherwise(0.0)
    return totals.select(
        person, tournament, "prior_matches", "prior_wins", "prior_draws", rate.alias("prior_win_rate")
    )


def career_features_for_matches(
    matches: DataFrame, primary: DataFrame, careers: DataFrame, person: str, team: str, tournament: str,
    label: str = "tournament", target: str | None = "FIFA World Cup", cap: float = 30.0,
) -> DataFrame:
    """Prior career of each side's main coach, matches capped; only rows of the target tournament are filled."""
    features = primary.join(careers, [person, tournament]).select(
        F.col(team).alias("_t"), tournament, F.least(F.col("prior_matches").cast("double"), F.lit(cap)).alias("mgr_prior_matches"),
        F.col("prior_win_rate").alias("mgr_prior_win_rate"),
    )
    wanted = F.lit(True) if target is None else F.coalesce(F.col(label) == target, F.lit(False))
    keyed = matches.withColumn("_event", F.when(wanted, F.col(tournament)))
    return attach_to_sides(keyed, features, {"_event": tournament}, "_t", ["mgr_prior_matches", "mgr_prior_win_rate"]).drop("_event")


def attach_side_features(
    training: DataFrame, features: DataFrame, fixtures: DataFrame, bridge: DataFrame, cols: list[str],
    on: list[str], fixture: str = "fixture_id", team: str = "team_id", net: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Per-(fixture, team) features onto a match log, as home_, away_ and diff_ columns.

    ``fixtures``: (fixture, team, is_home) rows; only fixtures with both sides count. ``bridge``: (*on, fixture) rows.
    ``net``: name -> (for, against) columns, home net less away net. Both sides of a fixture come out of one
    aggregate, so the features are shuffled once by fixture and the match log once by its key.
    """
    wide_ids = fixtures.groupBy(fixture).agg(
        F.min(F.when(F.col("is_home"), F.col(team))).alias("_home_id"),
        F.min(F.when(~F.col("is_home"), F.col(team))).alias("_away_id"),
    ).filter(F.col("_home_id").isNotNull() & F.col("_away_id").isNotNull())
    linked = bridge.filter(F.col(fixture).isNotNull()).select(*on, fixture).join(wide_ids, fixture, "left")
    per_fixture = features.select(fixture, F.col(team).alias("_team"), *cols)
    sided = linked.select(fixture, "_home_id", "_away_id").distinct().join(per_fixture, fixture)

    def pick(side: str, c: str):
        return F.max(F.when(F.col("_team") == F.col(f"_{side}_id"), F.col(c))).alias(f"{side}_{c}")

    wide = sided.groupBy(fixture).agg(*[pick(side, c) for side in ("home", "away") for c in cols])
    diffs = {f"diff_{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in cols}
    for name, (own, other) in (net or {}).items():
        diffs[name] = (F.col(f"home_{own}") - F.col(f"home_{other}")) - (F.col(f"away_{own}") - F.col(f"away_{other}"))
    enriched = linked.select(*on, fixture).join(wide, fixture, "left").withColumns(diffs).drop(fixture)
    return training.join(enriched, on, "left")

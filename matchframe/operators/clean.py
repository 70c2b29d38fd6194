"""Filters and derived columns of the match log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.functions import constants, scores
from matchframe.operators.entity import apply_alias, resolve_temporal_alias
from matchframe.session import small_table
from matchframe.sources.tables import union_latest


def exclude_labels(df: DataFrame, col: str = "tournament", labels: list[str] | None = None) -> DataFrame:
    """Rows whose label is not listed; a missing label is kept."""
    listed = F.col(col).isin(constants.FRIENDLY_LABELS if labels is None else labels)
    return df.filter(~F.coalesce(listed, F.lit(False)))


def load_matches(
    df: DataFrame, since_year: int = 1998, former_names: DataFrame | None = None, tie: str = "ord"
) -> DataFrame:
    """Matches since a year with both scores; former team names resolved as of the match date.

    The year test comes first and is a plain range on ``date``, so it reaches the scan. Order only at the end.
    """
    since = F.make_timestamp_ntz(F.lit(since_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    kept = df.filter(F.col("date") >= since).na.drop(subset=["home_score", "away_score"])
    if former_names is not None:
        for side in ("home_team", "away_team"):
            kept = resolve_temporal_alias(kept, former_names, side, "date", tie=tie)
    return kept


def load_rankings(base: DataFrame, scraped: DataFrame | None, tie: list[str]) -> DataFrame:
    """Ranking rows of the base file plus later ones, team names as the match log writes them."""
    rows = base if scraped is None else union_latest(base, scraped, ["rank_date", "country_full"], tie)
    renamed = apply_alias(rows, "country_full", constants.RANKING_ALIASES, "team")
    return renamed.select("rank_date", "team", "rank", "total_points", "confederation")


def membership_table(spark) -> DataFrame:
    """(team, strength) of every listed team; small, so Catalyst broadcasts it."""
    rows = [
        (team, constants.GROUP_STRENGTH[group]) for group, teams in constants.GROUP_MEMBERS.items() for team in teams
    ]
    return small_table(spark, rows, "team string, strength double")


def group_strength(
    df: DataFrame, team: str, out: str, members: DataFrame | None = None, default: float | None = None
) -> DataFrame:
    """Strength of the team's group; a team in no list gets the default group's."""
    table = membership_table(df.sparkSession) if members is None else members
    default = constants.GROUP_STRENGTH[constants.DEFAULT_GROUP] if default is None else default
    lookup = table.select(F.col("team").alias("_team"), F.col("strength").alias("_strength"))
    joined = df.join(lookup, df[team].cast("string") == lookup["_team"].cast("string"), "left")
    return joined.withColumn(out, F.coalesce("_strength", F.lit(default))).drop("_team", "_strength")


def rating_inputs(df: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Match log with what a rating update needs per match: ``weight`` parts that do not depend on ratings."""
    both = group_strength(group_strength(df, "home_team", "_sh", members), "away_team", "_sa", members)
    gd = F.col("home_score") - F.col("away_score")
    return both.withColumns(
        {
            "event_weight": scores.event_weight(F.col("tournament")),
            "margin": scores.margin_multiplier(gd),
            "strength": (F.col("_sh") + F.col("_sa")) / 2,
        }
    ).drop("_sh", "_sa")


def diff_features(df: DataFrame, floor: float = 1e5) -> DataFrame:
    """Home minus away features of a match: rating, value, age, top player, injuries, ranking points."""

    def diff(name: str, fill: bool = False):
        home, away = F.col(f"home_{name}"), F.col(f"away_{name}")
        return F.coalesce(home, F.lit(0)) - F.coalesce(away, F.lit(0)) if fill else home - away

    rating = scores.effective_diff(F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("neutral"))
    return df.withColumns(
        {
            "elo_diff_norm": rating / 400,
            "log_value_diff": scores.log_ratio(F.col("home_top_n_value"), F.col("away_top_n_value"), floor),
            "outfield_age_diff": diff("outfield_mean_age"),
            "top1_share_diff": diff("top1_share"),
            "injury_share_diff": diff("injured_value_share", fill=True),
            "injured_top1_diff": diff("injured_top1", fill=True),
            "injured_top3_diff": diff("injured_top3_share", fill=True),
            "points_diff": diff("points", fill=True) / 1000,
        }
    )


def side_features(df: DataFrame, floor: float = 1e5) -> DataFrame:
    """Per-side inputs of the goal regression."""
    return df.withColumns(
        {
            f"{side}_{name}": value
            for side in ("home", "away")
            for name, value in {
                "elo": F.col(f"{side}_elo_pre") / 100,
                "logv": F.log10(scores.floored(F.col(f"{side}_top_n_value"), floor)),
                "fpts": F.coalesce(F.col(f"{side}_points"), F.lit(0)) / 1000,
            }.items()
        }
    )


def cross_features(df: DataFrame) -> DataFrame:
    """Attack of one side against defense of the other, and the expected goal difference."""
    return df.withColumns(
        {
            "attack_vs_def_h": (F.col("home_attack_pre") - F.col("away_defense_pre")) / 200,
            "attack_vs_def_a": (F.col("away_attack_pre") - F.col("home_defense_pre")) / 200,
            "expected_goal_diff": F.col("exp_home_goals") - F.col("exp_away_goals"),
        }
    )


def fill(df: DataFrame, cols: list[str], how: str = "zero", train: DataFrame | None = None) -> DataFrame:
    """Missing values as 0, or as the training mean (0 where the training column is empty)."""
    if how == "zero":
        return df.fillna(0, subset=cols)
    if how != "mean":
        raise ValueError(f"how must be 'zero' or 'mean', got {how!r}")
    means = (df if train is None else train).select(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    held = df.withColumn("_means", means)
    return held.withColumns({c: F.coalesce(F.col(c), F.col("_means")[c], F.lit(0.0)) for c in cols}).drop("_means")


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def floor_filter(df: DataFrame, cols: list[str], floor: float = 1e5) -> DataFrame:
    """Rows where every listed value is above the floor."""
    for c in cols:
        df = df.filter(F.col(c) > floor)
    return df


def role_flag(pos: str | None = None, profile: str | None = None, exact: dict[str, str] | None = None):
    """True for a goalkeeper: lineup position "G", else a profile text with "goal"; or an exact (column, value)."""
    if exact:
        ((col, value),) = exact.items()
        return F.coalesce(F.col(col) == value, F.lit(False))
    by_profile = F.coalesce(F.lower(F.col(profile)).contains("goal"), F.lit(False)) if profile else F.lit(False)
    by_pos = F.coalesce(F.col(pos) == "G", F.lit(False)) if pos else F.lit(False)
    return by_pos | by_profile


def newcomer_diff(home: str, away: str, label: str = "tournament", target: str = constants.TOP_EVENT):
    """1 for a home-side newcomer less 1 for an away-side one, where there is career data or a target match."""
    h, a = F.col(home), F.col(away)
    new_home, new_away = (F.coalesce((x == 0).cast("int"), F.lit(0)) for x in (h, a))
    known = F.coalesce(h + a > 0, F.lit(False)) | F.coalesce(F.col(label) == target, F.lit(False))
    return F.when(known, new_home - new_away).otherwise(0)


def min_support(df: DataFrame, n: str, k: int) -> DataFrame:
    """Groups with at least ``k`` matched members (6 for lineups, 5 for clubs, 10 for rosters)."""
    return df.filter(F.col(n) >= k)

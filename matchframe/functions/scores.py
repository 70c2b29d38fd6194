"""Column expressions over scores, ratings and odds. All of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchframe.functions.constants import MAJOR_EVENTS, TOP_EVENT

AWAY, DRAW, HOME = 0, 1, 2
CLIP = 1e-6


def outcome(home_score: Column, away_score: Column) -> Column:
    """2 home win, 1 draw, 0 away win; null where a score is missing."""
    return F.when(home_score > away_score, HOME).when(home_score == away_score, DRAW).when(home_score < away_score, AWAY)


def home_win(home_score: Column, away_score: Column) -> Column:
    """1 only for a home win; a draw counts as 0."""
    return (home_score > away_score).cast("int")


def event_weight(label: Column) -> Column:
    """Weight of a tournament label. The rules are ordered, so a major event's qualification keeps 1.5."""
    text = F.coalesce(label, F.lit(""))
    qualification = F.lower(text).contains("qualification")
    major = reduce(lambda a, b: a | b, [text.contains(name) for name in MAJOR_EVENTS])
    return (
        F.when(text.contains(TOP_EVENT) & ~qualification, 2.0)
        .when(major, 1.5)
        .when(qualification | F.lower(text).contains("qualifier"), 1.0)
        .otherwise(0.75)
    )


def margin_multiplier(goal_difference: Column) -> Column:
    gd = F.abs(goal_difference)
    return F.when(gd <= 1, 1.0).when(gd == 2, 1.5).otherwise(1.75 + (gd - 3) / 8)


def k_adjusted(label: Column, goal_difference: Column, strength_home: Column, strength_away: Column, k: float = 32.0):
    weight = F.least(event_weight(label) * margin_multiplier(goal_difference), F.lit(2.0))
    return F.lit(float(k)) * weight * ((strength_home + strength_away) / 2)


def expected_score(rating: Column, opponent: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (opponent - rating) / 400))


def effective_diff(home: Column, away: Column, neutral: Column, advantage: float = 100.0) -> Column:
    """Rating difference with the home advantage where the venue is not neutral (a missing flag is not neutral)."""
    return home + F.when(F.coalesce(neutral, F.lit(False)), 0.0).otherwise(advantage) - away


def expected_goals(
    attack: Column, defense: Column, advantage: Column | float = 0.0, base: float = 0.336, scale: float = 200.0
) -> Column:
    bonus = advantage if isinstance(advantage, Column) else F.lit(float(advantage))
    return F.exp(F.greatest(F.least(base + (attack - defense) / scale + bonus, F.lit(3.0)), F.lit(-3.0)))


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def implied_prob(odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), odds)


def overround(*odds: Column) -> Column:
    return reduce(lambda a, b: a + b, [implied_prob(o) for o in odds])


def edge(prob: Column, odds: Column) -> Column:
    return prob - implied_prob(odds)


def kelly_fraction(prob: Column, odds: Column) -> Column:
    b = odds - 1
    return F.greatest(F.lit(0.0), F.try_divide(b * prob - (1 - prob), b))


def floored(value: Column, floor: float = 1e5) -> Column:
    return F.when(value.isNotNull(), F.greatest(value.cast("double"), F.lit(floor)))


def log_ratio(home: Column, away: Column, floor: float = 1e5) -> Column:
    return F.log10(floored(home, floor) / floored(away, floor))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def pick(p_away: Column, p_draw: Column, p_home: Column) -> Column:
    """Class with the largest probability; the lowest class wins a tie."""
    best = F.greatest(p_away, p_draw, p_home)
    return F.when(p_away == best, AWAY).when(p_draw == best, DRAW).when(p_home == best, HOME)


def pick_name(label: Column) -> Column:
    return F.when(label == AWAY, "away").when(label == DRAW, "draw").when(label == HOME, "home")


def log_loss_term(truth: Column, p_away: Column, p_draw: Column, p_home: Column) -> Column:
    p = F.when(truth == AWAY, p_away).when(truth == DRAW, p_draw).when(truth == HOME, p_home)
    return -F.ln(clipped(p))


def brier_term(truth: Column, p_away: Column, p_draw: Column, p_home: Column) -> Column:
    def square(p: Column, label: int) -> Column:
        miss = p - (truth == label).cast("double")
        return miss * miss

    return square(p_away, AWAY) + square(p_draw, DRAW) + square(p_home, HOME)


def binary_log_loss_term(truth: Column, p: Column) -> Column:
    q = clipped(p)
    return -F.when(truth == 1, F.ln(q)).otherwise(F.ln(1 - q))

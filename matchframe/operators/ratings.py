"""Sequential ratings.

A rating depends on every earlier match of both teams. Teams of a key (league, fold, parameter set) that are connected by
no chain of matches do not depend on each other, so each connected component of a key's teams is a chain of its own, and
chains are the parallelism. ``fold_in_periods`` cuts the log at period ends, finds the components of each period and
stores the state in between: the shorter the periods, the smaller the components, and the more tasks a period has. What
the chains of a key share is its years, as all known ratings are pulled to the mean at the key's first match of a later
year; every chain gets the list of years its key plays in.

What does not depend on ratings (weights, strengths, flags) is computed by Spark beforehand. Matches are shuffled by chain
and sorted by Spark (which spills); Python then reads them batch by batch and holds nothing but the ratings of the current
chain, so its length does not matter for memory.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.functions import scores
from matchframe.operators.chains import components
from matchframe.operators.clean import rating_inputs
from matchframe.session import durable

# Tasks get the fold itself, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])



@dataclass(frozen=True)
class RatingParams:
    k: float = 32.0
    home_advantage: float = 100.0
    initial: float = 1500.0
    regression: float = 0.1


@dataclass(frozen=True)
class GoalRatingParams:
    k: float = 6.0
    scale: float = 200.0
    log_base: float = 0.336
    home_advantage: float = 0.25
    initial: float = 1500.0
    regression: float = 0.1


class _Single:
    """One rating per team, updated on the result."""

    width = 1
    columns = ("home_elo_pre", "away_elo_pre", "home_win_prob", "k_adjusted")

    def __init__(self, p: RatingParams):
        self.p = p

    def play(self, ratings: dict, home, away, hs: int, as_: int, home_ground: bool, k: float) -> tuple:
        p = self.p
        start = (p.initial,)
        (own,), (other,) = ratings.get(home, start), ratings.get(away, start)
        lift = p.home_advantage if home_ground else 0
        chance = 1 / (1 + 10 ** ((other - (own + lift)) / 400))
        result = 1.0 if hs > as_ else (0.5 if hs == as_ else 0.0)
        ratings[home] = (own + k * (result - chance),)
        ratings[away] = (other + k * ((1 - result) - (1 - chance)),)
        return own, other, chance, k


class _AttackDefense:
    """Attack and defense rating per team, updated on compressed goal residuals."""

    width = 2
    columns = (
        "home_attack_pre", "home_defense_pre", "away_attack_pre", "away_defense_pre", "exp_home_goals", "exp_away_goals",
    )

    def __init__(self, p: GoalRatingParams):
        self.p = p

    def play(self, ratings: dict, home, away, hs: int, as_: int, home_ground: bool, k: float) -> tuple:
        p = self.p
        start = (p.initial, p.initial)
        (ha, hd), (aa, ad) = ratings.get(home, start), ratings.get(away, start)

        def rate(attack: float, defense: float, bonus: float) -> float:
            return math.exp(min(max(p.log_base + (attack - defense) / p.scale + bonus, -3.0), 3.0))

        def residual(goals: int, expected: float) -> float:
            return math.copysign(math.sqrt(abs(goals - expected)), goals - expected)

        lh, la = rate(ha, ad, p.home_advantage if home_ground else 0.0), rate(aa, hd, 0.0)
        dh, da = k * residual(hs, lh), k * residual(as_, la)
        if home == away:  # a team against itself: the later write of each rating counts
            ratings[home] = (aa + da, hd - da)
        else:
            ratings[home] = (ha + dh, hd - da)
            ratings[away] = (aa + da, ad - dh)
        return ha, hd, aa, ad, lh, la


def _folder(make: Callable, params, emit_states: bool, emit_matches: bool, names: list[str]):
    """Streaming fold over rows sorted by (key, component, kind, time): years of the key, held ratings, matches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule = make(params)
        blank = (None,) * len(rule.columns)
        chain, key, year, years, ratings = None, None, None, [], {}
        ratings_of = [f"r{i}" for i in range(rule.width)]
        keep = 1 - params.regression

        def states(after: int | None) -> list[tuple]:
            return [(key, "state", None, year, after, team, *blank, *r) for team, r in ratings.items()]

        def turn_to(y: int | None) -> list[tuple]:
            """Go through the key's years up to ``y`` (all of them if none is given); the states at their ends."""
            nonlocal year, ratings
            out = []
            for later in years:
                if (year is None or later > year) and (y is None or later <= y):
                    if year is not None:
                        out.extend(states(later) if emit_states else [])
                        ratings = {t: tuple(params.initial + keep * (x - params.initial) for x in r) for t, r in ratings.items()}
                    year = later
            return out

        names_out = ["key", "kind", "match_id", "year", "next_year", "team", *rule.columns, *ratings_of]
        for batch in batches:
            out, ended, last = [], [], []
            columns = [batch[c].tolist() for c in names]
            for k_, part, kind, match, y, home, away, hs, as_, ground, k, *held in zip(*columns):
                if (k_, part) != chain:
                    if chain is not None:
                        ended.extend(turn_to(None))
                        last.extend(states(None) if emit_states else [])
                    chain, key, year, years, ratings = (k_, part), k_, None, [], {}
                if kind < 0:  # a year in which the key plays
                    years = sorted({*years, y})
                    continue
                if kind == 0:  # rating held from before
                    ratings[home] = tuple(held)
                    year = y
                    continue
                ended.extend(turn_to(y))
                row = rule.play(ratings, home, away, hs, as_, ground, k)
                if emit_matches:
                    out.append((k_, "match", match, y, None, None, *row, *((None,) * rule.width)))
            # Rows of a kind go out together: a column of numbers mixed with nulls would turn into floats.
            for rows in (out, ended, last):
                if rows:
                    yield pd.DataFrame(rows, columns=names_out)
        if chain is not None:
            ended = turn_to(None)
            for rows in (ended, states(None) if emit_states else []):
                if rows:
                    yield pd.DataFrame(rows, columns=names_out)

    return fold


def _run(
    matches: DataFrame, make: Callable, params, key: str, state: DataFrame | None, emit: str, k: "F.Column",
    neutral_default: bool,
) -> DataFrame:
    """Union of match rows and state rows of a fold (``kind``), slim columns only; one chain a (key, component).

    A held team that does not play is a chain of its own.
    """
    rule = make(params)
    team_type = matches.schema["home_team"].dataType.simpleString()
    key_type = matches.schema[key].dataType.simpleString()
    ratings_of = [f"r{i}" for i in range(rule.width)]
    ground = ~F.coalesce(F.col("neutral"), F.lit(neutral_default))
    parts = components(matches, key, "home_team", "away_team").withColumnsRenamed({"key": "_key", "team": "_team"})
    team = F.coalesce("home_team", "away_team")
    joined = matches.join(parts, (F.col(key) == F.col("_key")) & (team == F.col("_team")), "left")
    rows = joined.select(
        F.col(key).alias("key"), F.coalesce("component", team).alias("component"), F.lit(1).alias("kind"), F.col("match_id"), F.year("date").alias("year"),
        F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        F.col("home_score").alias("hs"), F.col("away_score").alias("as"), ground.alias("ground"), k.alias("k"),
        *[F.lit(None).cast("double").alias(r) for r in ratings_of], F.col("date").alias("at"),
    )
    none = F.lit(0)
    idle = [none.alias("hs"), none.alias("as"), F.lit(False).alias("ground"), F.lit(0.0).alias("k")]
    blank = F.lit(-1).cast("long").alias("match_id")
    chains = parts.select(F.col("_key").alias("key"), "component")
    if state is not None:
        held = state.join(parts, (F.col("key") == F.col("_key")) & (F.col("team") == F.col("_team")), "left")
        held = held.withColumn("component", F.coalesce("component", "team"))
        chains = chains.unionByName(held.select("key", "component"))
        rows = rows.unionByName(
            held.select("key", "component", none.alias("kind"), blank, "year", F.col("team").alias("home"), F.col("team").alias("away"), *idle, *ratings_of),
            allowMissingColumns=True,
        )
    years = matches.select(F.col(key).alias("key"), F.year("date").alias("year")).distinct()
    rows = rows.unionByName(
        chains.distinct().join(years, "key").select("key", "component", F.lit(-1).alias("kind"), blank, "year", *idle), allowMissingColumns=True
    )
    names = ["key", "component", "kind", "match_id", "year", "home", "away", "hs", "as", "ground", "k", *ratings_of]
    schema = (
        f"key {key_type}, kind string, match_id long, year int, next_year int, team {team_type}, "
        + ", ".join(f"{c} double" for c in (*rule.columns, *ratings_of))
    )
    ordered = rows.repartition(F.col("key"), F.col("component")).sortWithinPartitions("key", "component", "kind", "at", "match_id").select(*names)
    fold = _folder(make, params, emit in ("states", "both"), emit in ("matches", "both"), names)
    return ordered.mapInPandas(fold, schema)


def _match_rows(folded: DataFrame, rule) -> DataFrame:
    return folded.filter("kind = 'match'").select("match_id", "key", "year", *rule.columns)


def _state_rows(folded: DataFrame, rule) -> DataFrame:
    return folded.filter("kind = 'state'").select("key", "year", "next_year", "team", *[f"r{i}" for i in range(rule.width)])


def _single_k(p: RatingParams):
    return F.lit(p.k) * F.least(F.col("event_weight") * F.col("margin"), F.lit(2.0)) * F.col("strength")


def _goal_k(p: GoalRatingParams):
    return F.lit(p.k) * F.least(F.col("event_weight"), F.lit(2.0)) * F.col("strength")


def elo_fold(
    matches: DataFrame, key: str = "league", params: RatingParams = RatingParams(), members: DataFrame | None = None,
    state: DataFrame | None = None, neutral_default: bool = False,
) -> DataFrame:
    """(match_id, key, year, home_elo_pre, away_elo_pre, home_win_prob, k_adjusted) in (date, match_id) order."""
    ready = rating_inputs(matches, members)
    return _match_rows(_run(ready, _Single, params, key, state, "matches", _single_k(params), neutral_default), _Single)


def elo_states(
    matches: DataFrame, key: str = "league", params: RatingParams = RatingParams(), members: DataFrame | None = None,
    state: DataFrame | None = None, neutral_default: bool = False,
) -> DataFrame:
    """(key, year, next_year, team, r0): all ratings after the last match of each year played, before regression.

    ``next_year`` is the next year the key plays in, null for its last state. One pass serves every walk-forward
    fold, and the last state is the one to resume from.
    """
    ready = rating_inputs(matches, members)
    return _state_rows(_run(ready, _Single, params, key, state, "states", _single_k(params), neutral_default), _Single)


def attack_defense_fold(
    matches: DataFrame, key: str = "league", params: GoalRatingParams = GoalRatingParams(), members: DataFrame | None = None,
    state: DataFrame | None = None, neutral_default: bool = False,
) -> DataFrame:
    ready = rating_inputs(matches, members)
    folded = _run(ready, _AttackDefense, params, key, state, "matches", _goal_k(params), neutral_default)
    return _match_rows(folded, _AttackDefense)


def attack_defense_states(
    matches: DataFrame, key: str = "league", params: GoalRatingParams = GoalRatingParams(), members: DataFrame | None = None,
    state: DataFrame | None = None, neutral_default: bool = False,
) -> DataFrame:
    """(key, year, next_year, team, r0 = attack, r1 = defense) at the end of each year played."""
    ready = rating_inputs(matches, members)
    folded = _run(ready, _AttackDefense, params, key, state, "states", _goal_k(params), neutral_default)
    return _state_rows(folded, _AttackDefense)


def last_state(states: DataFrame) -> DataFrame:
    """State of each key after its last year: what ``state`` of a later fold takes."""
    return states.filter(F.col("next_year").isNull()).drop("next_year")


def fold_in_periods(matches: DataFrame, starts: list[int | date], key: str = "league", kind: str = "single", **options) -> tuple[DataFrame, DataFrame]:
    """The same fold as one job per period, with the state stored in between: (match rows, final state).

    ``starts`` are the first years, or the first days, of the periods. A lost executor costs a period, not the chain, and
    a task reads one component of one period of a key: with periods in which a team plays once, one match.
    """
    make, default, k = {
        "single": (_Single, RatingParams(), _single_k), "attack_defense": (_AttackDefense, GoalRatingParams(), _goal_k)
    }[kind]
    params = options.pop("params", default)
    members = options.pop("members", None)
    state, parts = options.pop("state", None), []
    ready = rating_inputs(matches, members)
    edges = [None, *sorted(date(s, 1, 1) if isinstance(s, int) else s for s in starts), None]
    for first, after in zip(edges, edges[1:]):
        part = ready
        part = part if first is None else part.filter(F.col("date") >= F.lit(first))
        part = part if after is None else part.filter(F.col("date") < F.lit(after))
        folded = durable(_run(part, make, params, key, state, "both", k(params), options.get("neutral_default", False)))
        parts.append(_match_rows(folded, make))
        state = last_state(_state_rows(folded, make))  # keys without a match in this period pass on what they held
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, state


def regress_to_mean(states: DataFrame, params=RatingParams(), cols: tuple[str, ...] = ("r0",)) -> DataFrame:
    """All ratings pulled towards the initial one, as at the first match of a later year."""
    keep = 1 - params.regression
    return states.withColumns({c: params.initial + keep * (F.col(c) - params.initial) for c in cols})


def current_ratings(states: DataFrame) -> DataFrame:
    """Final ratings, best first within each key; attack and defense also get their total."""
    final = last_state(states)
    if "r1" in states.columns:
        table = final.select("key", "team", F.col("r0").alias("attack"), F.col("r1").alias("defense"))
        return table.withColumn("total", F.col("attack") + F.col("defense")).orderBy("key", F.desc("total"), "team")
    return final.select("key", "team", F.col("r0").alias("elo")).orderBy("key", F.desc("elo"), "team")


def attack_defense_predict(pairs: DataFrame, ratings: DataFrame, key: str = "key", params: GoalRatingParams = GoalRatingParams()):
    """Expected goals of each pairing (key, home_team, away_team, neutral) from final ratings; unknown teams start fresh."""
    out = pairs
    for side in ("home", "away"):  # the same projection twice, so the ratings are computed once
        part = ratings.select(
            F.col("key").alias("_key"), F.col("team").alias("_team"), F.col("attack").alias("_a"), F.col("defense").alias("_d")
        )
        joined = out.join(part, (out[key] == part["_key"]) & (out[f"{side}_team"] == part["_team"]), "left")
        out = joined.drop("_key", "_team").withColumnsRenamed({"_a": f"_{side}_a", "_d": f"_{side}_d"})
    start = F.lit(params.initial)

    def r(name: str):
        return F.coalesce(F.col(name), start)

    bonus = F.when(F.coalesce(F.col("neutral"), F.lit(False)), 0.0).otherwise(params.home_advantage)
    return out.withColumns(
        {
            "lam_home": scores.expected_goals(r("_home_a"), r("_away_d"), bonus, params.log_base, params.scale),
            "lam_away": scores.expected_goals(r("_away_a"), r("_home_d"), 0.0, params.log_base, params.scale),
        }
    ).drop("_home_a", "_home_d", "_away_a", "_away_d")

"""Squad, roster and lineup features. All groups are computed at once; memo tables of single lookups become joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.dates import age_at, snapshot_key
from matchframe.operators.asof import active_interval, asof, daily_states, eligible_at, known_at, snapshots
from matchframe.operators.ordered import top_per_group
from matchframe.session import durable, written

FEATURES = [
    "total_value", "mean_value", "top_n_value", "outfield_mean_age", "gk_mean_age", "n_outfield", "n_gk",
    "top1_share", "injured_value_share", "n_injured_top_n", "injured_top1", "injured_top3_share",
]


def squad_features(
    players: DataFrame, keys: list[str], top_n: int = 23, n_gk: int = 3, player: str = "player_id",
    value: str = "value", age: str = "age", is_gk: str = "is_gk", injured: str | None = None, sizes: bool = True,
) -> DataFrame:
    """Value, age, concentration and injury features of each squad's most valuable players; ``n_players`` only with ``sizes``.

    The best ``top_n`` of each role hold every player any feature looks at, so all but those are cut before the
    shuffle (row-number limits run on both sides of it) and the rest works on a bounded squad.
    """
    best = [F.col(value).desc_nulls_last(), F.col(player)]
    sick = F.coalesce(F.col(injured), F.lit(False)) if injured else F.lit(False)
    slim = players.select(*keys, player, value, age, F.coalesce(F.col(is_gk), F.lit(False)).alias(is_gk), sick.alias("_sick"))
    squad = top_per_group(slim, [*keys, is_gk], best, top_n, rank="_role_rank").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    )
    top = F.col("_rank") <= top_n
    outfield = ~F.col(is_gk) & (F.col("_role_rank") <= max(top_n - n_gk, 0))
    keeper = F.col(is_gk) & (F.col("_role_rank") <= n_gk)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0)).cast("double")

    def weighted_age(cond: Column) -> Column:
        weight = F.sum(F.when(cond, F.col(value)))
        return F.when(weight != 0, F.sum(F.when(cond, F.col(age) * F.col(value))) / weight)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)

    top3 = F.col("_rank") <= min(3, top_n)
    features = squad.groupBy(*keys).agg(
        F.count_if(top).alias("n_with_value"),
        total(top).alias("total_value"),
        F.coalesce(F.avg(F.when(top, F.col(value))), F.lit(0.0)).alias("mean_value"),
        total(top).alias("top_n_value"),
        weighted_age(outfield).alias("outfield_mean_age"),
        weighted_age(keeper).alias("gk_mean_age"),
        F.count_if(outfield).alias("n_outfield"),
        F.count_if(keeper).alias("n_gk"),
        share(F.max(F.when(top, F.col(value))), total(top)).alias("top1_share"),
        F.coalesce(share(total(top & F.col("_sick")), total(top)), F.lit(0.0)).alias("injured_value_share"),
        F.count_if(top & F.col("_sick")).alias("n_injured_top_n"),
        F.max(((F.col("_rank") == 1) & F.col("_sick")).cast("int")).alias("injured_top1"),
        F.coalesce(share(total(top3 & F.col("_sick")), total(top3)), F.lit(0.0)).alias("injured_top3_share"),
    )
    return features.join(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_players")), keys) if sizes else features


def _valued(
    people: DataFrame, values: DataFrame, date: str, unique: list[str], value_tie: list[str],
    spells: DataFrame | None = None, spell_cols: tuple[str, str] = ("from_date", "end_date"),
) -> DataFrame:
    """People rows with their player's latest value at or before the date, and whether a spell covers the date."""
    rows = asof(people, values, ["player_id"], ["player_id"], date, "date", {"value": "value"}, unique, value_tie)
    if spells is None:
        return rows.withColumn("injured", F.lit(False))
    return active_interval(rows, spells, "player_id", date, *spell_cols, unique, "injured")


def squad_value(
    appearances: DataFrame, team_map: DataFrame, values: DataFrame, dates: DataFrame | Column,
    states: tuple[str, ...] = ("CURRENT_NATIONAL_PLAYER",), top_n: int = 23, value_tie: list[str] | None = None,
) -> DataFrame:
    """Value of each country's current roster on a date: total and mean over all, sum of the ``top_n``."""
    rosters = appearances.filter(F.col("career_state").isin(*states)).select("team_id", "player_id").distinct()
    people = team_map.select("country", "team_id").join(rosters, "team_id").withColumn("as_of", dates)
    valued = durable(
        _valued(people, values, "as_of", ["team_id", "player_id"], value_tie or []).select("country", "team_id", "player_id", "value")
    )
    known = valued.filter(F.col("value").isNotNull())
    top = top_per_group(known, ["country"], [F.col("value").desc(), F.col("player_id")], top_n)
    totals = valued.groupBy("country", "team_id").agg(
        F.count(F.lit(1)).alias("n_players"), F.count("value").alias("n_with_value"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_value"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_value"),
    )
    tops = top.groupBy("country").agg(F.sum("value").alias("top_n_value"))
    return totals.join(tops, "country", "left").withColumn("top_n_value", F.coalesce("top_n_value", F.lit(0.0)))


def squad_value_table(*args, countries: list[str] | None = None, **kwargs) -> DataFrame:
    """``squad_value`` of many countries, most valuable first."""
    table = squad_value(*args, **kwargs)
    table = table.filter(F.col("country").isin(countries)) if countries is not None else table
    return table.orderBy(F.desc("top_n_value"), "country")


def historical_squad_value(
    snaps: DataFrame, appearances: DataFrame, profiles: DataFrame, values: DataFrame, spells: DataFrame | None = None,
    team: str = "team_id", date: str = "snapshot", born: str = "date_of_birth",
    is_gk: Column | None = None, age: Column | None = None, min_age: float = 17, max_age: float = 37,
    top_n: int = 23, n_gk: int = 3, value_tie: list[str] | None = None, spell_cols: tuple[str, str] = ("from_date", "end_date"),
) -> DataFrame:
    """Squad features of everybody eligible for a team at a snapshot; a team nobody appeared for gets a missing row.

    A player's value at a date is looked up once, whatever the number of teams the player is eligible for.
    """
    members = written(appearances.select(team, "player_id").distinct())
    years = age_at(F.col(date), F.col(born)) if age is None else age
    asked = eligible_at(snaps, members, profiles, team, "player_id", date, years, born, min_age, max_age).select("player_id", date).distinct()
    known = written(known_at(asked, values, "player_id", date, value_tie or [], spells, spell_cols))
    # the lookups join the players first, so members are shuffled by player only
    dated = members.join(profiles.filter(F.col(born).isNotNull()).join(known, "player_id"), "player_id").join(snaps, [team, date])
    pool = dated.withColumn("age", years).filter(F.col("age").between(min_age, max_age))
    pool = pool.withColumn("is_gk", is_gk if is_gk is not None else F.coalesce(F.col("main_position") == "Goalkeeper", F.lit(False)))
    valued = pool.select(team, date, "player_id", "age", "is_gk", "value", "injured")
    eligible = valued.groupBy(team, date).agg(F.count(F.lit(1)).alias("n_eligible"), F.nullif(F.count("value"), F.lit(0)).alias("n_players"))
    features = squad_features(valued.filter(F.col("value").isNotNull()), [team, date], top_n, n_gk, injured="injured", sizes=False)
    rows = snaps.select(team, date).distinct().join(eligible, [team, date], "left").join(features, [team, date], "left")
    return rows.withColumn("missing", F.col("n_with_value").isNull())


def attach_to_sides(
    matches: DataFrame, features: DataFrame, keys: dict[str, str], team: str, cols: list[str]
) -> DataFrame:
    """Features of both teams as home_/away_ columns. ``keys``: match column -> feature column besides the team."""
    # The same projection serves both joins, so Spark computes and ships the features once.
    out = matches
    names = {team: "_team"} | {f: f"_k_{m}" for m, f in keys.items()} | {c: f"_v_{c}" for c in cols}
    for side in ("home", "away"):
        part = features.select(*[F.col(c).alias(n) for c, n in names.items()])
        cond = out[f"{side}_team"] == part["_team"]
        for m in keys:
            cond = cond & (out[m] == part[f"_k_{m}"])
        joined = out.join(part, cond, "left").drop("_team", *[f"_k_{m}" for m in keys])
        out = joined.withColumnsRenamed({f"_v_{c}": f"{side}_{c}" for c in cols})
    return out


def squad_value_for_matches(
    matches: DataFrame, appearances: DataFrame, profiles: DataFrame, values: DataFrame, spells: DataFrame | None = None,
    grain: str = "month", cols: list[str] | None = None, **options,
) -> DataFrame:
    """``historical_squad_value`` for the distinct (team, snapshot) pairs of a match log, attached to both sides."""
    cols = cols or ["top_n_value", "outfield_mean_age", "gk_mean_age", "top1_share", "injured_value_share"]
    snaps = snapshots(matches, ["home_team", "away_team"], "date", grain).withColumnRenamed("entity", "team_id")
    features = historical_squad_value(snaps, appearances, profiles, values, spells, **options)
    keyed = matches.withColumn("snapshot", snapshot_key(F.col("date"), grain))
    return attach_to_sides(keyed, features, {"snapshot": "snapshot"}, "team_id", cols).drop("snapshot")


def roster_features(
    rosters: DataFrame, links: DataFrame, people: DataFrame, values: DataFrame, spells: DataFrame | None = None,
    keys: tuple[str, ...] = ("team", "tournament", "as_of"), top_n: int = 23, n_gk: int = 3,
    value_tie: list[str] | None = None, spell_cols: tuple[str, str] = ("from_date", "end_date"), age: Column | None = None,
) -> DataFrame:
    """Squad features of real rosters (``roster_id``, ``is_gk`` and ``keys`` per entry), through links to valued players.

    ``as_of`` is the date features are taken at: 1 June of the tournament year, or each match date.
    """
    joined = rosters.join(links.select("roster_id", "player_id"), "roster_id", "left").join(people.select("roster_id", "birth_date"), "roster_id", "left")
    joined = written(joined.select(*keys, "roster_id", "player_id", "birth_date", "is_gk"))
    matched = _matched(joined)
    support = joined.groupBy(*keys).agg(
        F.count_distinct("roster_id").alias("n_roster"),
        F.count_distinct(F.when(F.col("birth_date").isNotNull(), F.col("player_id"))).alias("n_matched"),
    )
    asked = matched.filter(F.col("as_of").isNotNull()).select("player_id", "as_of").distinct()
    known = known_at(asked, values, "player_id", "as_of", value_tie or [], spells, spell_cols).filter(F.col("value").isNotNull())
    valued = matched.join(known, ["player_id", "as_of"]).withColumn("age", _roster_age(age))
    features = squad_features(durable(valued.select(*keys, "player_id", "value", "age", "is_gk", "injured")), list(keys), top_n, n_gk, injured="injured")
    return support.join(features, list(keys), "left").withColumn("missing", F.col("n_with_value").isNull())


def _matched(joined: DataFrame) -> DataFrame:
    return joined.filter(F.col("player_id").isNotNull() & F.col("birth_date").isNotNull())


def _roster_age(age: Column | None) -> Column:
    return age_at(F.col("as_of"), F.col("birth_date")) if age is None else age


def tournament_start(year: Column) -> Column:
    """Default date of roster features."""
    return F.make_date(year, F.lit(6), F.lit(1))


def roster_features_for_matches(
    matches: DataFrame, rosters: DataFrame, links: DataFrame, people: DataFrame, values: DataFrame,
    spells: DataFrame | None = None, min_matched: int = 10, tournament: str = "tournament_id", **options,
) -> DataFrame:
    """Roster features of both sides as of the match date; sides with too few matched players get nulls.

    ``rosters`` has one row per (team, tournament, player). Only the (team, tournament, date) triples that occur
    in matches are computed.
    """
    cols = ["top_n_value", "outfield_mean_age", "gk_mean_age", "top1_share", "injured_value_share", "injured_top1",
            "injured_top3_share", "n_matched"]
    listed = F.array("home_team", "away_team")
    wanted = matches.select(
        F.explode(listed).alias("team"), F.col(tournament).alias("tournament"), F.to_date("date").alias("as_of")
    ).distinct()
    features = _rosters_on_dates(rosters, wanted.filter(F.col("as_of").isNotNull()), links, people, values, spells, min_matched, **options)
    keyed = matches.withColumn("_day", F.to_date("date"))
    return attach_to_sides(keyed, features, {tournament: "tournament", "_day": "as_of"}, "team", cols).drop("_day")


def _rosters_on_dates(
    rosters: DataFrame, dates: DataFrame, links: DataFrame, people: DataFrame, values: DataFrame, spells: DataFrame | None,
    min_matched: int, top_n: int = 23, n_gk: int = 3, value_tie: list[str] | None = None,
    spell_cols: tuple[str, str] = ("from_date", "end_date"), age: Column | None = None,
) -> DataFrame:
    """Squad features and n_matched of rosters at every date (team, tournament, as_of) of their tournament, where there are
    valued players and at least ``min_matched`` matched ones.

    Rosters are not copied to dates: a player's value holds over a span of days, and of all players whose value holds over
    the same dates, the best ``top_n`` of each role are all that these dates can need. Only those are copied. Spans are
    looked up year by year, so that a lookup is of bounded size.
    """
    keys = ["team", "tournament"]
    year = F.year("as_of").alias("_year")
    asked = written(dates.groupBy(*keys, year).agg(F.sort_array(F.collect_set("as_of")).alias("_days")))
    linked = rosters.join(asked.select(*keys).distinct(), keys).join(links.select("roster_id", "player_id"), "roster_id")
    linked = linked.join(people.select("roster_id", "birth_date"), "roster_id")
    matched = written(_matched(linked).select(*keys, "player_id", "birth_date", F.coalesce("is_gk", F.lit(False)).alias("is_gk")))
    support = matched.groupBy(*keys).agg(F.count_distinct("player_id").alias("n_matched")).filter(F.col("n_matched") >= min_matched)

    ends = asked.agg(F.max(F.array_max("_days")).alias("_last"), F.min("_year").alias("_from"))
    spans = daily_states(values, "player_id", value_tie or [], spells, spell_cols).crossJoin(F.broadcast(ends)).filter("day <= _last")
    years = F.sequence(F.greatest(F.year("day"), "_from"), F.year(F.least(F.date_sub("until", 1), "_last")))
    spans = spans.filter("until is null or year(date_sub(until, 1)) >= _from").select("player_id", F.struct("day", "until", "value", "reach").alias("s"), F.explode(years).alias("_year"))
    spans = spans.groupBy("player_id", "_year").agg(F.collect_list("s").alias("_spans"))

    held = matched.join(asked, keys).join(spans, ["player_id", "_year"])
    near = F.filter("_spans", lambda s: (s["day"] <= F.get("_days", F.size("_days") - 1)) & (s["until"].isNull() | (s["until"] > F.get("_days", F.lit(0)))))
    held = held.select(*keys, "player_id", "birth_date", "is_gk", "_days", F.explode(near).alias("s"))
    low = F.array_min(F.filter("_days", lambda d: d >= F.col("s.day"))).alias("_low")
    high = F.array_max(F.filter("_days", lambda d: F.col("s.until").isNull() | (d < F.col("s.until")))).alias("_high")
    held = held.select(*keys, "player_id", "birth_date", "is_gk", low, high, "s.value", "s.reach").filter("_low <= _high")
    best = top_per_group(held, [*keys, "is_gk", "_low", "_high"], [F.col("value").desc(), F.col("player_id")], top_n)
    on = best.join(dates.distinct(), keys).filter("as_of between _low and _high").withColumn("age", _roster_age(age))
    on = on.withColumn("injured", F.coalesce(F.col("reach") >= F.col("as_of").cast("timestamp_ntz"), F.lit(False)))
    return squad_features(on, [*keys, "as_of"], top_n, n_gk, injured="injured", sizes=False).join(support, keys)


def overlay(primary: DataFrame, fallback: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Fallback rows with the primary's values where there are any."""
    first = primary.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = fallback.join(first, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_p_{c}", c) for c in cols}).drop(*[f"_p_{c}" for c in cols])


def prefer_dedupe(df: DataFrame, key: str, flag: Column, tie: list[str]) -> DataFrame:
    """One row per key, a flagged one where there is any."""
    return top_per_group(df, [key], [flag.desc_nulls_last(), *[F.col(c) for c in tie]])


def top_class_clubs(clubs: DataFrame, classes: list[str], club: str = "club_id", label: str = "competition_id"):
    """Clubs of the listed competitions, one row each."""
    flag = F.col(label).isin(classes)
    return prefer_dedupe(clubs, club, flag, [label]).filter(flag).select(club, label)


def exposure(
    squad: DataFrame, keys: list[str], clubs: DataFrame, top_n: int = 23, player: str = "player_id",
    value: str = "value", club: str = "club_id",
) -> DataFrame:
    """Among the ``top_n`` most valuable players: count, share and value share at a listed club.

    ``squad`` holds one valued row per player with the club at that date (null where unknown).
    """
    top = top_per_group(squad, keys, [F.col(value).desc_nulls_last(), F.col(player)], top_n)
    flagged = top.join(clubs.select(F.col(club).alias("_listed")).distinct(), F.col(club) == F.col("_listed"), "left")
    hit = F.col("_listed").isNotNull()
    total = F.sum(value)
    features = flagged.groupBy(*keys).agg(
        F.count(club).alias("n_with_club"),
        F.count_if(hit).alias("count_top_n"),
        F.avg(hit.cast("double")).alias("share_top_n"),
        F.when(total > 0, F.coalesce(F.sum(F.when(hit, F.col(value))), F.lit(0)) / total).otherwise(0.0).alias("value_share"),
    )
    return features


def lineup_exposure(lineups: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Matched players, flagged players and their share per lineup."""
    return lineups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.sum(F.col(flag).cast("int")).alias("flagged"),
        F.avg(F.col(flag).cast("double")).alias("share"),
    )


def lineup_players(
    lineups: DataFrame, links: DataFrame, fixtures: DataFrame, starters_only: bool = True,
    fixture: str = "fixture_id", left_id: str = "player_id",
) -> DataFrame:
    """Linked lineup entries with their fixture's date; unmatched players and undated fixtures drop out."""
    rows = lineups.filter(F.col(left_id).isNotNull())
    rows = rows.filter("is_starter") if starters_only else rows
    dates = fixtures.select(fixture, "date").filter(F.col("date").isNotNull()).distinct()
    return rows.join(links, left_id).join(dates, fixture)


def lineup_features(players: DataFrame, keys: list[str], age: str = "age", value: str = "value", is_gk: str = "is_gk"):
    """Matched, outfield and keeper counts, mean ages, and the top player's share of the value (null value as 0)."""
    gk, worth = F.col(is_gk), F.coalesce(F.col(value), F.lit(0.0))
    total = F.sum(worth)
    return players.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.count_if(~gk).alias("n_outfield"),
        F.count_if(gk).alias("n_gk"),
        F.avg(F.when(~gk, F.col(age))).alias("outfield_age"),
        F.avg(F.when(gk, F.col(age))).alias("gk_age"),
        F.when(total > 0, F.max(worth) / total).alias("top1_share"),
    )

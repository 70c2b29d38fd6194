"""Entity resolution: aliases, and linking records of two sources by fuzzy keys.

Every link compares aggregated keys, never the pairs inside a block: a block that holds a third of all rows
costs what its distinct names cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions import text
from matchframe.operators.ordered import top_per_group
from matchframe.session import small_table


def alias_table(spark, aliases: dict[str, str]) -> DataFrame:
    return small_table(spark, list(aliases.items()), "alias string, target string")


def apply_alias(df: DataFrame, col: str, aliases: DataFrame | dict[str, str], out: str) -> DataFrame:
    """The alias' target where there is one, else the name itself. ``aliases``: (alias, target)."""
    table = alias_table(df.sparkSession, aliases) if isinstance(aliases, dict) else aliases
    lookup = table.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    joined = df.join(lookup, F.col(col) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_target", col)).drop("_alias", "_target")


def _fold(name: Column) -> Column:
    return F.lower(F.trim(name))


def resolve_alias(
    df: DataFrame, col: str, aliases: DataFrame | dict[str, str], known: DataFrame, known_col: str, out: str
) -> DataFrame:
    """Name as the known list writes it, ignoring case: an alias first (its target must be known), then a direct hit."""
    table = alias_table(df.sparkSession, aliases) if isinstance(aliases, dict) else aliases
    listed = known.groupBy(_fold(F.col(known_col)).alias("_known")).agg(F.max(known_col).alias("_name"))
    hits = table.join(listed, _fold(F.col("target")) == F.col("_known"), "left").select(
        _fold(F.col("alias")).alias("_alias"), F.lit(True).alias("_aliased"),
        F.when(F.col("_known").isNotNull(), F.col("target")).alias("_target"),
    )
    joined = df.join(hits, _fold(F.col(col)) == F.col("_alias"), "left").join(
        listed, _fold(F.col(col)) == F.col("_known"), "left"
    )
    resolved = F.when(F.col("_aliased"), F.col("_target")).otherwise(F.col("_name"))
    return joined.withColumn(out, resolved).drop("_alias", "_aliased", "_target", "_known", "_name")


def resolve_temporal_alias(
    df: DataFrame, former_names: DataFrame, col: str, date: str, tie: str = "ord",
    former: str = "former", current: str = "current", start: str = "start_date", end: str = "end_date",
) -> DataFrame:
    """Former name to current name while start <= date <= end. Of a repeated former name the last row counts."""
    last = top_per_group(former_names, [former], [F.col(tie).desc()]).select(
        F.col(former).alias("_former"), F.col(current).alias("_current"),
        F.col(start).alias("_start"), F.col(end).alias("_end"),
    )
    joined = df.join(last, F.col(col) == F.col("_former"), "left")
    valid = F.col(date).between(F.col("_start"), F.col("_end"))
    renamed = F.when(valid, F.col("_current")).otherwise(F.col(col))
    return joined.withColumn(col, renamed).drop("_former", "_current", "_start", "_end")


def explode_multi(df: DataFrame, col: str, pattern: str = r"\s{2,}", out: str | None = None) -> DataFrame:
    """One row per value of a multi-valued text; values are trimmed, empty ones dropped."""
    exploded = df.withColumn(out or col, F.explode(F.split(F.col(col), pattern)))
    return exploded.withColumn(out or col, F.trim(out or col)).filter(F.col(out or col) != "")


def link_exact(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left id, right id, keys) on equal keys. The right side keeps its first id per key; missing keys never match."""
    for k in keys:
        left, right = (df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != "")) for df in (left, right))
    first = right.groupBy(*keys).agg(F.min(right_id).alias(right_id))
    return left.select(left_id, *keys).join(first, keys).select(left_id, right_id, *keys)


def _substrings(name: Column) -> Column:
    """All distinct substrings of a name."""
    n = F.length(name)
    starts = F.sequence(F.lit(1), n)
    return F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(name, i, k))))
    )


def link_partial(
    left: DataFrame, right: DataFrame, block: str, name: str, left_id: str, right_id: str
) -> DataFrame:
    """(left id, right id) where exactly one name of the same block contains, or is contained in, the left name.

    Containment is looked up, not tested pair by pair: the shorter name must equal a substring of the longer one.
    The right side is first reduced to one row per (block, name) (the first id counts, as in ``link_exact``), the
    substrings of each side are joined with the names of the other, and hits are counted once per right name.
    Cost grows with rows times substrings of a name, whatever the size of a block.
    """
    usable = F.col(block).isNotNull() & (F.col(name) != "")
    lhs = left.filter(usable).select(F.col(left_id).alias("_l"), F.col(block).alias("_b"), F.col(name).alias("_n"))
    rhs = right.filter(usable).groupBy(F.col(block).alias("_b"), F.col(name).alias("_n")).agg(
        F.min(right_id).alias("_r")
    )
    # right name inside the left name (equal names included)
    inside = lhs.select("_l", "_b", F.explode(_substrings(F.col("_n"))).alias("_n")).join(rhs, ["_b", "_n"]).select("_l", "_r")
    # left name strictly inside the right name; counted per (block, substring) before it meets the left side
    wanted = lhs.select("_b", F.col("_n").alias("_s")).distinct()
    around = (
        rhs.join(lhs.select("_b").distinct(), "_b", "left_semi")
        .select("_b", "_r", "_n", F.explode(_substrings(F.col("_n"))).alias("_s"))
        .filter(F.col("_s") != F.col("_n"))
        .join(wanted, ["_b", "_s"], "left_semi")
        .groupBy("_b", "_s")
        .agg(F.count(F.lit(1)).alias("_hits"), F.min("_r").alias("_r"))
    )
    outside = lhs.join(around, (lhs["_b"] == around["_b"]) & (lhs["_n"] == around["_s"])).select("_l", "_r", "_hits")
    hits = inside.withColumn("_hits", F.lit(1).cast("long")).unionByName(outside)
    counted = hits.groupBy("_l").agg(F.sum("_hits").alias("_hits"), F.min("_r").alias("_r"))
    return counted.filter(F.col("_hits") == 1).select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def link_all(left: DataFrame, right: DataFrame, name: str, block: str, left_id: str, right_id: str) -> DataFrame:
    """Exact links on (name, block), then partial ones for the left rows without any; ``match_type`` says which."""
    exact = link_exact(left, right, [name, block], left_id, right_id).select(left_id, right_id)
    rest = left.join(exact.select(left_id), left_id, "left_anti")
    partial = link_partial(rest, right, block, name, left_id, right_id)
    return exact.withColumn("match_type", F.lit("exact")).unionByName(partial.withColumn("match_type", F.lit("partial")))


def candidate_pool(appearances: DataFrame, profiles: DataFrame, pool: str, player: str) -> DataFrame:
    """Profiles of all who ever appeared for a pool (team), once per pool."""
    members = appearances.select(pool, player).distinct()
    return members.join(profiles, player)


def link_cascade(
    left: DataFrame, candidates: DataFrame, pool: str, left_name: str, right_name: str, right_id: str
) -> DataFrame:
    """Best link of each left row within its pool: the first tier that fits.

    Tiers: exact_name (full names only, exactly one), surname_initial (exactly one), surname_initial_ambiguous
    (several: lowest id), surname_only (exactly one), unmatched. Each tier looks up one aggregated row per key.
    """
    norm = text.normalise_name(text.cut_at_bracket(F.col(right_name)))
    people = candidates.select(
        F.col(pool).alias("_pool"), F.col(right_id).alias("_id"), norm.alias("_name"),
        text.surname(norm).alias("_surname"), text.initial(norm).alias("_initial"),
    )

    def tier(keys: list[str], tag: str) -> DataFrame:
        return people.groupBy("_pool", *keys).agg(F.count(F.lit(1)).alias(f"_n_{tag}"), F.min("_id").alias(f"_id_{tag}"))

    whole = text.normalise_name(F.col(left_name))
    rows = left.withColumns(
        {
            "_pool": F.col(pool),
            "_name": F.when(
                ~text.is_initial_form(whole),
                F.nullif(text.normalise_name(text.cut_at_bracket(F.col(left_name))), F.lit("")),
            ),
            "_surname": text.surname(whole),
            "_initial": text.initial(whole),
        }
    )
    joined = (
        rows.join(tier([], "pool"), "_pool", "left")
        .join(tier(["_name"], "full"), ["_pool", "_name"], "left")
        .join(tier(["_surname", "_initial"], "both"), ["_pool", "_surname", "_initial"], "left")
        .join(tier(["_surname"], "last"), ["_pool", "_surname"], "left")
    )
    full, both, last = F.col("_n_full") == 1, F.col("_n_both") >= 1, F.col("_n_last") == 1
    linked = F.when(full, F.col("_id_full")).when(both, F.col("_id_both")).when(last, F.col("_id_last"))
    quality = (
        F.when(full, "exact_name")
        .when(F.col("_n_both") == 1, "surname_initial")
        .when(both, "surname_initial_ambiguous")
        .when(last, "surname_only")
        .otherwise("unmatched")
    )
    return joined.select(
        *[joined[c] for c in left.columns],
        linked.alias(right_id),
        quality.alias("match_quality"),
        F.coalesce("_n_pool", F.lit(0)).alias("n_candidates"),
    )


def link_report(links: DataFrame, linked: str, country: str, team: str, min_rows: int = 50, worst: int = 10, unmatched: int = 20) -> dict[str, DataFrame]:
    """Match quality tables: per quality, overall, per country, worst countries, teams with most unmatched rows."""
    counts = [F.count(F.lit(1)).alias("n_players"), F.count(linked).alias("matched")]
    rate = F.try_divide(F.col("matched"), F.col("n_players")).alias("match_rate")
    per_country = links.filter(F.col(country).isNotNull()).groupBy(country).agg(*counts).select("*", rate)
    return {
        "quality": links.groupBy("match_quality").count(),
        "overall": links.agg(*counts).select("*", rate),
        "per_country": per_country,
        "worst": per_country.filter(F.col("n_players") >= min_rows).orderBy("match_rate", country).limit(worst),
        "unmatched": links.filter(F.col(linked).isNull()).groupBy(team).count().orderBy(F.desc("count"), team).limit(unmatched),
    }


def link_fixtures(
    left: DataFrame, right: DataFrame, day: str, home: str, away: str,
    right_day: str, right_home: str, right_away: str, right_id: str,
) -> DataFrame:
    """Left rows within the right side's dates, with the fixture of the same unordered pair on that day, else the next.

    ``shift_days`` is 0 for the same day, -1 where the fixture's date is one day later, null without a fixture.
    """
    first, last = (right.select(f(right_day)).scalar() for f in (F.min, F.max))
    rows = left.filter((F.col(day) >= first) & (F.col(day) <= last))

    def pair(a: str, b: str) -> Column:
        a, b = F.col(a).cast("string"), F.col(b).cast("string")
        return F.concat_ws("|", F.least(a, b), F.greatest(a, b))

    fixtures = right.select(
        pair(right_home, right_away).alias("_pair"), F.col(right_day).alias("_day"), F.col(right_id).alias("_id")
    )
    # One shuffle of the fixtures: each is offered on its own day (preferred) and the day before.
    offers = fixtures.select(
        "_pair",
        F.explode(
            F.array(
                F.struct(F.col("_day").alias("d"), F.lit(0).alias("shift")),
                F.struct(F.date_sub("_day", 1).alias("d"), F.lit(-1).alias("shift")),
            )
        ).alias("_o"),
        "_id",
    ).groupBy("_pair", F.col("_o.d").alias("_d")).agg(
        F.min_by(F.struct("_id", F.col("_o.shift").alias("shift")), F.struct(-F.col("_o.shift"), F.col("_id"))).alias("_best")
    )
    keyed = rows.withColumn("_pair", pair(home, away))
    joined = keyed.join(offers, (keyed["_pair"] == offers["_pair"]) & (keyed[day] == offers["_d"]), "left")
    return joined.select(
        *[keyed[c] for c in left.columns], F.col("_best._id").alias(right_id), F.col("_best.shift").alias("shift_days")
    )


def link_coverage(links: DataFrame, label: str, linked: str, n: int = 20) -> DataFrame:
    """Rows, linked rows and rate per label, largest labels first."""
    counts = links.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"), F.count(linked).alias("matched")
    )
    return counts.withColumn("rate", F.col("matched") / F.col("rows")).orderBy(F.desc("rows"), label).limit(n)


def vote_group_country(
    appearances: DataFrame, profiles: DataFrame, group: str = "team_id", player: str = "player_id",
    values: str = "citizenship", weight: str = "matches", min_players: int = 3, senior_only: bool = True,
    pattern: str = r"\s{2,}",
) -> DataFrame:
    """Country of each group by majority over its distinct (player, citizenship) pairs; ties go to the first name.

    ``confidence`` is the winner's share of the group's players. ``senior_only`` keeps, per country, the group with
    the highest single weight. Players are first made distinct over all columns, so no group meets in one task.
    """
    citizens = explode_multi(profiles.select(player, F.col(values).alias("country")), "country", pattern)
    per_player = appearances.groupBy(group, player).agg(F.max(weight).alias("_w"))
    pairs = per_player.join(citizens.distinct(), player)
    votes = pairs.groupBy(group, "country").agg(F.count(F.lit(1)).alias("votes"))
    with_citizenship = per_player.join(citizens.select(player).distinct(), player, "left_semi")
    sizes = with_citizenship.groupBy(group).agg(F.count(F.lit(1)).alias("n_players"), F.max("_w").alias("max_matches"))
    winners = votes.groupBy(group).agg(F.min(F.struct(-F.col("votes"), F.col("country"))).alias("_top"))
    mapped = (
        winners.join(sizes.filter(F.col("n_players") >= min_players), group)
        .select(group, F.col("_top.country").alias("country"), "n_players", "max_matches",
                (-F.col("_top.col1") / F.col("n_players")).alias("confidence"))
    )
    if not senior_only:
        return mapped
    return top_per_group(mapped, ["country"], [F.col("max_matches").desc_nulls_last(), F.col(group)])

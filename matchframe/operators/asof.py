"""Point-in-time joins. None of them joins on an inequality: both sides are lined up by time within the key.

That keeps a join linear in its rows, and a key with very many rows is cut into time chunks (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.dates import snapshot_key
from matchframe.operators.ordered import running

_KEY, _AT, _SIDE, _TIE = "_key", "_at", "_side", "_tie"
_ORDER = [_AT, _SIDE, _TIE]


def _lined_up(
    left: DataFrame, right: DataFrame, left_by: list[str], right_by: list[str], left_on: str, right_on: str,
    left_tie: list[str], right_tie: list[str], payload: Column, right_first: bool = True,
) -> DataFrame:
    """Both sides as rows (key, time, side, tie, left row, right payload). Unused slots are null."""

    def key(by: list[str]) -> Column:
        return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])

    def tie(cols: list[str]) -> Column:
        return F.array(*[F.col(c).cast("long") for c in cols])

    lrow = F.struct(*[F.col(c) for c in left.columns])
    lside = left.select(
        key(left_by).alias(_KEY), F.col(left_on).cast("timestamp_ntz").alias(_AT),
        F.lit(1 if right_first else 0).alias(_SIDE), tie(left_tie).alias(_TIE), lrow.alias("_left"),
    )
    rside = right.filter(F.col(right_on).isNotNull()).select(
        key(right_by).alias(_KEY), F.col(right_on).cast("timestamp_ntz").alias(_AT),
        F.lit(0 if right_first else 1).alias(_SIDE), tie(right_tie).alias(_TIE), payload.alias("_right"),
    )
    return lside.unionByName(rside, allowMissingColumns=True)


def asof(
    left: DataFrame, right: DataFrame, left_by: list[str], right_by: list[str], left_on: str, right_on: str,
    values: dict[str, str], left_tie: list[str], right_tie: list[str],
    fallback: str | None = None, fallback_values: dict[str, str] | None = None,
) -> DataFrame:
    """Left rows with ``values`` (right column -> new name) of the latest right row at or before the left time.

    Left rows without one get null, or with ``fallback``:
    ``earliest``: the values of the key's earliest right row;
    ``first_known``: per value, the earliest non-null of the right column named in ``fallback_values``.
    ``left_tie`` names unique integer columns of the left, ``right_tie`` orders equal right times.
    """
    payload = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    rows = _lined_up(left, right, left_by, right_by, left_on, right_on, left_tie, right_tie, payload)
    matched = running(rows, [_KEY], _ORDER, {"_hit": ("last", F.col("_right"))}).filter(F.col("_left").isNotNull())
    names = list(values.values())
    if fallback is None:
        return matched.select("_left.*", *[F.col(f"_hit.{n}").alias(n) for n in names])

    at = F.struct(F.col(right_on), *[F.col(c) for c in right_tie])
    dated = right.filter(F.col(right_on).isNotNull())
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(right_by)]).alias(_KEY)
    if fallback == "earliest":
        firsts = [F.min_by(F.col(c), at).alias(f"_f_{n}") for c, n in values.items()]
    elif fallback == "first_known":
        firsts = [
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_f_{n}")
            for n, c in (fallback_values or {n: c for c, n in values.items()}).items()
        ]
    else:
        raise ValueError(f"unknown fallback {fallback!r}")
    first = dated.groupBy(key).agg(*firsts)
    joined = matched.join(first, _KEY, "left")
    if fallback == "earliest":
        out = [F.when(F.col("_hit").isNotNull(), F.col(f"_hit.{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in names]
    else:
        out = [F.coalesce(f"_hit.{n}", f"_f_{n}").alias(n) for n in names]
    return joined.select("_left.*", *out)


def asof_both_sides(
    matches: DataFrame, right: DataFrame, right_by: str, right_on: str, values: dict[str, str],
    match_id: str = "match_id", date: str = "date", right_tie: list[str] | None = None, fallback: str | None = "earliest",
) -> DataFrame:
    """As-of values of both teams as home_/away_ columns.

    Only (match, side, team, date) goes through the as-of join; the wide match rows are joined once, on their id.
    """
    sides = matches.select(
        match_id, date,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("home"), F.col("home_team").alias("team")),
                F.struct(F.lit(0).alias("home"), F.col("away_team").alias("team")),
            )
        ).alias("_s"),
    ).select(match_id, date, F.col("_s.home").alias("_home"), F.col("_s.team").alias("_team"))
    found = asof(
        sides, right, ["_team"], [right_by], date, right_on, values, [match_id, "_home"], right_tie or [], fallback
    )
    wide = found.groupBy(match_id).agg(
        *[
            F.max(F.when(F.col("_home") == flag, F.col(n))).alias(f"{side}_{n}")
            for side, flag in (("home", 1), ("away", 0))
            for n in values.values()
        ]
    )
    return matches.join(wide, match_id, "left")


def state_at(changes: DataFrame, date: Column, by: str, on: str, to: str, origin: str, tie: list[str], out: str) -> DataFrame:
    """State per key on one date: ``to`` of the latest change until then, else ``origin`` of the earliest row.

    The origin counts even where it is null; keys without a state are dropped. Two aggregates, no join.
    """
    at = F.struct(F.col(on), *[F.col(c) for c in tie])
    past = F.col(on) <= date
    agg = changes.groupBy(by).agg(
        F.max(past).alias("_seen"),
        F.max_by(F.col(to), F.when(past, at)).alias("_to"),
        F.min_by(F.col(origin), at).alias("_origin"),
    )
    state = F.when(F.col("_seen"), F.col("_to")).otherwise(F.col("_origin"))
    return agg.select(by, state.alias(out)).filter(F.col(out).isNotNull())


def latest_on_or_before(values: DataFrame, by: str, on: str, date: Column, cols: list[str], tie: list[str]) -> DataFrame:
    """Last values per entity up to one snapshot date."""
    at = F.struct(F.col(on), *[F.col(c) for c in tie])
    return values.filter(F.col(on) <= date).groupBy(by).agg(*[F.max_by(F.col(c), at).alias(c) for c in cols])


def active_interval(
    df: DataFrame, spells: DataFrame, by: str, on: str, start: str, end: str, tie: list[str], out: str = "active"
) -> DataFrame:
    """Whether any spell of the entity covers the row's time (both ends included).

    A spell that started by then covers the time exactly if the latest end of all started spells does.
    """
    payload = F.struct(F.col(end).cast("timestamp_ntz").alias("end"))
    rows = _lined_up(df, spells, [by], [by], on, start, tie, [], payload)
    reached = running(rows, [_KEY], _ORDER, {"_end": ("max", F.col("_right.end"))}).filter(F.col("_left").isNotNull())
    covered = F.coalesce(F.col("_end") >= F.col(_AT), F.lit(False))
    return reached.select("_left.*", covered.alias(out))


def _events(values: DataFrame, by: str, value_tie: list[str], spells: DataFrame | None, spell_cols: tuple[str, str]) -> DataFrame:
    """Values (column ``date``) and starts of spells as rows (by, time, tie, value in a struct or null, end of the spell or null)."""
    tie = F.array(*[F.col(c).cast("long") for c in value_tie]).alias(_TIE)
    dated = values.filter(F.col("date").isNotNull() & F.col(by).isNotNull())
    rows = dated.select(by, F.col("date").cast("timestamp_ntz").alias(_AT), tie, F.struct("value").alias("_value"), F.lit(None).cast("timestamp_ntz").alias("_end"))
    if spells is None:
        return rows
    start, end = spell_cols
    begun = spells.filter(F.col(start).isNotNull() & F.col(by).isNotNull())
    return rows.unionByName(begun.select(by, F.col(start).cast("timestamp_ntz").alias(_AT), F.col(end).cast("timestamp_ntz").alias("_end")), allowMissingColumns=True)


def known_at(
    asked: DataFrame, values: DataFrame, by: str, on: str, value_tie: list[str],
    spells: DataFrame | None = None, spell_cols: tuple[str, str] = ("from_date", "end_date"),
) -> DataFrame:
    """(by, on, value, injured) for the pairs of ``asked``, which differ and are not null: the latest value until the
    time, null without one, and whether a spell covers the time (both ends included). One pass serves both."""
    events = _events(values, by, value_tie, spells, spell_cols).withColumn(_SIDE, F.lit(0))
    times = asked.select(by, F.col(on).alias("_on"), F.col(on).cast("timestamp_ntz").alias(_AT), F.lit(1).alias(_SIDE))
    order = [_AT, _SIDE, _TIE] if value_tie else [_AT, _SIDE]
    rows = times.unionByName(events, allowMissingColumns=True).select(by, *order, "_on", "_value", "_end")
    known = running(rows, [by], order, {"_hit": ("last", F.col("_value")), "_reach": ("max", F.col("_end"))}).filter(f"{_SIDE} = 1")
    return known.select(by, F.col("_on").alias(on), F.col("_hit.value").alias("value"), F.coalesce(F.col("_reach") >= F.col(_AT), F.lit(False)).alias("injured"))


def daily_states(
    values: DataFrame, by: str, value_tie: list[str], spells: DataFrame | None = None, spell_cols: tuple[str, str] = ("from_date", "end_date"),
) -> DataFrame:
    """(by, day, until, value, reach): what is known of an entity at midnight of each day from ``day`` to the one before
    ``until`` (null: from then on); a spell covers such a day if ``reach`` is not before it. Days without a value are left out.

    At most one row a day, so an entity has no more rows than days, however many values it has.
    """
    midnight = F.to_date(_AT)
    day = F.when(midnight.cast("timestamp_ntz") < F.col(_AT), F.date_add(midnight, 1)).otherwise(midnight)
    at = F.struct(_AT, _TIE) if value_tie else F.col(_AT)
    is_value = F.col("_value").isNotNull()
    daily = _events(values, by, value_tie, spells, spell_cols).groupBy(by, day.alias("day")).agg(
        F.max_by(F.col("_value.value"), F.when(is_value, at)).alias("value"), F.max(is_value).alias("_known"), F.max("_end").alias("_end")
    )
    so_far = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    held = daily.select(
        by, "day", F.lead("day").over(Window.partitionBy(by).orderBy("day")).alias("until"),
        F.last(F.when(F.col("_known"), F.struct("value")), ignorenulls=True).over(so_far)["value"].alias("value"), F.max("_end").over(so_far).alias("reach"),
    )
    return held.filter(F.col("value").isNotNull())


def snapshots(df: DataFrame, entities: list[str], date: str, grain: str = "month", out: str = "snapshot") -> DataFrame:
    """Distinct (entity, snapshot date) pairs of all entity columns: what has to be computed once."""
    listed = F.array(*[F.col(c) for c in entities])
    return df.select(F.explode(listed).alias("entity"), snapshot_key(F.col(date), grain).alias(out)).distinct()


def eligible_at(
    snaps: DataFrame, members: DataFrame, profiles: DataFrame, team: str, player: str, date: str,
    age: Column, born: str, min_age: float = 17, max_age: float = 37,
) -> DataFrame:
    """Everyone who ever appeared for the team and whose known age at the snapshot is within bounds."""
    people = members.select(team, player).distinct().join(profiles.filter(F.col(born).isNotNull()), player)
    pool = snaps.join(people, team).withColumn("age", age)
    return pool.filter(F.col("age").between(min_age, max_age))


def latest_snapshot_per_entity(
    matches: DataFrame, cols: list[str], match_id: str = "match_id", date: str = "date",
    entities: DataFrame | None = None, entity: str = "team", default: str = "mean",
) -> DataFrame:
    """Most recent features of each entity, from either side of its latest match (home side on a tie of dates).

    ``cols`` are base names of home_/away_ pairs. Entities without a match get the pooled mean, or are refused.
    """
    sides = [
        F.struct(F.col(f"{side}_team").alias("team"), F.lit(flag).alias("home"), *[F.col(f"{side}_{c}").alias(c) for c in cols])
        for side, flag in (("home", 1), ("away", 0))
    ]
    long = matches.select(match_id, date, F.explode(F.array(*sides)).alias("_s")).select(match_id, date, "_s.*")
    at = F.struct(F.col(date), F.col("home"), F.col(match_id))
    latest = long.groupBy("team").agg(
        F.max(date).alias("last_date"), F.max_by(F.struct(*cols), at).alias("_v")
    ).select("team", "last_date", "_v.*")
    if entities is None:
        return latest
    wanted = entities.select(F.col(entity).alias("team")).distinct().join(latest, "team", "left")
    if default == "error":
        missing = F.raise_error(F.concat(F.lit("no match for "), F.col("team").cast("string")))
        return wanted.withColumn("last_date", F.coalesce("last_date", missing.cast(latest.schema["last_date"].dataType)))
    means = long.select(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    absent = F.col("last_date").isNull()
    return wanted.withColumns({c: F.when(absent, means[c]).otherwise(F.col(c)) for c in cols})

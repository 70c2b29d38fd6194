"""Text keys and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions import text
from matchframe.operators import entity
from matchframe.plans.registry import query

_WORDS = "split_part(player_name, ' ', {})"


@query(
    "normalised_texts", "C1", "doc_id:l chars:l digest:s",
    """select doc_id, length(n) as chars, md5(n) as digest
       from (select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) as n from documents)""",
)
def _(v):
    norm = text.normalise_name(F.col("text"))
    return v("documents").select("doc_id", norm.alias("n")).select("doc_id", F.length("n").alias("chars"), F.md5("n").alias("digest"))


@query(
    "clean_names", "C2", "player_id:l stripped:s cut:s",
    """select player_id, case when player_id % 2 = 0 then player_name else player_name || ' (x)' end as stripped, 
       case when player_id % 2 = 0 then player_name || ' ' else player_name || ' ' end as cut from profiles""",
)
def _(v):
    raw = F.when(F.col("player_id") % 2 == 0, F.concat("player_name", F.lit(" ("), "player_id", F.lit(") "))).otherwise(
        F.concat("player_name", F.lit(" (x)"))
    )
    return v("profiles").select("player_id", text.strip_id_suffix(raw).alias("stripped"), text.cut_at_bracket(raw).alias("cut"))


@query(
    "full_names", "C3", "player_id:l full_name:s",
    f"""select player_id, trim(coalesce(case when player_id % 3 > 0 then {_WORDS.format(1)} end, '') || ' '
          || coalesce(case when player_id % 5 > 0 then {_WORDS.format(2)} end, '')) as full_name from profiles""",
)
def _(v):
    words = F.split("player_name", " ")
    given, family = F.when(F.col("player_id") % 3 > 0, words[0]), F.when(F.col("player_id") % 5 > 0, words[1])
    return v("profiles").select("player_id", text.full_name(given, family).alias("full_name"))


_FORMS = f"""case player_id % 3 when 0 then player_name when 1 then substr(player_name, 1, 1) || '. ' || {_WORDS.format(2)}
   else {_WORDS.format(2)} end"""


def _forms(v):
    """Listed names: full, with an initial, or the surname alone."""
    words, i = F.split("player_name", " "), F.col("player_id") % 3
    short = F.concat(F.substring("player_name", 1, 1), F.lit(". "), words[1])
    name = F.when(i == 0, F.col("player_name")).when(i == 1, short).otherwise(words[1])
    return v("profiles").select("player_id", "country", name.alias("listed"))


@query(
    "name_tokens", "C4", "player_id:l initial:s surname:s is_initial_form:b",
    f"""select player_id, substr({_FORMS}, 1, 1) as initial, {_WORDS.format(2)} as surname, player_id % 3 = 1 as is_initial_form
        from profiles""",
)
def _(v):
    norm = text.normalise_name(F.col("listed"))
    return _forms(v).select(
        "player_id", text.initial(norm).alias("initial"), text.surname(norm).alias("surname"), text.is_initial_form(norm).alias("is_initial_form")
    )


_ALIASES = {"NATION_3": "NATION_4", "nation_5 ": "Nation_6", "NATION_7": "ATLANTIS"}


@query(
    "aliased_teams", "C5", "match_id:l team:s",
    """select match_id, case home_team when 3 then 'NATION_4' when 7 then 'ATLANTIS' else 'NATION_' || home_team end as team from matches""",
)
def _(v):
    rows = v("matches").select("match_id", F.concat(F.lit("NATION_"), "home_team").alias("raw"))
    return entity.apply_alias(rows, "raw", _ALIASES, "team")


@query(
    "resolved_teams", "C5", "match_id:l team:s",
    """select match_id, case when home_team = 3 then 'NATION_4' when home_team = 5 then 'Nation_6' when home_team = 7 then null
         when home_team < 20 then 'NATION_' || home_team end as team from matches""",
)
def _(v):
    rows = v("matches").select("match_id", F.concat(F.lit(" nation_"), "home_team").alias("raw"))
    known = v("nation").filter(F.col("n_nationkey") < 20)
    return entity.resolve_alias(rows, "raw", _ALIASES, known, "n_name", "team")


@query(
    "temporal_aliases", "C6", "match_id:l team:s",
    """with f as (select * from (select *, row_number() over (partition by former order by ord desc) as rn from former_names) where rn = 1)
       select match_id, case when date between start_date and end_date then current_name else 'NATION_' || home_team end as team
       from matches left join f on 'NATION_' || home_team = former""",
)
def _(v):
    rows = v("matches").select("match_id", "date", F.concat(F.lit("NATION_"), "home_team").alias("team"))
    return entity.resolve_temporal_alias(rows, v("former_names"), "team", "date", current="current_name")


_CITIZENS = "select player_id, case when player_id % 3 = 0 then position || '   ' || country when player_id % 3 = 1 then position end as citizenship from profiles"


def _citizens(v):
    i = F.col("player_id") % 3
    both = F.when(i == 0, F.concat("position", F.lit("   "), "country")).when(i == 1, F.col("position"))
    return v("profiles").select("player_id", both.alias("citizenship"))


@query(
    "exploded_citizenships", "C7", "player_id:l citizenship:s",
    f"select player_id, trim(unnest(regexp_split_to_array(citizenship, '\\s{{2,}}'))) as citizenship from ({_CITIZENS})",
)
def _(v):
    return entity.explode_multi(_citizens(v), "citizenship")


_LEFT = f"""select player_id + 100000 as roster_id, birth_key, case player_id % 4 when 0 then player_name when 1 then {_WORDS.format(1)}
   when 2 then player_name || ' ' || lower(position) else {_WORDS.format(2)} || ' ' || {_WORDS.format(1)} end as name from profiles"""
_RIGHT = "select player_id, birth_key, player_name as name from profiles"
_FIRST = f"select birth_key, name, min(player_id) as player_id from ({_RIGHT}) group by 1, 2"
_EXACT = f"select roster_id, r.player_id from ({_LEFT}) l join ({_FIRST}) r on l.birth_key = r.birth_key and l.name = r.name"
_PARTIAL = f"""select roster_id, min(r.player_id) as player_id from ({_LEFT}) l join ({_FIRST}) r on l.birth_key = r.birth_key
   and (contains(l.name, r.name) or contains(r.name, l.name)) {{}} group by 1 having count(*) = 1"""


def _sides(v):
    words, i = F.split("player_name", " "), F.col("player_id") % 4
    shown = (
        F.when(i == 0, F.col("player_name")).when(i == 1, words[0])
        .when(i == 2, F.concat_ws(" ", "player_name", "position")).otherwise(F.concat_ws(" ", words[1], words[0]))
    )
    people = v("profiles")
    left = people.select((F.col("player_id") + 100000).alias("roster_id"), "birth_key", text.normalise_name(shown).alias("name"))
    raw = F.concat("player_name", F.lit(" ("), "player_id", F.lit(")"))
    right = people.select("player_id", "birth_key", text.normalise_name(text.strip_id_suffix(raw)).alias("name"))
    return left, right


@query("exact_links", "C8", "roster_id:l player_id:l", _EXACT)
def _(v):
    left, right = _sides(v)
    return entity.link_exact(left, right, ["name", "birth_key"], "roster_id", "player_id")


@query("partial_links", "C9", "roster_id:l player_id:l", _PARTIAL.format(f"where roster_id not in (select roster_id from ({_EXACT}))"))
def _(v):
    left, right = _sides(v)
    exact = entity.link_exact(left, right, ["name", "birth_key"], "roster_id", "player_id")
    rest = left.join(exact.select("roster_id"), "roster_id", "left_anti")
    return entity.link_partial(rest, right, "birth_key", "name", "roster_id", "player_id")


@query(
    "all_links", "C10", "roster_id:l player_id:l match_type:s",
    f"""select roster_id, player_id, 'exact' as match_type from ({_EXACT}) union all
        select roster_id, player_id, 'partial' from ({_PARTIAL.format(f"where roster_id not in (select roster_id from ({_EXACT}))")})""",
)
def _(v):
    return entity.link_all(*_sides(v), "name", "birth_key", "roster_id", "player_id")


_CASCADE = f"""with l as (select player_id as listed_id, country, player_id % 3 as form, {_FORMS} as listed, {_WORDS.format(2)} as surname,
       substr({_FORMS}, 1, 1) as initial from profiles),
     r as (select player_id, country, player_name, {_WORDS.format(2)} as surname, substr(player_name, 1, 1) as initial from profiles
           where player_id % 5 <> 3),
     c as (select listed_id, any_value(form) as form, count(r.player_id) as n_candidates,
         count(*) filter (where form <> 1 and r.player_name = listed) as n1, min(r.player_id) filter (where form <> 1 and r.player_name = listed) as id1,
         count(*) filter (where r.surname = l.surname and r.initial = l.initial) as n2,
         min(r.player_id) filter (where r.surname = l.surname and r.initial = l.initial) as id2,
         count(*) filter (where r.surname = l.surname) as n3, min(r.player_id) filter (where r.surname = l.surname) as id3
       from l left join r using (country) group by 1)
   select listed_id, case when n1 = 1 then id1 when n2 >= 1 then id2 when n3 = 1 then id3 end as player_id,
     case when n1 = 1 then 'exact_name' when n2 = 1 then 'surname_initial' when n2 > 1 then 'surname_initial_ambiguous'
       when n3 = 1 then 'surname_only' else 'unmatched' end as match_quality, n_candidates from c"""


def _cascade(v):
    left = _forms(v).withColumnRenamed("player_id", "listed_id")
    pool = v("profiles").filter(F.col("player_id") % 5 != 3).select(
        "country", "player_id", F.concat("player_name", F.lit(" ("), "player_id", F.lit(")")).alias("player_name")
    )
    return entity.link_cascade(left, pool, "country", "listed", "player_name", "player_id")


@query("cascade_links", "C11", "listed_id:l player_id:l match_quality:s n_candidates:l", _CASCADE)
def _(v):
    return _cascade(v)


@query(
    "candidate_pools", "C12", "team_id:l player_id:l player_name:s",
    "select distinct team_id, player_id, player_name from lineups join profiles using (player_id)",
)
def _(v):
    return entity.candidate_pool(v("lineups"), v("profiles"), "team_id", "player_id")


def _report(v):
    return entity.link_report(_cascade(v), "player_id", "country", "country")


@query("link_quality", "C13", "match_quality:s count:l", f"select match_quality, count(*) as count from ({_CASCADE}) group by 1")
def _(v):
    return _report(v)["quality"]


@query(
    "link_overall", "C13", "n_players:l matched:l match_rate:d6",
    f"select count(*) as n_players, count(player_id) as matched, count(player_id) / count(*) as match_rate from ({_CASCADE})",
)
def _(v):
    return _report(v)["overall"]


_PER_COUNTRY = f"""select country, count(*) as n_players, count(x.player_id) as matched, count(x.player_id) / count(*) as match_rate
    from ({_CASCADE}) x join profiles p on p.player_id = listed_id group by 1"""


@query("link_worst_countries", "C13", "country:s n_players:l matched:l match_rate:d6",
       f"select * from ({_PER_COUNTRY}) where n_players >= 50 order by match_rate, country limit 10")
def _(v):
    return _report(v)["worst"]


@query(
    "link_unmatched_teams", "C13", "country:s count:l",
    f"""select country, count(*) as count from ({_CASCADE}) x join profiles p on p.player_id = listed_id
        where x.player_id is null group by 1 order by 2 desc, 1 limit 20""",
)
def _(v):
    return _report(v)["unmatched"]


_LINKED = """with r as (select match_id as fixture_id, cast(date as date) + cast(match_id % 2 as int) as day,
       case when match_id % 4 < 2 then home_team else away_team end as h, case when match_id % 4 < 2 then away_team else home_team end as a
       from matches where match_id % 3 <> 0 and date >= timestamp '1996-01-01 00:00:00'),
     k as (select least(h::varchar, a::varchar) || '|' || greatest(h::varchar, a::varchar) as pair, day, min(fixture_id) as fixture_id from r group by 1, 2),
     l as (select match_id, tournament, cast(date as date) as day, least(home_team::varchar, away_team::varchar) || '|' || greatest(home_team::varchar, away_team::varchar) as pair
       from matches)
   select match_id, tournament, coalesce(s.fixture_id, m.fixture_id) as fixture_id,
     case when s.fixture_id is not null then 0 when m.fixture_id is not null then -1 end as shift_days
   from l left join k s on s.pair = l.pair and s.day = l.day left join k m on m.pair = l.pair and m.day = l.day + 1
   where l.day between (select min(day) from r) and (select max(day) from r)"""


def _linked(v):
    m = v("matches").withColumn("day", F.to_date("date"))
    straight = F.col("match_id") % 4 < 2
    right = m.filter((F.col("match_id") % 3 != 0) & (F.col("date") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select(
        F.col("match_id").alias("fixture_id"), F.date_add("day", (F.col("match_id") % 2).cast("int")).alias("fixture_day"),
        F.when(straight, F.col("home_team")).otherwise(F.col("away_team")).alias("h"),
        F.when(straight, F.col("away_team")).otherwise(F.col("home_team")).alias("a"),
    )
    return entity.link_fixtures(m, right, "day", "home_team", "away_team", "fixture_day", "h", "a", "fixture_id")


@query("fixture_links", "C14", "match_id:l fixture_id:l shift_days:l", _LINKED)
def _(v):
    return _linked(v)


@query(
    "fixture_link_coverage", "C15", "tournament:s rows:l matched:l rate:d6",
    f"""select tournament, count(*) as rows, count(fixture_id) as matched, count(fixture_id) / count(*) as rate from ({_LINKED})
        where tournament is not null group by 1 order by 2 desc, 1 limit 20""",
)
def _(v):
    return entity.link_coverage(_linked(v), "tournament", "fixture_id")


@query(
    "group_countries", "C16", "team_id:l country:s n_players:l max_matches:l confidence:d6",
    f"""with c as (select distinct player_id, trim(unnest(regexp_split_to_array(citizenship, '\\s{{2,}}'))) as country from ({_CITIZENS}) where citizenship is not null),
         p as (select l_suppkey % 40 as team_id, l_partkey as player_id, max(cast(l_quantity as int)) as w from lineitem group by 1, 2),
         votes as (select team_id, country, count(*) as n from p join c using (player_id) group by 1, 2),
         sizes as (select team_id, count(*) as n_players, max(w) as max_matches from p where player_id in (select player_id from c) group by 1 having count(*) >= 3),
         top as (select *, row_number() over (partition by team_id order by n desc, country) as rn from votes),
         mapped as (select team_id, country, n_players, max_matches, n / n_players as confidence from top join sizes using (team_id) where rn = 1)
       select team_id, country, n_players, max_matches, confidence
       from (select *, row_number() over (partition by country order by max_matches desc, team_id) as rn from mapped) where rn = 1""",
)
def _(v):
    played = v("lineitem").select(
        (F.col("l_suppkey") % 40).alias("team_id"), F.col("l_partkey").alias("player_id"), F.col("l_quantity").cast("int").alias("matches")
    )
    return entity.vote_group_country(played, _citizens(v))

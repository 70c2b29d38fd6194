"""Views that give the given tables the shapes the operators work on. The text runs in Spark and in DuckDB."""

from __future__ import annotations

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "matches": """
select o_orderkey as match_id, o_orderdate as date, c_nationkey as home_team,
       cast((c_nationkey + 1 + o_orderkey % 24) % 25 as int) as away_team,
       cast(cast(floor(o_totalprice) as bigint) % 5 as int) as home_score,
       cast(cast(floor(o_totalprice / 7) as bigint) % 4 as int) as away_score,
       o_orderpriority as league,
       case when o_orderstatus = 'P' then true when o_orderstatus = 'F' then false end as neutral,
       case cast(o_orderkey % 8 as int) when 0 then 'Friendly' when 1 then 'FIFA World Cup'
            when 2 then 'FIFA World Cup qualification' when 3 then 'UEFA Euro'
            when 4 then 'UEFA Euro qualification' when 5 then 'Nations League' when 6 then 'Kirin Cup' end as tournament
from orders join customer on o_custkey = c_custkey""",
    "market_value": """
select event_id, user_id as player_id, ts as date, value from events where event_type = 'purchase'""",
    "transfers": """
select event_id, user_id as player_id, ts as transfer_date,
       case when cast(floor(value) as int) % 6 = 0 then null else cast(floor(value) as int) end as from_team_id,
       case when event_id % 11 = 0 then null else cast(regexp_extract(props, '[0-9]+', 0) as int) end as to_team_id
from events where event_type = 'signup'""",
    "appearances": """
select event_id as fixture_id, user_id as player_id, ts as date, event_type as team from events
where event_type in ('view', 'click')""",
    "spells": """
select event_id, user_id as player_id, ts as from_date, cast(floor(value) as int) as h from events
where event_type = 'error'""",
    "rankings": """
select c_nationkey as team, month as rank_date, points,
       rank() over (partition by month order by points desc, c_nationkey) as rnk
from (select c_nationkey, date_trunc('month', o_orderdate) as month, round(sum(o_totalprice), 2) as points
      from orders join customer on o_custkey = c_custkey group by 1, 2) t""",
    "team_stats": """
select l_orderkey as fixture_id, l_linestatus as team_side, cast(sum(l_quantity) as bigint) as sot, count(*) as shots
from lineitem group by l_orderkey, l_linestatus""",
    "lineups": """
select distinct l_orderkey as fixture_id, l_suppkey % 25 as team_id, l_partkey as player_id,
       (l_linenumber <= 4) as is_starter
from lineitem""",
    "profiles": """
select p_partkey as player_id, p_name as player_name, p_brand as country, p_size as birth_key, p_type as position
from part""",
    "coach_matches": """
select o_orderkey as fixture_id, o_custkey % 200 as coach_id, c_nationkey as team_id, o_orderdate as date,
       case when o_totalprice > 250000 then 1 else 0 end as win
from orders join customer on o_custkey = c_custkey""",
    "predictions": """
select match_id, model, yr, outcome, a / (a + d + h) as p_away, d / (a + d + h) as p_draw, h / (a + d + h) as p_home
from (select o_orderkey as match_id, model, cast(extract(year from o_orderdate) as int) as yr,
             cast(cast(floor(o_totalprice) as bigint) % 3 as int) as outcome,
             1.0e0 + (o_orderkey * model) % 7 as a, 1.0e0 + (o_orderkey + model) % 5 as d,
             1.0e0 + (o_custkey * model) % 9 as h
      from orders cross join (select 1 as model union all select 2 union all select 3) m) t""",
    "bets": """
select o_orderkey as bet_id, o_orderdate as date, o_custkey % 50 as account,
       1.2e0 + (o_orderkey % 40) / 10.0e0 as home_odds, 0.05e0 + (o_custkey % 90) / 100.0e0 as home_win_prob,
       case when o_orderstatus = 'F' then 1 else 0 end as home_win
from orders""",
    "former_names": """
select 1 as ord, 'NATION_3' as former, 'NATION_4' as current_name, timestamp '1996-01-01 00:00:00' as start_date,
       timestamp '1997-12-31 00:00:00' as end_date
union all select 2, 'NATION_5', 'NATION_6', timestamp '1995-01-01 00:00:00', null
union all select 3, 'NATION_3', 'NATION_7', timestamp '1998-01-01 00:00:00', timestamp '1999-06-30 00:00:00'""",
    "replicates": """
select date_trunc('month', o_orderdate) as replicate, c_nationkey % 5 as grp, o_orderkey as match_id,
       c_nationkey as home_team, cast((c_nationkey + 5 * (1 + o_orderkey % 4)) % 25 as int) as away_team,
       cast(cast(floor(o_totalprice) as bigint) % 4 as int) as home_score,
       cast(cast(floor(o_totalprice / 7) as bigint) % 3 as int) as away_score
from orders join customer on o_custkey = c_custkey""",
}

# Spark lists the three models per row; the text above joins them, which SQL without arrays has to.
SPARK_VIEWS = {
    "predictions": VIEWS["predictions"].replace(
        "from orders cross join (select 1 as model union all select 2 union all select 3) m",
        "from (select *, explode(array(1, 2, 3)) as model from orders)",
    )
}

"""Hand fixtures with worked answers."""

import math
import unicodedata

import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchframe.functions import constants, dates, scores, text
from matchframe.operators import clean, entity, evaluate, goals, matchups, profile, squads, standings, windows
from matchframe.session import small_table
from matchframe.sources import nested, tables


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


def test_days_are_floored(spark):
    a, b = ntz("2024-01-01 12:00:00"), ntz("2024-01-04 11:59:59")
    assert one(spark, dates.floor_days(a, b), dates.floor_days(b, a)) == (2, -3)


def test_missing_label_is_kept(spark):
    df = small_table(spark, [(1, "Friendly"), (2, None), (3, "Copa América")], "id int, tournament string")
    assert [r[0] for r in rows(clean.exclude_labels(df).select("id"))] == [2, 3]


def test_event_weight_rules_are_ordered(spark):
    labels = ["FIFA World Cup", "FIFA World Cup qualification", "UEFA Euro", "UEFA Euro qualification", "Cup qualifier", "Other", None]
    df = small_table(spark, list(enumerate(labels)), "id int, t string")
    got = [r[1] for r in rows(df.select("id", scores.event_weight(F.col("t"))))]
    assert got == [2.0, 1.0, 1.5, 1.5, 1.0, 0.75, 0.75]


def test_margins(spark):
    got = one(spark, *[scores.margin_multiplier(F.lit(g)) for g in (0, -1, 2, 3, 5)])
    assert got == (1.0, 1.0, 1.5, 1.75, 2.0)


def test_group_strength_default(spark):
    df = small_table(spark, [("Brazil",), ("Germany",), ("Nowhere",), ("Fiji",)], "t string")
    assert rows(clean.group_strength(df, "t", "s")) == [("Brazil", 0.9), ("Fiji", 0.3), ("Germany", 1.0), ("Nowhere", 1.0)]


def test_names_like_unicode_normalisation(spark):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]

    def expected(s):
        plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    df = small_table(spark, [(f"a{c}b",) for c in chars] + [("É. Müller-Lüdenscheidt",)], "a string")
    wrong = [r for r in df.select("a", text.normalise_name(F.col("a"))).collect() if r[1] != expected(r[0])]
    assert wrong == [] and one(spark, text.normalise_name(F.lit(None).cast("string"))) == ("",)


def test_stat_texts(spark):
    got = one(spark, *[text.coerce_stat(F.lit(s)) for s in ("54%", " 7 ", "", "x%", None, "1.5")])
    assert got == (0.54, 7.0, None, None, None, 1.5)


def test_statistics_last_value_wins(spark):
    body = '{"response":[{"team":{"id":3},"statistics":[{"type":"Fouls","value":1},{"type":"Fouls","value":"9"},{"type":"?","value":2}]},{"team":{"id":4}}]}'
    df = small_table(spark, [(1, body)], "fixture_id long, statistics_json string")
    got = rows(nested.flatten_statistics(df).select("team_id", "fouls", "red_cards"))
    assert got == [(3, 9.0, None), (4, None, None)]


def test_temporal_alias_bounds(spark):
    names = small_table(
        spark, [(1, "A", "B", "2000-01-01", "2000-12-31"), (2, "A", "C", "2001-01-01", "2001-12-31"), (3, "X", "Y", "2000-01-01", None)],
        "ord int, former string, current string, start_date string, end_date string",
    ).withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    df = small_table(spark, [("A", "2000-06-01"), ("A", "2001-01-01"), ("A", "2001-12-31"), ("A", "2002-01-01"), ("X", "2000-06-01")], "t string, d string")
    got = entity.resolve_temporal_alias(df.withColumn("d", F.to_date("d")), names, "t", "d")
    assert [r[0] for r in sorted(got.select("t", "d").collect(), key=lambda r: (r[1], r[0]))] == ["A", "X", "C", "C", "A"]


def test_alias_target_must_be_known(spark):
    df = small_table(spark, [("USA",), (" turkey",), ("france",), ("Mars",)], "t string")
    known = small_table(spark, [("United States",), ("France",)], "c string")
    got = entity.resolve_alias(df, "t", constants.LINEUP_ALIASES, known, "c", "country")
    assert rows(got) == [(" turkey", None), ("Mars", None), ("USA", "United States"), ("france", "France")]


def test_partial_links_need_exactly_one(spark):
    left = small_table(spark, [(1, 5, "neymar"), (2, 5, "ann lee"), (3, 6, "jo"), (4, 7, "zed"), (5, 5, "pele do santos")], "l long, b int, n string")
    right = small_table(
        spark, [(10, 5, "neymar da silva"), (11, 5, "ann"), (12, 5, "lee"), (13, 6, "joan"), (14, 6, "jo ann"), (15, 6, "joan"), (16, 5, "pele"), (17, 8, "zed")],
        "r long, b int, n string",
    )
    # 2 and 3 have two different names each, 4 has none on its date
    assert rows(entity.link_partial(left, right, "b", "n", "l", "r")) == [(1, 10), (5, 16)]


def test_partial_links_against_brute_force(spark):
    words = ["ann", "jo", "joan", "lee", "anne lee", "le", "o", "joanna", "eann"]
    names = [f"{a} {b}".strip() for a in words for b in ["", *words[:4]]]
    left = [(i, i % 3, n) for i, n in enumerate(names)]
    right = [(100 + i, (i * 7) % 3, n) for i, n in enumerate(names)]
    first = {}
    for r, b, n in right:
        first.setdefault((b, n), r)
    want = []
    for l, b, n in left:
        hits = [r for (rb, rn), r in first.items() if rb == b and (n in rn or rn in n)]
        if len(hits) == 1:
            want.append((l, hits[0]))
    got = entity.link_partial(
        small_table(spark, left, "l long, b int, n string"), small_table(spark, right, "r long, b int, n string"), "b", "n", "l", "r"
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_cascade_tiers(spark):
    pool = small_table(
        spark, [("P", 1, "Lionel Messi (1)"), ("P", 2, "Emi Martinez"), ("P", 3, "Eva Martínez"), ("P", 4, "Rui Costa"), ("Q", 5, "Rui Costa")],
        "pool string, id long, name string",
    )
    left = small_table(
        spark, [("P", "Lionel Messi"), ("P", "L. Messi"), ("P", "E. Martinez"), ("P", "X Costa"), ("P", "Nobody"), ("R", "Lionel Messi")],
        "pool string, listed string",
    )
    got = entity.link_cascade(left, pool, "pool", "listed", "name", "id")
    assert rows(got) == sorted([
        ("P", "E. Martinez", 2, "surname_initial_ambiguous", 4), ("P", "L. Messi", 1, "surname_initial", 4),
        ("P", "Lionel Messi", 1, "exact_name", 4), ("P", "Nobody", None, "unmatched", 4), ("P", "X Costa", 4, "surname_only", 4),
        ("R", "Lionel Messi", None, "unmatched", 0),
    ], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_opponent_edges(spark):
    base = small_table(spark, [(f, t) for f in (1, 2, 3) for t in ("a", "b")], "f int, t string")
    stats = small_table(spark, [(1, "a", 5), (1, "b", 6), (2, "a", 7)], "f int, t string, x int")
    got = rows(windows.with_opponent(base, stats, "f", "t", ["x"], ["x"]))
    # fixture 2: "a" has only its own statistics and is dropped, "b" has only the opponent's and stays
    assert got == [(1, "a", 5, 6), (1, "b", 6, 5), (2, "b", None, 7), (3, "a", None, None), (3, "b", None, None)]


def test_squad_without_keeper(spark):
    players = small_table(spark, [(1, i, float(10 * i), 20.0 + i, False, i == 3) for i in (1, 2, 3)], "team int, player_id long, value double, age double, is_gk boolean, hurt boolean")
    r = squads.squad_features(players, ["team"], 2, 1, injured="hurt").first()
    assert (r.n_players, r.n_with_value, r.total_value, r.gk_mean_age, r.outfield_mean_age) == (3, 2, 50.0, None, 23.0)
    assert (r.top1_share, r.injured_top1, r.n_injured_top_n, r.injured_value_share, r.injured_top3_share) == (0.6, 1, 1, 0.6, 0.6)


def test_kelly_ruin(spark):
    bets = small_table(spark, [(1, 0.9, 2.0, 1), (2, 1.0, 2.0, 0), (3, 0.9, 2.0, 1)], "id long, p double, odds double, won int").withColumn("a", F.lit(1))
    got = windows.kelly_bankroll(bets, ["a"], ["id"], "p", "odds", "won").orderBy("id").collect()
    assert [round(r.bankroll, 6) for r in got] == [1800.0, 0.0, 0.0] and [round(r.pnl, 6) for r in got] == [800.0, -1800.0, 0.0]


def test_even_probability_rounds_to_zero(spark):
    df = small_table(spark, [(0.5, 0), (0.5, 1), (0.51, 1)], "home_win_prob double, home_win int").withColumn("f", F.lit(1))
    r = evaluate.score_binary(df, ["f"]).first()
    assert round(r.accuracy, 6) == round(2 / 3, 6)


def test_ties_pick_the_lowest_class(spark):
    third = F.lit(1 / 3)
    assert one(spark, scores.pick(third, third, third), scores.pick(F.lit(0.2), F.lit(0.4), F.lit(0.4))) == (0, 1)


def test_calibration_edges(spark):
    df = small_table(spark, [(0.0, 1), (0.1, 0), (0.2, 1)], "p double, y int")
    first = rows(evaluate.calibration(df, "p", F.col("y"), [0, 0.1, 0.2], True))
    assert first == [(0, 2, 0.05, 0.5), (1, 1, 0.2, 1.0)]
    assert rows(evaluate.calibration(df, "p", F.col("y"), [0, 0.1, 0.2])) == [(0, 1, 0.1, 0.0), (1, 1, 0.2, 1.0)]


def test_zero_odds_do_not_raise(spark):
    assert one(spark, scores.implied_prob(F.lit(0.0)), scores.kelly_fraction(F.lit(0.5), F.lit(1.0))) == (None, 0.0)


def test_base_row_wins(spark):
    base = small_table(spark, [("x", 1, "base")], "k string, d int, v string")
    extra = small_table(spark, [("x", 1, "extra"), ("x", 2, "extra")], "k string, d int, v string")
    assert rows(tables.union_latest(base, extra, ["k", "d"], ["v"])) == [("x", 1, "base"), ("x", 2, "extra")]


def test_incremental_with_nothing_held(spark):
    df = small_table(spark, [(1,), (2,)], "d int")
    assert tables.incremental_after(df, df.filter("d > 5"), "d").count() == 2
    assert rows(tables.incremental_after(df, df.filter("d = 1"), "d")) == [(2,)]


def test_csv_round_trip(spark, tmp_path):
    df = small_table(spark, [("2020-01-02", 1.5), ("", None)], "rank_date string, total_points double")
    tables.write_table(df, str(tmp_path / "t.csv"), fmt="csv")
    back = tables.read_table(spark, str(tmp_path / "t.csv"), "rank_date date, total_points double", ["total_points"])
    assert rows(back) == [(1.5,), (None,)]


@pytest.mark.parametrize(
    "values",
    [
        [float((i * 7919) % 10007) ** 2 for i in range(3000)] + [123.0] * 2000,
        [-1e300, -2.5, -0.0, 0.0, 5e-324, -5e-324, 2.5, 1e300, float("inf"), float("-inf"), float("inf")],
        [7.0],
        [],
        [-3.0] * 500 + [-3.0000000000000004] * 3,
    ],
)
def test_exact_quantiles_by_radix(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = small_table(spark, [(x, 1.0) for x in values] + [(None, 2.0)], "x double, y double")
    (got, other) = profile.exact_quantiles(df, ["x", "y"], probs)
    ordered = sorted(values)

    def want(p):
        at = p * (len(ordered) - 1)
        lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
        return lo if lo == hi or at == math.floor(at) else lo + (hi - lo) * (at - math.floor(at))

    assert got == ([want(p) for p in probs] if values else [None] * len(probs))
    assert other[0] == 1.0 if values else other[0] == 2.0


def test_description_of_a_column_with_nan(spark):
    """NaN is the greatest value; infinities have their places."""
    df = small_table(spark, [(x,) for x in [1.0, float("nan"), float("-inf"), 3.0, float("nan"), None, 2.0]], "x double")
    (row,) = profile.describe(df, ["x"]).collect()
    assert (row["count"], row["min"], row.q25, row.q50) == (6, float("-inf"), 1.25, 2.5)
    assert math.isnan(row["max"]) and math.isnan(row.q75)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 57])
def test_pairs_of_numbered_blocks(spark, n, monkeypatch):
    monkeypatch.setattr(matchups, "BLOCK", 10)
    teams = [f"t{(37 * k) % 101:03d}" for k in range(n)]
    df = small_table(spark, [(t,) for t in teams + teams[:5] + [None]], "team string")
    assert sorted(tuple(r) for r in matchups.unordered_pairs(df).collect()) == [(a, b) for a in sorted(teams) for b in sorted(teams) if a < b]
    assert sorted((r.i, r.t) for r in matchups.numbered(df.where("team is not null").distinct().withColumnRenamed("team", "t"), "t").collect()) == list(enumerate(sorted(teams), 1))


def test_official_slots(spark):
    groups = "ABCDEFGHIJKL"
    table = small_table(
        spark, [(1, g, f"{g}{p}", 10 - p, 0, i, p) for i, g in enumerate(groups) for p in (1, 2, 3, 4)],
        "replicate int, grp string, team string, pts int, gd int, gf int, position int",
    )
    slots = standings.slot_table(spark, constants.KNOCKOUT_48, 73)
    got = {r.slot: (r.team_a, r.team_b) for r in standings.resolve_slots(table, slots, ["replicate"]).collect()}
    assert len(got) == 16 and got[73] == ("A2", "B2") and got[88] == ("D2", "G2")
    # the best third comes from the last group and takes the first open slot
    assert got[74] == ("E1", "L3") and got[77] == ("I1", "K3") and got[87] == ("K1", "E3")
    winners = small_table(spark, [(1, s, a) for s, (a, _) in got.items()], "replicate int, slot int, team string")
    wiring = small_table(spark, [w[1:] for w in constants.LATER_ROUNDS_48 if w[0] == "R16"], "slot int, from_a int, from_b int")
    later = {r.slot: (r.team_a, r.team_b) for r in standings.next_round(winners, wiring, ["replicate"]).collect()}
    assert later[89] == ("E1", "I1") and len(later) == 8


def test_most_likely_score_tie(spark):
    df = small_table(spark, [(1.0, 1.0)], "lam_home double, lam_away double")
    r = goals.most_likely_score(df, 0.0).first()
    assert r.most_likely_score == "0-0"


def test_utc_does_not_depend_on_the_session_zone(spark):
    text_ = F.lit("2024-01-01T01:30:00+05:00")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert str(one(spark, dates.utc_to_naive(text_))[0]) == "2023-12-31 20:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

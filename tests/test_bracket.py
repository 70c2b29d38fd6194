"""Exact chances through a bracket against all of its courses."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from matchframe.functions.constants import KNOCKOUT_48, LATER_ROUNDS_48
from matchframe.operators import goals, standings
from matchframe.session import small_table

WIRING = [("semi", 11, 1, 2), ("semi", 12, 3, 4), ("final", 20, 11, 12)]
FIRST = {1: (0, 1), 2: (2, 3), 3: (4, 5), 4: (6, 7)}


def beat(a, b):
    return 1 / (1 + 2 ** ((b - a) / 3))


def plain():
    """Chances to win each match, added up over all 128 courses of the bracket."""
    out = {}
    for course in product((0, 1), repeat=7):
        won, p = {}, 1.0
        for (slot, sides), w in zip([*FIRST.items(), (11, (1, 2)), (12, (3, 4)), (20, (11, 12))], course, strict=True):
            a, b = sides if slot < 10 else (won[sides[0]], won[sides[1]])
            won[slot] = (a, b)[w]
            p *= beat(*((a, b) if w == 0 else (b, a)))
        for slot, team in won.items():
            out[slot, team] = out.get((slot, team), 0) + p
    return out


def found(spark, fixtures):
    beats = small_table(spark, [(a, b, beat(a, b)) for a in range(8) for b in range(8) if a != b], "team int, other int, p double")
    first = small_table(spark, fixtures, "rep string, slot int, team_a int, team_b int")
    return standings.bracket_probabilities(first, beats, WIRING, ["rep"], "first").collect()


def test_chances_are_those_of_all_courses(spark):
    got = found(spark, [(rep, s, *t) for rep in "xy" for s, t in FIRST.items()])
    for rep in "xy":
        mine = {(r.slot, r.team): r.p_win for r in got if r.rep == rep}
        want = plain()
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-12 for k in want)
    for stage, n in (("first", 4), ("semi", 2), ("final", 1)):
        assert abs(sum(r.p_win for r in got if r.stage == stage) - 2 * n) < 1e-12


def test_an_empty_side_is_a_way_through(spark):
    got = {(r.slot, r.team): (r.p_play, r.p_win) for r in found(spark, [("x", 1, 0, None), ("x", 2, 2, 3), ("x", 3, None, None)])}
    assert got[1, 0] == (1.0, 1.0) and got[11, 0][1] == pytest.approx(beat(2, 3) * beat(0, 2) + beat(3, 2) * beat(0, 3))
    assert sum(p for (slot, _), (_, p) in got.items() if slot == 20) == pytest.approx(1.0) and not any(slot == 12 for slot, _ in got)


def test_extra_time_and_a_coin(spark):
    df = small_table(spark, [(0.5, 0.3, 1.8, 1.8), (0.2, 0.5, 2.4, 0.3), (0.4, 0.0, 1.0, 2.0)], "p_home double, p_draw double, h double, a double")
    even, strong, none = goals.knockout_chance(df, "h", "a").orderBy(F.desc("p_draw")).collect()[::-1][1], *goals.knockout_chance(df, "h", "a").orderBy(F.desc("p_draw")).collect()[::2]
    assert even.p_through == pytest.approx(0.65) and none.p_through == 0.4
    from math import exp, factorial

    p, q = ([exp(-x) * x**k / factorial(k) for k in range(11)] for x in (0.8, 0.1))
    cells = {(i, j): p[i] * q[j] for i in range(11) for j in range(11)}
    total = sum(cells.values())
    wins, level = (sum(c for (i, j), c in cells.items() if f(i, j)) / total for f in (lambda i, j: i > j, lambda i, j: i == j))
    assert strong.p_through == pytest.approx(0.2 + 0.5 * (wins + level / 2))


def test_wiring_is_a_bracket():
    fed = [s for _, _, a, b in LATER_ROUNDS_48 for s in (a, b)]
    assert len(KNOCKOUT_48) == 16 and sorted(fed) == sorted({*range(73, 89), *(slot for _, slot, _, _ in LATER_ROUNDS_48)} - {104})

"""Problem 4 and other interval operators against brute force, whole and in chunks."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from auralake.operators import intervals as iv

SCHEMA = "k string, start_at long, end_at long, piece string, extra int"


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        spans = sorted((a, b) for x, a, b, *_ in rows if x == k and a is not None and b is not None and b > a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(k, "period", a, b) for a, b in merged]
        out += [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted([tuple(r) for r in iv.periods_and_gaps(df, ["k"], **kw).select("k", "piece", "start_at", "end_at").collect()], key=repr)


def test_cases(spark):
    rows = [("a", 5, 9), ("a", 1, 5), ("a", 1, 3), ("a", 1, 5), ("a", 20, 20), ("a", 30, 25), ("a", None, 4), ("a", 4, None), ("a", 12, 13), (None, 1, 2), (None, 4, 5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("hot", [3, 50, 10**6])
def test_chunks_change_nothing(spark, hot):
    rnd = random.Random(hot)
    rows = [("hot", s, s + rnd.choice([1, 3, 60])) for s in (rnd.randrange(4000) for _ in range(600))] + [(f"k{rnd.randrange(40)}", s, s + rnd.randrange(-2, 30)) for s in (rnd.randrange(200) for _ in range(400))]
    assert run(spark, rows, hot_rows=hot) == brute(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(-20, 20)), st.one_of(st.none(), st.integers(-20, 20))), max_size=25))
def test_any(spark, rows):
    assert run(spark, rows, hot_rows=2) == brute(rows)


def test_overlap_join_gives_each_pair_once(spark):
    rnd = random.Random(1)
    mk = lambda n: [(rnd.randrange(3), a, a + rnd.randrange(0, 40)) for a in (rnd.randrange(200) for _ in range(n))]
    a, b = list(set(mk(80))), list(set(mk(80)))
    got = iv.overlap_join(spark.createDataFrame(a, "k int, ls long, le long"), spark.createDataFrame(b, "k int, rs long, re long"), ["k"], 10, ("ls", "le", "rs", "re")).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, s, e, x, y) for k, s, e in a for q, x, y in b if k == q and s <= y and x <= e)


def test_hysteresis(spark):
    p = [0.1, 0.6, 0.95, 0.6, 0.1, 0.6, 0.92, 0.1, 0.1, 0.1, 0.6, 0.6]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, pos long, p double")
    got = sorted((r.span_start, r.span_end) for r in iv.hysteresis_spans(df, ["k"], "pos", "p", 0.9, 0.5, 1).collect())
    assert got == [(1, 6)]


def test_bounds_with_noise(spark):
    a = spark.createDataFrame([(1, "speech", 0.1 + 0.2, 1.0), (1, "speech", float("nan"), 1.0), (1, "speech", float("inf"), 1.0), (1, None, 0.0, 1.0), (None, "omitted", 0.0, 1.0)], "episode_id long, span_kind string, start_s double, end_s double")
    w = spark.createDataFrame([("s", "podcast:1", "2020-01-01", "2020-01-03 00:00:00"), ("s", "podcast:1", "2020-01-03", None), ("s", "podcast:1", "x", "2020-01-03")], "study string, entity string, win_start string, win_end string")
    assert sorted(tuple(r) for r in iv.coverage_periods(a, w).collect()) == [("speech", "1", "period", 300, 1000), ("window", "podcast:1", "period", 18262, 18264)]

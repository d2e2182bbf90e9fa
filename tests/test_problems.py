"""Intervals, trailing totals and deliveries: brute force, and tables with nulls, ties, copies and clashing columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators.delivery import exactly_once, first_deliveries, one_payload, redelivered
from tidelog.operators.intervals import IntervalMap, continuous_periods
from tidelog.operators.rolling import trailing_totals

T0 = datetime(2020, 1, 1)
SCHEMA = "prn int, a timestamp_ntz, b timestamp_ntz, k string, s long, slice long, kind string"


def us(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def merged(rows):
    out = set()
    for k in {r[0] for r in rows} - {None}:
        periods = []
        for s, e in sorted((us(a), us(b or a)) for p, a, b in rows if p == k and p is not None and a is not None and (b is None or b >= a)):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(k, "period", s, e) for s, e in periods} | {(k, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])}
    return out


def test_interval_map_keeps_order_and_gaps():
    m = IntervalMap()
    for a, b in [(10, 12), (1, 2), (5, 6), (2, 5)]:
        m.insert(a, b)
    assert (m.starts, m.ends, m.gaps()) == ([1, 10], [6, 12], [(6, 10)])
    m.insert(6, 10)
    assert (m.starts, m.ends, m.gaps()) == ([1], [12], [])


@pytest.mark.parametrize("seed", range(4))
def test_periods_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(300):
        k = rnd.choice([1, 1, 1, 2, 3, None])
        a = None if rnd.random() < 0.05 else T0 + timedelta(hours=rnd.randrange(2000))
        b = None if a is None or rnd.random() < 0.1 else a + timedelta(hours=rnd.choice([-3, 0, 1, 2, 5, 30, 300]) if rnd.random() < 0.3 else rnd.randrange(3))
        rows += [(k, a, b)] * rnd.choice([1, 1, 2])
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    for slice_us in (3_600_000_000 * 24, 3_600_000_000 * 7):
        got = continuous_periods(df, "prn", "a", "b", slice_us)
        assert {(r.prn, r.kind, r.start_us, r.stop_us) for r in got.collect()} == merged(rows)
        assert got.count() == len(merged(rows))


def test_periods_of_empty_and_hopeless_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert continuous_periods(df, "prn", "a", "b").count() == 0
    df = spark.createDataFrame([(None, T0, T0, None, None, None, None), (1, None, T0, None, None, None, None), (1, T0, T0 - timedelta(1), None, None, None, None)], SCHEMA)
    assert continuous_periods(df, "prn", "a", "b").count() == 0


def test_periods_of_string_entities_share_an_instant(spark):
    df = spark.createDataFrame([("é", T0, T0 + timedelta(1)), ("é", T0 + timedelta(1), T0 + timedelta(2)), ("", T0, None)], "e string, a timestamp_ntz, b timestamp_ntz")
    assert {(r.e, r.start_us, r.stop_us) for r in continuous_periods(df, "e", "a", "b").collect()} == {("é", us(T0), us(T0 + timedelta(2))), ("", us(T0), us(T0))}


@pytest.mark.parametrize("silence,periods", [(21, (7, 30)), (40, (3, 10))])
def test_trailing_totals_equal_brute_force(spark, silence, periods):
    rnd = random.Random(5)
    rows, daily = [], {}
    for k in (1, 2, 3):
        d = 0
        for _ in range(40):
            d += rnd.choice([1, 1, 1, 2, 5, 20, 21, 22, 45])
            n = rnd.choice([None, 0, 3, 10])
            daily[k, d] = n or 0
            rows += [(k, T0 + timedelta(days=d, hours=rnd.randrange(24)), n, "x", "y")] * rnd.choice([1, 2])
    rows += [(None, T0, 5, "x", "y"), (1, None, 5, "x", "y")]
    df = spark.createDataFrame(rows, "prn int, t timestamp_ntz, n int, day string, k string")
    got = {(r.prn, (datetime.combine(r.day, datetime.min.time()) - T0).days): tuple(r[f"total_n_{p}"] for p in periods) for r in trailing_totals(df, "prn", "t", ["n"], periods, silence).collect()}
    want = {}
    for k in (1, 2, 3):
        days = sorted(d for e, d in daily if e == k)
        on = set(days) | {x for a, b in zip(days, days[1:]) if b - a <= silence for x in range(a, b)}
        want |= {(k, d): tuple(sum(daily.get((k, x), 0) for x in range(d - p + 1, d + 1)) for p in periods) for d in on}
    assert got == want


def test_trailing_totals_of_sums_and_empty(spark):
    df = spark.createDataFrame([(1, T0, 2), (1, T0, 3)], "prn int, t timestamp_ntz, n int")
    r = trailing_totals(df, "prn", "t", ["n"], (7,), how="sum").collect()
    assert [(x.total_n_7, round(x.mean_n_7, 6)) for x in r] == [(5, round(5 / 7, 6))]
    assert trailing_totals(df.where("false"), "prn", "t", ["n"]).count() == 0


MESSAGES = "i long, t timestamp_ntz, prn int, h string, note string, _id string, copies string, _k0 int"


def test_exactly_one_copy(spark):
    rows = [(4, T0, 1, "AB", "late"), (2, T0, 1, "ab", "first"), (9, T0, 1, "Ab", "again"), (5, T0, 2, "ab", "other"), (6, T0, None, "ab", "null"), (7, T0, None, "ab", "null too"), (8, None, 1, None, "")]
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], MESSAGES)
    key = {"t": "t", "prn": "prn", "h": F.lower("h")}
    assert sorted(r.i for r in redelivered(df, key, "i").collect()) == [4, 9]
    kept = exactly_once(df, key, "i")
    assert set(kept.columns) == set(df.columns) and sorted(r.i for r in kept.collect()) == [2, 5, 6, 7, 8]
    assert sorted((r.i, r.copies) for r in first_deliveries(df, key, "i").collect()) == [(2, 3), (5, 1)]
    assert sorted(r.note for r in one_payload(df, key, "i", ["note"]).collect()) == ["first", "other"]
    assert redelivered(df.where("false"), key, "i").count() == 0


def test_delivery_time_decides_before_the_id(spark):
    df = spark.createDataFrame([(1, T0 + timedelta(1), "x"), (2, T0, "x"), (3, T0, "x")], "i long, arrived timestamp_ntz, h string")
    assert sorted(r.i for r in redelivered(df, {"h": "h"}, "i", order=["arrived"]).collect()) == [1, 3]


def test_delivery_plan_is_a_hash_aggregation(spark):
    from tidelog.plans.problems import identifier, table

    plan = redelivered(table(spark, "/root/testdata/sf0.001", "special_messages"), identifier(), "obs_id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan

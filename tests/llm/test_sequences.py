"""Runs and shared spans against brute force, and on tables with nulls, ties, copies and clashing columns."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidelog.llm.runs import ConsensusCost, Segmentation, collapse_runs, differing, neighbour_costs, segment
from tidelog.llm.spans import shared_spans

T0 = datetime(2020, 1, 1)


def us(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def least_cost(costs, penalty):
    """The least total over all segmentations of a sequence of len(costs) events; costs[0] is before the first."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(costs) - 1):
        total = penalty + sum(penalty if c else x for c, x in zip(cuts, costs[1:]))
        best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_segmentation_is_optimal(seed):
    rnd = random.Random(seed)
    costs = [np.inf] + [rnd.choice([0, 1, 2, 3, 7, np.inf]) for _ in range(rnd.randrange(10))]
    begins, total = segment(costs, 2.5)
    assert total == least_cost(costs, 2.5)
    assert begins[0] and [bool(b) for b in begins[1:]] == [c > 2.5 for c in costs[1:]]


def consensus(payloads):
    """Bytes in which the payloads differ from the most frequent byte of their position; a missing one is a symbol."""
    width = max(map(len, payloads))
    columns = [[p[i] if i < len(p) else -1 for p in payloads] for i in range(width)]
    return sum(len(c) - max(c.count(x) for x in c) for c in columns)


def best_of_all(payloads, penalty):
    """The least total of all segmentations under the consensus cost."""
    least = np.inf
    for cuts in itertools.product([0, 1], repeat=len(payloads) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(payloads)]
        least = min(least, sum(penalty + consensus(payloads[a:b]) for a, b in zip(at, at[1:])))
    return least


def total_of(begins, payloads, penalty):
    at = [*np.flatnonzero(begins).tolist(), len(payloads)]
    return sum(penalty + consensus(payloads[a:b]) for a, b in zip(at, at[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_consensus_segmentation_is_optimal(seed):
    rnd = random.Random(seed)
    payloads = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([3, 3, 3, 2]))) for _ in range(rnd.randrange(1, 12))]
    begins, total = segment(payloads, 2.5, ConsensusCost)
    assert total == best_of_all(payloads, 2.5) == total_of(begins, payloads, 2.5) and begins[0]


def test_the_optimum_isnt_a_threshold_between_neighbours():
    drift = [bytes([66] * i + [65] * (12 - i)) for i in range(13)]  # neighbours differ in one byte, the ends in all
    assert segment([differing(a, b) for a, b in zip([None, *drift], drift)], 2.5)[0].sum() == 1
    begins, total = segment(drift, 2.5, ConsensusCost)
    assert begins.sum() > 1 and total == best_of_all(drift, 2.5)
    spike = [b"a" * 12] * 5 + [b"b" * 3 + b"a" * 9] + [b"a" * 12] * 5  # dearer than the penalty, but two cuts cost more
    assert np.flatnonzero(segment([differing(a, b) for a, b in zip([None, *spike], spike)], 2.5)[0]).tolist() == [0, 5, 6]
    assert np.flatnonzero(segment(spike, 2.5, ConsensusCost)[0]).tolist() == [0]


def test_neighbour_costs_keep_a_pruned_list_of_candidates():
    """Those with best(s) + inside(s, t) < best(t), by a programme that prunes nothing; of equal sums the first."""
    rnd = random.Random(2)
    lists = []
    for _ in range(100):
        p, steps, best = Segmentation(2.5), [], [0.0]
        for t in range(40):
            steps.append(np.inf if not t else rnd.choice([0, 0, 1, 1, 2, 3, 4, 7]))
            p.feed(steps[-1])
            sums = [best[s] + sum(steps[s + 1 :]) for s in range(t + 1)]
            best.append(min(sums) + 2.5)
            open_ = [s for s in range(t + 1) if sums[s] < best[-1]]
            assert p.value == best[-1] and [b.at for b in p.alive] == [s for s in open_ if sums[s] not in [sums[i] for i in open_ if i < s]]
            lists.append(len(p.alive))
    assert 2 <= max(lists) <= 5


def test_seams_of_slices_with_equal_times(spark):
    """Two runs of a day begin at once; the second goes on over midnight, and over a day of one run."""
    a, b = b"a" * 22, b"b" * 22
    late = T0 + timedelta(hours=23)
    rows = [(k, late, a) for k in range(40)] + [(k, late, b) for k in range(40)] + [(k, late + timedelta(hours=h), b) for k in range(40) for h in range(2, 30, 4)]
    df = spark.createDataFrame(rows, "prn int, t timestamp_ntz, raw binary").repartition(5)
    got = collapse_runs(df, "prn", "t", "raw").collect()
    assert sorted((r.prn, r.start_us, r.stop_us, r.events, bytes(r.payload)) for r in got) == sorted([(k, us(late), us(late), 1, a) for k in range(40)] + [(k, us(late), us(late + timedelta(hours=26)), 8, b) for k in range(40)])


def test_a_long_run_holds_few_boundaries():
    rnd = random.Random(1)
    base = bytes(rnd.randrange(256) for _ in range(22))
    held, runs, p = 0, 0, Segmentation(2.5, ConsensusCost)
    for i in range(3000):
        event = bytearray(base)
        if rnd.random() < 0.1:
            event[rnd.randrange(22)] = 0
        runs += len(p.feed(bytes(event) if i % 1000 < 900 else bytes(22)))
        held = max(held, len(p.alive))
    assert held < 400 and runs >= 4


def test_costs_of_any_lengths():
    assert differing(b"abc", b"abd") == 1 and differing(b"", b"ab") == 2 and differing(None, None) == np.inf
    assert neighbour_costs([]).tolist() == [] and neighbour_costs([b"ab", b"ab", b"b"]).tolist()[1:] == [0, 2]
    long = b"x" * 10_000
    assert neighbour_costs([long, long, long + b"yz"]).tolist()[1:] == [0, 2]


def runs_by_loop(rows, most=2, gap=6 * 3600):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        last = None
        for t, p in sorted(((r[1], r[2]) for r in rows if r[0] == k and r[1] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or b"")):
            if last and (t - last[0]).total_seconds() <= gap and differing(last[1], p) <= most:
                out[-1][2], out[-1][3] = us(t), out[-1][3] + 1
            else:
                out.append([k, us(t), us(t), 1])
            last = (t, p)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_a_loop(spark, seed):
    rnd = random.Random(seed)
    base = [bytes(rnd.randrange(65, 70) for _ in range(22)) for _ in range(3)]
    rows, t = [], T0
    for _ in range(600):
        t += timedelta(minutes=rnd.choice([0, 5, 30, 90, 359, 360, 361, 2000]) if rnd.random() < 0.5 else 10)
        p = bytearray(rnd.choice(base) if rnd.random() < 0.3 else base[0])
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            p[rnd.randrange(22)] = 90
        rows.append((rnd.choice([1, 1, 1, 2, None]), None if rnd.random() < 0.02 else t, None if rnd.random() < 0.03 else bytes(p[: rnd.choice([22, 22, 22, 20, 0])])))
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "x", 1, b"z") for r in rows], "prn int, t timestamp_ntz, raw binary, k string, slice int, payload binary").repartition(3)
    for slice_us in (86_400_000_000, 7_200_000_000):
        got = collapse_runs(df, "prn", "t", "raw", slice_us=slice_us)
        assert sorted((r.prn, r.start_us, r.stop_us, r.events) for r in got.collect()) == runs_by_loop(rows)


def test_runs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "prn string, t timestamp_ntz, raw binary")
    assert collapse_runs(df, "prn", "t", "raw").count() == 0
    assert collapse_runs(df, "prn", "t", "raw", cost=ConsensusCost).count() == 0


def test_consensus_runs_of_a_table(spark):
    """Every slice is segmented at the least cost; silences, missing payloads and slices end runs."""
    rnd = random.Random(4)
    rows, parts = [], {}
    for k in (1, 2):
        t = T0
        for _ in range(60):
            t += timedelta(hours=rnd.choice([1, 1, 1, 1, 2, 7]))
            p = None if rnd.random() < 0.05 else bytes(rnd.choice(b"ab") for _ in range(4))
            rows.append((k, t, p))
    for k, t, p in rows:
        parts.setdefault((k, (t - T0).days), []).append((t, p))
    want = 0.0
    for events in parts.values():
        piece, last = [], None
        for t, p in events:
            if piece and (p is None or t - last > timedelta(hours=6)):
                want, piece = want + best_of_all(piece, 2.5), []
            if p is None:
                want += 2.5
            else:
                piece.append(p)
            last = t
        want += best_of_all(piece, 2.5) if piece else 0
    df = spark.createDataFrame([(*r, "x") for r in rows], "prn int, t timestamp_ntz, raw binary, first string").repartition(3)
    got = collapse_runs(df, "prn", "t", "raw", cost=ConsensusCost).collect()
    total = 0.0
    for r in got:
        inside = [p for k, t, p in rows if k == r.prn and r.start_us <= us(t) <= r.stop_us]
        assert len(inside) == r.events
        total += 2.5 + (consensus(inside) if inside != [None] else 0)
    assert total == want and sum(r.events for r in got) == len(rows)


def spans_by_loop(records, least):
    out = {}
    for i, (name, c) in enumerate(records):
        others = [d for j, (_, d) in enumerate(records) if j != i and d is not None]
        hit = [p for p in range(len(c) - least + 1) if any(c[p : p + least] in d for d in others)] if c is not None else []
        covered = {p + x for p in hit for x in range(least)}
        if covered:
            out[i] = (name, min(covered) + 1, max(covered) + 1, len(covered))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("seed,least,start", [(0, 4, None), (1, 8, 2), (2, 4, 4), (3, 12, None)])
def test_spans_equal_a_loop(spark, seed, least, start):
    rnd = random.Random(seed)
    parts = [bytes(rnd.randrange(65, 69) for _ in range(rnd.choice([3, 9, 15, 40]))) for _ in range(8)]
    records = [(n, b"".join(rnd.choice(parts) if rnd.random() < 0.4 else bytes(rnd.randrange(70, 255) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(6)))) for n in range(25)]
    records += [(None, records[3][1]), (4, None), (5, b""), (6, "grün".encode() * 3), (6, "grün".encode() * 3)]
    df = spark.createDataFrame([(n, c, 1, "w") for n, c in records], "n int, c binary, pos int, w string").repartition(3)
    got = shared_spans(df, "n", "c", least, start)
    assert sorted(((r.n, r.first_byte, r.last_byte, r.shared_bytes) for r in got.collect()), key=str) == spans_by_loop(records, least)


def test_long_equal_records_reach_high_levels(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    df = spark.createDataFrame([("a", text), ("b", text + "!"), ("c", "short")], "n string, c string")
    got = {r.n: (r.first_byte, r.last_byte, r.shared_bytes, r.longest_level) for r in shared_spans(df, "n", "c", 16).collect()}
    assert got == {"a": (1, 20_000, 20_000, 16_384), "b": (1, 20_000, 20_000, 16_384)}


def test_spans_of_empty_tables_and_wrong_lengths(spark):
    df = spark.createDataFrame([], "n string, c string")
    assert shared_spans(df, "n", "c").count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, "n", "c", 12, 5)

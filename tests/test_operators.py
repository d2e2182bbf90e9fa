"""Sequences, change points, compression models, band joins, sources and streams on small inputs."""

import itertools
import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import audit as A, changepoint as C, information as I, metrics as M, nearby as N, sentinels as S, temporal as T
from tidelog.operators.neighbours import with_neighbour

T0 = datetime(2020, 1, 1)
H = timedelta(hours=1)


def test_neighbours_equal_lead_and_lag(spark):
    rnd = random.Random(1)
    times = rnd.sample(range(3000), 120)
    rows = [(rnd.choice(["a", "a", "b"]), T0 + H * t, f"p{i}") for i, t in enumerate(times)] + [(None, T0, "n")]
    df = spark.createDataFrame(rows, "e string, t timestamp_ntz, p string").repartition(3)
    got = {r.p: (r.nxt, r.before) for r in with_neighbour(with_neighbour(df, "e", ["t"], {"nxt": "p"}), "e", ["t"], {"before": "p"}, forward=False).collect()}
    assert len(got) == 121
    for e in "ab":
        line = [p for k, t, p in sorted((r for r in rows if r[0] == e), key=lambda r: r[1])]
        assert [got[p] for p in line] == [(b, a) for a, b in zip([None, *line], [*line[1:], None])]


def observations(spark, letters, entity=5, step=100):
    rows = [(entity, T0 + timedelta(seconds=step * (i + 1)), c, c, 1.0) for i, c in enumerate(letters)]
    return spark.createDataFrame(rows, "prn int, datetime timestamp_ntz, message_hash string, ascii_message string, entropy double")


def test_steps_and_changes(spark):
    steps = T.observation_steps(observations(spark, "AABBC"))
    assert steps.where("to_hash is not null").count() == 4
    got = [(r.from_hash, r.to_hash, r.held_hours and round(r.held_hours * 3600)) for r in T.message_changes(steps).orderBy("transition_time").collect()]
    assert got == [("A", "B", 200), ("B", "C", None)]


def test_moving_average_shifts(spark):
    weeks = [(1, T0 + timedelta(weeks=i), 10.0 if i < 12 else 30.0 if i < 30 else 10.0) for i in range(45)] + [(2, T0 + timedelta(weeks=i), float(i)) for i in range(9)]
    df = spark.createDataFrame(weeks, "prn int, week timestamp_ntz, v double")
    got = [(r.week - T0).days // 7 for r in T.moving_average_shifts(df, "prn", "week", "v").orderBy("week").collect()]
    values = [v for k, _, v in weeks if k == 1]
    hits = [i for i in range(4, 45 - 4) if abs(sum(values[i : i + 4]) - sum(values[i - 4 : i])) / sum(values[i - 4 : i]) > 0.5]
    kept = []
    for i in hits:
        if not kept or i - kept[-1] > 8:
            kept.append(i)
    assert got == kept and len(kept) == 2


def test_periodicity_classes(spark):
    rows = [(1, T0 + H * 12 * i) for i in range(30)] + [(2, T0 + H * 5 * i) for i in range(10)]
    df = spark.createDataFrame([(k, t, "x", "x", 1.0) for k, t in rows], "prn int, datetime timestamp_ntz, message_hash string, ascii_message string, entropy double")
    got = {r.prn: (r.dominant_hours, r.pattern) for r in T.periodicity(T.observation_steps(df)).collect()}
    assert got == {1: (12.0, "orbital"), 2: (0.0, "irregular")}


SERIES = [
    ([0] * 50 + [5] * 50, {}, lambda f: len(f) >= 1 and min(f) >= 50),
    ([0] * 100 + [10] * 100, {}, lambda f: 100 <= f[0] <= 102),
    ([1] * 100, {}, lambda f: f == []),
    ([1, 2, 9, 9, 9, 9, 9], {}, lambda f: f == []),
    ([0] * 50 + [10] * 250, {"fraction": 0.1}, lambda f: len(f) == 1 and 48 <= f[0] <= 52),
    ([0] * 100 + [10] * 100 + [-5] * 100, {"fraction": 0.1}, lambda f: len(f) == 2 and 98 <= f[0] <= 102 and 198 <= f[1] <= 202),
]


@pytest.mark.parametrize("values,options,ok", SERIES)
def test_cusum(values, options, ok):
    assert ok(C.cusum(np.array(values, float), **options))


def test_shifts_pass_over_missing_values(spark):
    vals = [None if i % 5 == 0 else 0.0 if i < 50 else 8.0 for i in range(100)]
    df = spark.createDataFrame([("w", 1, "m", T0 + timedelta(i), v) for i, v in enumerate(vals)] + [("w", 2, "m", T0, float("nan"))], "g string, prn int, metric string, t timestamp_ntz, v double").repartition(4)
    found = C.detect_shifts(df, ["g", "prn", "metric"], "t", "v").collect()
    assert [(r.prn, (r.t - T0).days, r.direction) for r in found] == [(1, 51, "increase")]


def metrics_rows(spark, jump):
    rows = []
    for k in range(1, 10):
        for w in range(60):
            rows.append((T0 + timedelta(weeks=w), "weekly", k, 100, None, None, 1.0, 0.0 if w < jump + k % 2 * 0 else 0.9, 0.0, None, None))
    rows += [(T0 + timedelta(weeks=w), "weekly", 0, 900, None, None, 1.0, 0.0, 0.0, 9, None) for w in range(60)]
    return spark.createDataFrame(rows, "period_start timestamp_ntz, granularity string, prn int, observation_count long, transition_count long, unique_message_count long, mean_entropy double, sentinel_fraction double, text_fraction double, active_prn_count long, mean_duration_hours double")


def test_coordinated_change_points_and_effects(spark):
    m = metrics_rows(spark, 40)
    points = C.change_points(m).cache()
    rows = points.collect()
    assert len(rows) == 9 and all(r.is_coordinated and r.coordinated_prn_count == 9 and r.metric == "sentinel_fraction" and r.direction == "increase" for r in rows)
    assert not any(r.is_coordinated for r in C.change_points(m, coordinated=10).collect())
    assert all(r.effect_size == 0.0 for r in C.effect_sizes(points, m).collect())  # nothing varies on either side


def test_effect_size(spark):
    m = metrics_rows(spark, 40).withColumn("sentinel_fraction", F.col("sentinel_fraction") + F.pmod(F.weekofyear("period_start"), F.lit(2)) * 0.01)
    points = spark.createDataFrame([(T0 + timedelta(weeks=40), "weekly", 1, "sentinel_fraction"), (T0, "weekly", 1, "sentinel_fraction")], "detected_at timestamp_ntz, granularity string, prn int, metric string")
    got = {r.detected_at: r.effect_size for r in C.effect_sizes(points, m).collect()}
    assert got[T0] == 0.0 and got[T0 + timedelta(weeks=40)] > 50


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert sorted(r.v for r in C.nearest_rank_threshold(df, "v", 0.75).collect()) == [8.0, 9.0, 10.0]


def test_metrics_of_fillers_and_texts(spark):
    rows = [(5, T0, "h1", " " * 22, 0.0), (5, T0 + timedelta(1), "h2", "HELLO", 2.0), (1, T0 + timedelta(2), "h3", "TEXT ABC", None), (5, T0 + timedelta(22), "h2", "HELLO", 2.0), (1, T0 + timedelta(9), "h3", "TEXT ABC", None)]
    log = spark.createDataFrame(rows, "prn int, datetime timestamp_ntz, message_hash string, ascii_message string, entropy double")
    m = {(r.granularity, r.prn, (r.period_start - T0).days): r for r in M.behavioral_metrics(log).collect()}
    assert m["daily", 5, 0].sentinel_fraction == 1.0 and m["daily", 1, 2].text_fraction == 1.0 and m["daily", 1, 2].mean_entropy == 0.0
    assert m["weekly", 5, 5].observation_count == 0 and m["weekly", 5, 5].mean_entropy is None and m["weekly", 0, -2].active_prn_count == 2
    assert M.behavioral_metrics(log.where("false")).count() == 0


def test_filler_events(spark):
    e = {(r.event_type, (r.event_date - T0).seconds // 100) for r in S.sentinel_events(observations(spark, "  AA B ").withColumn("entropy", F.when(F.col("ascii_message") == " ", 0.0).otherwise(1.0))).collect()}
    assert e == {("enter", 1), ("exit", 2), ("enter", 5), ("exit", 5), ("enter", 7)}


def test_conflicts_and_keyed_tables(spark):
    rows = [(1, T0, 5, "a", "f1"), (2, T0, 5, "b", "f2"), (3, T0, 5, "c", "f3"), (4, T0, 6, "a", "f1")]
    log = spark.createDataFrame(rows, "obs_id long, datetime timestamp_ntz, prn int, message_hash string, source_file string")
    assert sorted((r.existing_hash, r.new_hash, r.new_source) for r in A.conflicting_deliveries(log).collect()) == [("a", "b", "f2"), ("a", "c", "f3")]
    twice = log.union(log.withColumn("obs_id", F.col("obs_id") + 10).where("prn = 5"))
    d = {r.message_hash: (r.occurrence_count, r.source_files) for r in A.identical_deliveries(twice, {"datetime": "datetime", "prn": "prn", "message_hash": "message_hash"}, "obs_id", "source_file").collect()}
    assert d == {h: (2, [f]) for h, f in (("a", "f1"), ("b", "f2"), ("c", "f3"))}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, A.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, A.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert A.upsert(A.upsert(old, new, ["k"]), new, ["k"]).count() == 3


def test_identical_deliveries_list_every_source(spark):
    df = spark.range(1500).select(F.col("id").alias("obs_id"), F.lit("m").alias("h"), F.format_string("f%d", 1499 - F.col("id")).alias("source_file"))
    r = A.identical_deliveries(df, {"h": "h"}, "obs_id", "source_file").first()
    assert (r.occurrence_count, r.distinct_sources, r.source_files) == (1500, 1500, [f"f{1499 - i}" for i in range(1500)])


def test_band_nearest_and_following(spark):
    rnd = random.Random(8)
    left = [(i, rnd.choice("xy"), T0 + timedelta(minutes=rnd.randrange(20_000))) for i in range(120)] + [(900, "x", None)]
    right = [(100 + i, rnd.choice("xy"), T0 + timedelta(minutes=rnd.randrange(20_000))) for i in range(60)] + [(901, "x", None)]
    a, b = spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "j int, k string, u timestamp_ntz")
    back, ahead = 3_600_000_000 * 5, 3_600_000_000 * 2
    ok = lambda t, u: t is not None and u is not None and t - 5 * H <= u <= t + 2 * H
    want = {(i, j) for i, k, t in left for j, m, u in right if k == m and ok(t, u)}
    assert {(r.i, r.j) for r in N.band_join(a, b, "t", "u", back, ahead, ["k"]).collect()} == want
    assert {r.i for r in N.band_join(a, b, "t", "u", back, ahead, ["k"], how="left_anti").collect()} == {x[0] for x in left} - {i for i, _ in want}
    assert sorted(r.i for r in N.band_join(a, b, "t", "u", back, ahead, ["k"], how="left_semi").collect()) == sorted({i for i, _ in want})
    near = {r.i: r.j for r in N.nearest(a, b, "i", "t", "u", back, ["k"], ["j"]).collect()}
    for i, k, t in left:
        best = sorted((abs((u - t).total_seconds()), (u - t).total_seconds(), j) for j, m, u in right if k == m and t and u and abs(u - t) <= 5 * H)
        assert near.get(i) == (best[0][2] if best else None)
    after = {r.i: r.u for r in N.first_after(a, b.select("k", "u"), ["k"], "t", "u").collect()}
    for i, k, t in left:
        assert t is None or after[i] == min((u for _, m, u in right if m == k and u and u > t), default=None)


def test_permutations_keep_the_data_and_the_size(spark):
    a = spark.createDataFrame([(i, T0 + timedelta(days=10 * i)) for i in range(20)], "i int, t timestamp_ntz")
    b = spark.createDataFrame([(i, T0 + timedelta(days=10 * i, hours=1)) for i in range(0, 20, 2)], "j int, u timestamp_ntz")
    rows = {r.rep: r.matched for r in N.permutation_null(a, b, ["i"], "t", "u", 86_400_000_000, 8).collect()}
    assert sorted(rows) == list(range(9)) and rows[0] == 10 and all(v == 10 for v in rows.values())


@pytest.mark.parametrize("everyone", [None, 0])
def test_matches_by_repetition_equal_pairs(spark, everyone):
    rnd = random.Random(9)
    when = lambda: T0 + timedelta(hours=rnd.randrange(9000) // 12 * 12)
    left = list({(rnd.choice([0, 1, 2, 3]), rnd.choice("xy"), when()) for _ in range(150)})
    right = [(i, rnd.choice([1, 2, 2, 4, None] if i % 7 else [None]), when() if i % 9 else None) for i in range(40)]
    a = spark.createDataFrame(left, "e int, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "j int, f int, u timestamp_ntz").repartition(3)
    reps = N.shuffled_times(b, "u", 6, shard_rows=7)
    dealt = {}
    for r in reps.collect():
        dealt.setdefault(r.rep, []).append((r.j, r.f, r.u))
    order = lambda times: sorted(map(str, times))
    assert sorted(dealt) == list(range(7)) and sorted(dealt[0], key=str) == sorted(right, key=str)
    assert all(sorted(j for j, _, _ in v) == list(range(40)) and order(u for *_, u in v) == order(u for *_, u in right) for v in dealt.values())
    assert len({str(sorted(v, key=str)) for v in dealt.values()}) == 7
    for days in (0, 1, 4):
        near = lambda e, t, f, u: u is not None and abs(u - t) <= timedelta(days=days) and (f is None or f == e or e == everyone)
        want = {n: sum(any(near(e, t, f, u) for _, f, u in v) for e, _, t in left) for n, v in dealt.items()}
        got = N.matched_by_rep(a, reps, ["e", "k", "t"], "t", "u", days * 86_400_000_000, 6, "e", "f", everyone)
        assert {r.rep: r.matched for r in got.collect()} == want
    assert N.permutation_test(got, len(left)).first().asDict() == {
        "matched": want[0], "total": len(left), "observed_rate": want[0] / len(left), "repeats": 6,
        "null_rate": pytest.approx(sum(want[n] for n in range(1, 7)) / 6 / len(left)), "p_value": sum(want[n] >= want[0] for n in range(1, 7)) / 6,
    }


def test_advisory_permutations_are_two_tests_of_a_thousand_shuffles(spark):
    from tidelog.plans.behaviour import R

    sf = "/root/testdata/sf0.001"
    rows = {r.test: r for r in R.queries["advisory_permutations"](spark, sf).collect()}
    life = R.queries["lifecycle_match_rate"](spark, sf).first()
    assert sorted(rows) == ["change_points", "filler_events"] and all(r.repeats == 1000 and 0 <= r.p_value <= 1 for r in rows.values() if r.total)
    assert (rows["filler_events"].matched, rows["filler_events"].total) == (life.matched, life.total)


def naive_bits(corpus, own, order, vocabulary=256):
    counts = {}
    for m in corpus:
        for p in range(len(m)):
            for o in range(min(order, p) + 1):
                node = counts.setdefault((o, m[p - o : p]), {})
                node[m[p]] = node.get(m[p], 0) + 1
    for p in range(len(own)):
        for o in range(min(order, p) + 1):
            counts[o, own[p - o : p]][own[p]] -= 1
    total = 0.0
    for p in range(len(own)):
        prob, out = 1.0, set()
        for o in range(min(order, p), -1, -1):
            left = {s: c for s, c in counts.get((o, own[p - o : p]), {}).items() if c > 0 and s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if own[p] in left:
                prob *= left[own[p]] / whole
                break
            prob *= len(left) / whole
            out |= set(left)
        else:
            prob /= vocabulary - len(out)
        total -= math.log2(prob)
    return total


def test_leave_one_out_equals_a_walk(spark):
    rnd = random.Random(2)
    corpus = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(9))) for _ in range(25)] + [b"", b"zz", b"abcabcabc", b"abcabcabc"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(corpus)], "i int, m binary").repartition(3)
    want = [naive_bits(corpus, m, 4) for m in corpus]
    for bucket_rows in (1_000_000, 40, 5, 1):  # one bucket, some, and cuts nearly everywhere
        got = {r.i: r.bits for r in I.leave_one_out_bits(df, "i", "m", 4, bucket_rows=bucket_rows).collect()}
        assert len(got) == len(corpus)
        assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want)), bucket_rows


def test_leave_one_out_of_long_and_uniform_payloads(spark):
    """A context in most rows is a cut and no bucket; payloads may be null, longer than any context and equal."""
    rnd = random.Random(3)
    corpus = [b" " * 60] * 4 + [b"\x00" * 30, bytes([255] * 9) + bytes(9)] + [bytes(rnd.choice(b"\x00\xffa") for _ in range(rnd.randrange(40))) for _ in range(12)]
    df = spark.createDataFrame([(i, m, "x") for i, m in enumerate(corpus)] + [(100, None, "x")], "i int, m binary, u string").repartition(3)
    for bucket_rows in (1_000_000, 50, 7):
        got = {r.i: r.bits for r in I.leave_one_out_bits(df, "i", "m", bucket_rows=bucket_rows).collect()}
        assert got.pop(100) == 0.0 and all(abs(got[i] - naive_bits(corpus, m, 8)) < 1e-9 for i, m in enumerate(corpus))
    assert I.leave_one_out_bits(df.where("false"), "i", "m").count() == 0


def test_models_are_scored_apart(spark):
    rnd = random.Random(4)
    corpora = {g: [bytes(rnd.choice(b"abcd") for _ in range(10)) for _ in range(9)] for g in (1, 2)}
    df = spark.createDataFrame([(g, i, m) for g, ms in corpora.items() for i, m in enumerate(ms)], "g int, i int, m binary").repartition(3)
    for bucket_rows in (1000, 10):
        got = {(r.g, r.i): r.bits for r in I.leave_one_out_bits(df, "i", "m", 3, model="g", bucket_rows=bucket_rows).collect()}
        assert len(got) == 18 and all(abs(got[g, i] - naive_bits(ms, m, 3)) < 1e-9 for g, ms in corpora.items() for i, m in enumerate(ms))


def test_probabilities_sum_to_one():
    walk = [([1, 2], [3, 1], [], []), ([1, 2, 3], [1, 2, 3], [3], [1])]
    assert abs(sum(2 ** -I.walk_bits(s, walk) for s in range(256)) - 1) < 1e-12


def maximal_by_loop(messages, least):
    spans = {}
    for i, m in enumerate(messages):
        for a, b in itertools.combinations(range(len(m) + 1), 2):
            if b - a >= least:
                spans.setdefault(m[a:b], []).append((i, a))
    shared = {s: o for s, o in spans.items() if len({i for i, _ in o}) > 1}
    out, covered = {}, {}
    for s in sorted(shared, key=lambda s: -len(s)):
        if not all(any(x <= a and a + len(s) <= y and y - x > len(s) for x, y in covered.get(i, ())) for i, a in shared[s]):
            out[s] = (len({i for i, _ in shared[s]}), len(shared[s]))
            for i, a in shared[s]:
                covered.setdefault(i, []).append((a, a + len(s)))
    return out


def test_repeated_substrings_equal_a_loop(spark):
    rnd = random.Random(6)
    messages = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(14))) for _ in range(12)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m binary")
    got = {bytes(r.substring): (r.messages, r.occurrences) for r in I.repeated_substrings(df, "i", "m", 3).collect()}
    assert got == maximal_by_loop(messages, 3)
    assert I.repeated_substrings(df.where("false"), "i", "m", 3).count() == 0


def test_repeated_substrings_have_no_greatest_length(spark):
    rnd = random.Random(7)
    common = rnd.randbytes(150)
    messages = [b"ab" + common + b"c", common[:90] + b"xyz", b"q" + common, rnd.randbytes(200)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m binary")
    got = {bytes(r.substring): (r.messages, r.occurrences) for r in I.repeated_substrings(df, "i", "m").collect()}
    assert got == {common: (2, 2), common[:90]: (3, 3)} == maximal_by_loop(messages, 6)


def test_shared_substrings_begin_at_six_bytes(spark):
    from tidelog.plans.payloads import R, distinct_payloads

    sf = "/root/testdata/sf0.001"
    messages = [bytes(r.raw_bytes) for r in distinct_payloads(spark, sf).collect()]
    got = {bytes.fromhex(r.substring): (r.messages, r.occurrences) for r in R.queries["shared_substrings"](spark, sf).collect()}
    assert got == maximal_by_loop(messages, 6) and min(map(len, got)) < 10


def test_uniformity_counts_symbols_that_never_occur(spark):
    from tidelog.plans.payloads import ALPHABET, uniformity

    df = spark.createDataFrame([(b"AAB",), (b"B\x00",)], "d binary")
    got = I.alphabet_histogram(df, "d", [65, 66, 67, 68])
    assert sorted(map(tuple, got.collect())) == [(65, 2), (66, 2), (67, 0), (68, 0)]
    assert tuple(uniformity(got).first())[:2] == (4.0, 3)
    assert len(set(ALPHABET)) == 45 and {65, 32, 57, 0xF8} <= set(ALPHABET)


def test_random_payloads_repeat_by_seed(spark):
    draw = lambda: sorted((r.corpus, r.n, bytes(r.data)) for r in I.random_payloads(spark, 3, 5, 22, [1, 2, 200]).collect())
    rows = draw()
    assert rows == draw() and len(rows) == 15 and {b for _, _, d in rows for b in d} <= {1, 2, 200}


@pytest.mark.parametrize("letters, per_corpus, length, order", [([65], 5, 4, 8), ([0, 7], 40, 9, 8), ([0, 1, 2, 255], 60, 22, 3), (list(range(20, 67)), 70, 22, 8), (list(range(256)), 50, 22, 8), ([3, 4], 6, 3, 0), ([3, 4], 1, 5, 8)])
@pytest.mark.parametrize("bounds", [{}, {"pass_rows": 100, "share": 9}])
def test_random_bits_equal_leave_one_out_bits(spark, letters, per_corpus, length, order, bounds):
    """In one pass and one share, and in several: contexts with byte 0, in one payload twice, of all payloads or of none."""
    got = {(r.corpus, r.n): r.bits for r in I.random_bits(spark, 2, per_corpus, length, letters, order, seed=5, block=16, **bounds).collect()}
    drawn = I.random_payloads(spark, 2, per_corpus, length, letters, seed=5, block=16)
    want = {(r.corpus, r.n): r.bits for r in I.leave_one_out_bits(drawn, "n", "data", order, model="corpus").collect()}
    assert got.keys() == want.keys() and len(got) == 2 * per_corpus
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_random_baseline_has_whole_corpora(spark):
    from tidelog.plans.payloads import R, distinct_payloads

    sf = "/root/testdata/sf0.001"
    d = distinct_payloads(spark, sf)
    n, letters = d.count(), sorted({b for r in d.collect() for b in bytes(r.raw_bytes)})
    got = {r.corpus: (r.payloads, r.mean, r.std) for r in R.queries["random_baseline"](spark, sf).collect()}
    assert got.keys() == set(range(100)) and {p for p, _, _ in got.values()} == {n}
    by = {}
    for r in I.leave_one_out_bits(I.random_payloads(spark, 2, n, 22, letters), "n", "data", 8, model="corpus").collect():
        by.setdefault(r.corpus, []).append(r.bits)
    assert all(np.allclose(got[c][1:], (np.mean(b), np.std(b, ddof=1))) for c, b in by.items())
    assert I.random_bits(spark, 3, 0, 22, []).count() == 0


def test_random_corpora_are_scored_in_little_time():
    """220,000 positions; when each was walked on its own, 100 corpora of 12,584 took 212 CPU seconds."""
    from time import process_time

    from tidelog.operators.baseline import corpus_bits, draw_block

    began = process_time()
    bits = corpus_bits(lambda: ((at, draw_block(list(range(255)), 22, 1, 0, at, 1000)) for at in range(0, 10_000, 1000)), 0, 10_000, 22, 8, 256)
    assert process_time() - began < 5 and len(bits) == 10_000 and 150 < bits.min() < bits.max() < 250


def test_frame_files(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import ipc

    from tidelog.sources.arrow_files import FrameFiles

    def write(path, meta, frames):
        path.parent.mkdir(parents=True, exist_ok=True)
        t = pa.table({"time": pa.array(range(len(frames)), pa.int32()), "multiplicity": pa.array([1] * len(frames), pa.int32()), "navbits": pa.array([list(f) for f in frames], pa.list_(pa.uint8()))})
        t = t.replace_schema_metadata({"netcdf_metadata": json.dumps(meta)} if meta else None)
        with ipc.new_file(str(path), t.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)

    write(tmp_path / "2024/100/a.arrow", {"year": 2024, "day_of_year": 100, "prn": 5, "gps_week": 2200, "source_file": "test.nc"}, [bytes(range(38)), bytes(38)])
    write(tmp_path / "b.arrow", None, [bytes([255] * 38)])
    write(tmp_path / "skip.other", None, [bytes(38)])
    spark.dataSource.register(FrameFiles)
    rows = sorted(map(tuple, spark.read.format("frame_files").load(str(tmp_path)).collect()), key=lambda r: (r[3], r[0]))
    assert rows == [(0, 1, bytearray([255] * 38), 0, 0, 0, 0, ""), (0, 1, bytearray(range(38)), 2024, 100, 5, 2200, "test.nc"), (1, 1, bytearray(38), 2024, 100, 5, 2200, "test.nc")]
    assert spark.read.format("frame_files").option("recursive", "false").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception):
        spark.read.format("frame_files").load(str(tmp_path / "none")).collect()


ADVISORY = """SUBJ: STATUS      28 JUN 2020
1. SATELLITES
2020001       010000Z JAN 2020    01   OUTSIDE      /-/
2. CURRENT ADVISORIES
2020002       010000Z JAN 2020    01   EARLY        /-/
A. FORECASTS
NANU          MSG DATE/TIME     PRN  TYPE         SUMMARY

2020028       192025Z JUN 2020    03   FCSTDV       178/0445-178/1645
B. ADVISORIES
2020040       302200Z DEC 2020    07   unusable     365/2200-003/0600
not a record
C. GENERAL
2014038       241350Z APR 2014         GENERAL      /-/
2014039       991350Z APR 2014         GENERAL      /-/
3. REMARKS
2020099       192025Z JUN 2020    03   FCSTDV       178/0445-178/1645
"""


def test_advisory_files(spark, tmp_path):
    from tidelog.sources.advisories import missing_days, read_advisories

    for path, content in (("2020/180.oa1", ADVISORY), ("other/latest.oa1", ADVISORY.replace("\n", "\r\n")), ("none.oa1", "2. CURRENT ADVISORIES\nA. FORECASTS\n" + ADVISORY.splitlines()[8]), ("2019/001.txt", ADVISORY)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    rows = read_advisories(spark, str(tmp_path)).collect()
    assert sorted((r.source_file, r.nanu_id, r.prn, r.nanu_type, r.category) for r in rows) == [
        (f, *x) for f in ("2020/180.oa1", "latest.oa1") for x in (("2014038", None, "GENERAL", "general"), ("2020028", 3, "FCSTDV", "forecast"), ("2020040", 7, "UNUSABLE", "advisory"))
    ]
    r = next(r for r in rows if r.nanu_id == "2020040")
    assert [str(x) for x in (r.msg_datetime, r.event_start, r.event_stop)] == ["2020-12-30 22:00:00", "2020-12-30 22:00:00", "2021-01-03 06:00:00"]
    assert read_advisories(spark, str(tmp_path), years=[2019]).count() == 0
    have = spark.createDataFrame([(2020, d) for d in range(1, 61)], "year int, day_of_year int")
    assert [r.day_of_year for r in missing_days(spark, have, 2020, 2020, "2020-03-02").orderBy("day_of_year").collect()] == [61, 62]


def stream(spark, tmp_path, schema, batches, build, mode, **options):
    """Run a stream over files written one by one, and return all rows put out."""
    source = tmp_path / "in"
    source.mkdir()
    out = []
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(source))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda d, _: out.extend(d.collect())).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_streamed_periods(spark, tmp_path):
    from tidelog.streaming.stateful import stream_periods

    schema = "prn int, a timestamp_ntz, b timestamp_ntz"
    at = lambda h: T0 + H * h
    batches = [[(1, at(0), at(2)), (1, at(10), at(12)), (2, at(1), None)], [(1, at(2), at(5)), (1, at(9), at(8))], [(1, at(4), at(10))]]
    rows = stream(spark, tmp_path, schema, batches, lambda d: stream_periods(d, "prn", "a", "b"), "update")
    hour = lambda us: (us - round((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6)) // 3_600_000_000
    assert [(r.prn, hour(r.start_us), hour(r.stop_us)) for r in rows if r.prn == "1"] == [("1", 0, 2), ("1", 10, 12), ("1", 0, 5), ("1", 0, 12)]
    assert hour(next(r for r in rows if r.prn == "1").next_start_us) == 10


def test_streamed_periods_let_go_of_the_past(spark, tmp_path):
    from tidelog.streaming.stateful import stream_periods

    schema = "prn int, a timestamp_ntz, b timestamp_ntz"
    at = lambda h: T0 + H * h
    batches = [[(1, at(0), at(1)), (1, at(20), at(21))], [(1, at(0), at(22)), (1, at(19), at(20))]]
    rows = stream(spark, tmp_path, schema, batches, lambda d: stream_periods(d, "prn", "a", "b", keep_us=5 * 3_600_000_000), "update")
    hour = lambda us: (us - round((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6)) // 3_600_000_000
    assert [(hour(r.start_us), hour(r.stop_us)) for r in rows] == [(0, 1), (20, 21), (19, 21)]


def test_streamed_changes_and_counts(spark, tmp_path):
    from tidelog.streaming.stateful import stream_changes
    from tidelog.streaming.windows import stream_daily_counts, stream_exactly_once

    schema = "prn int, t timestamp_ntz, h string"
    at = lambda h: T0 + H * h
    batches = [[(1, at(1), "b"), (1, at(0), "a"), (2, at(0), "a")], [(1, at(2), "b"), (1, at(3), "c"), (2, at(1), "a")]]
    rows = stream(spark, tmp_path, schema, batches, lambda d: stream_changes(d, "prn", "t", "h"), "append")
    assert [(r.prn, r.from_payload, r.to_payload) for r in rows] == [("1", "a", "b"), ("1", "b", "c")]
    (tmp_path / "z").mkdir()
    late = [[(1, at(0), "a")], [(1, at(50), "b")], [(9, at(1), "x")], [(9, at(49.5), "y")], [(9, at(51), "z")]]  # entity 9's first row is beyond the watermark
    rows = stream(spark, tmp_path / "z", schema, late, lambda d: stream_changes(d, "prn", "t", "h"), "append")
    assert [(r.prn, r.from_payload, r.to_payload) for r in rows] == [("1", "a", "b"), ("9", "y", "z")]
    (tmp_path / "x").mkdir()
    copies = [[(1, at(1), "b"), (1, at(1), "b")], [(1, at(1), "b"), (1, at(2), "c")]]
    assert sorted(r.h for r in stream(spark, tmp_path / "x", schema, copies, lambda d: stream_exactly_once(d, ["prn", "h"], "t"), "append")) == ["b", "c"]
    (tmp_path / "y").mkdir()
    days = [[(1, at(1), "b"), (1, at(2), "b")], [(1, at(80), "z")], [(1, at(81), "z")]]
    assert [(r.prn, r.observation_count) for r in stream(spark, tmp_path / "y", schema, days, lambda d: stream_daily_counts(d, "prn", "t", "h"), "append")] == [(1, 2)]


def test_ingest_keeps_each_message_once(spark):
    from tidelog.functions import bits
    from tidelog.operators.ingest import COLUMNS, decode_observations, ingest

    m = [(600, b"HELLO WORLD 1234567890", 1), (600, b"HELLO WORLD 1234567890", 3), (630, b"\x00" * 22, 1)]
    df = spark.createDataFrame(m, "time int, raw binary, multiplicity int")
    tow = (F.col("time") / 6).cast("int") + 1
    frames = df.select("time", "multiplicity", bits.encode_frame(F.col("raw"), tow, None, True, True).alias("navbits"), F.lit(2024).alias("year"), F.lit(100).alias("day_of_year"), F.lit(5).alias("prn"), F.lit(2200).alias("gps_week"), F.lit("f").alias("source_file"))
    junk = frames.withColumn("navbits", F.unhex(F.repeat(F.lit("AB"), 38))).union(frames.withColumn("navbits", F.lit(None).cast("binary"))).union(frames.withColumn("navbits", F.lit(b"x")))
    rows = ingest(frames.union(junk)).orderBy("datetime").collect()
    assert rows[0].asDict().keys() == set(COLUMNS) and [str(r.datetime) for r in rows] == ["2024-04-09 00:10:00", "2024-04-09 00:10:30"]
    assert [(r.ascii_message, r.multiplicity, r.parity_ok, r.sv_id, r.null_bytes) for r in rows] == [("HELLO WORLD 1234567890", 1, True, 55, 0), ("�" * 22, 1, True, 55, 22)]
    assert decode_observations(frames.withColumn("year", F.lit(0))).where("datetime is null").count() == 3


def test_files_around_the_archive(spark, tmp_path):
    from tidelog.sources import files as FI

    html = '<a href="?C=N">Name</a> <a href="2020/">2020/</a>  2024-01-02 03:04    -   <a href="a.tar">a.tar</a> </td><td align="right">2024-01-02 03:05  </td><td align="right">1.5K'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    got = [(r.id, r.name, str(r.modified), r.bytes, r.is_folder) for r in FI.parse_listing(pages, "html").orderBy("name").collect()]
    assert got == [(1, "2020/", "2024-01-02 03:04:00", None, True), (1, "a.tar", "2024-01-02 03:05:00", 1536, False)]
    fits = spark.createDataFrame([(100_000, 91_000), (100_000, 89_000), (2000, 1000)], "a long, b long").select(FI.size_fits(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in fits] == [True, False, True]
    (tmp_path / "r.md").write_text("Mean: 1,234.5 bits\nnothing\nMean: 7 bits\n")
    assert [(r.name, r.value) for r in FI.report_values(spark, str(tmp_path / "r.md"), {"mean": r"Mean: ([0-9.,]+) bits"}).collect()] == [("mean", 1234.5), ("mean", 7.0)]
    import hashlib

    assert [r.sha256 for r in FI.checksums(spark, str(tmp_path), "*.md").collect()] == [hashlib.sha256((tmp_path / "r.md").read_bytes()).hexdigest()]
    log = observations(spark, "AB").withColumn("year", F.lit(2020))
    FI.write_log_text(log, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["[2020-01-01 00:01:40] PRN 05: A", "[2020-01-01 00:03:20] PRN 05: B"]
    FI.write_observations(log, str(tmp_path / "obs"))
    FI.write_observations(log, str(tmp_path / "obs"))
    assert spark.read.parquet(str(tmp_path / "obs")).where("year = 2020").count() == 2


def test_reports_are_bounded(spark):
    from tidelog.plans.reports import REPORTS, markdown_report
    from tidelog.plans import all_registries

    names = {n for r in all_registries() for n in r.queries}
    assert all(s in names for r in REPORTS.values() for s in r)
    text = markdown_report(spark, "/root/testdata/sf0.001", "corpus", rows=3)
    assert text.startswith("# Corpus") and "Only the first 3 rows" in text


def test_netcdf_needs_its_library(spark, tmp_path):
    from importlib.util import find_spec

    from tidelog.sources.netcdf_files import read_netcdf

    if not find_spec("netCDF4"):
        with pytest.raises(RuntimeError):
            read_netcdf(spark, str(tmp_path))


def test_staged_tables_are_released(spark):
    from tidelog.session import release_staged, stage

    assert stage(spark.range(3)).count() == 3
    release_staged(spark)


def test_frequent_keys_are_split_in_a_join(spark):
    from tidelog.operators.skew import salted_join

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}", "x") for i in range(3000)] + [(-1, None, "x"), (-2, "absent", "x")], "i long, k string, v string").repartition(4)
    table = rows.where("k <> 'absent'").groupBy("k").count().withColumn("v2", F.upper("k"))
    for share in (1, 7, 1000):
        got = salted_join(rows, table, ["k"], "count", F.col("i"), share)
        assert set(got.columns) == {"i", "k", "v", "v2"}
        assert sorted((r.i, r.k, r.v2) for r in got.collect()) == sorted((r.i, r.k, r.k.upper()) for r in rows.where("i >= 0").collect())
    assert salted_join(rows.where("false"), table.where("false"), ["k"], "count", F.col("i")).count() == 0

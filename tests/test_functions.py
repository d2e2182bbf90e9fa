"""Frames, text and statistics: round trips, fixed values, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import bits, stats, text as X, timefn as TF

# The parity equations' masks over a 30-bit word.
MASKS = [0x3B1F3480, 0x1D8F9A40, 0x2EC7CD00, 0x1763E680, 0x2BB1F340, 0x0B7A89C0]


def one(df, *cols):
    return df.select(*cols).collect()


def test_parity_masks():
    assert [sum(1 << (30 - b) for b in nums) for nums, _ in bits.PARITY] == MASKS


def messages():
    """Ten messages of printable characters; character j of message i has code 0x20 + (11 i + 7 j) mod 95."""
    return [(i, bytes(0x20 + (11 * i + 7 * j) % 95 for j in range(1, 23)), 400 + 50 * i) for i in range(1, 11)]


@pytest.fixture(scope="module")
def frames(spark):
    m = spark.createDataFrame(messages(), "i int, message binary, tow int")
    kinds = [(c, v) for c in (False, True) for v in (False, True)]
    rows = F.inline(F.array(*(F.struct(F.lit(c).alias("complemented"), F.lit(v).alias("inverted"), bits.encode_frame(F.col("message"), F.col("tow"), None, c, v).alias("frame")) for c, v in kinds)))
    return m.select("*", rows).withColumn("secs", F.col("tow") * 6 - 6).cache()


def test_frames_round_trip(frames):
    got = frames.select("message", bits.may_be_special(F.col("frame")).alias("may"), F.octet_length("frame").alias("n"), bits.parse_frame(F.col("frame"), F.col("secs")).alias("f")).collect()
    assert len(got) == 40
    for r in got:
        assert r.may and r.n == 38
        assert (r.f.subframe_id, r.f.page_number, r.f.sv_id, r.f.parity_ok, bytes(r.f.payload)) == (4, 17, 55, True, bytes(r.message))


def damage(frame, changes):
    b = bytearray(frame)
    for at, to in changes.items():
        b[at - 1] = to(b[at - 1])
    return bytes(b)


def test_damaged_frames(spark, frames):
    plain = bytes(frames.where("i = 3 and not complemented and not inverted").first().frame)
    secs = (400 + 150) * 6 - 6
    noisy = damage(plain, {19: lambda x: x ^ 0x10})
    garbage = damage(noisy, {1: lambda x: 0})
    preamble = damage(plain, {1: lambda x: 0})
    other = damage(plain, {7: lambda x: x ^ 0x10})  # another subframe
    rows = [("noisy", noisy), ("garbage", garbage), ("preamble", preamble), ("other", other), ("short", plain[:37]), ("null", None)]
    got = {r.k: r.f for r in spark.createDataFrame([(k, f, secs) for k, f in rows], "k string, f binary, s int").select("k", bits.parse_frame(F.col("f"), F.col("s")).alias("f")).collect()}
    assert got["noisy"].page_number == 17 and not got["noisy"].parity_ok
    assert got["garbage"].page_number is None
    assert got["other"].page_number is None
    assert got["short"] is None and got["null"] is None


def test_bulk_frames_equal_expressions(spark, frames):
    """Encoding and parsing of batches against the column expressions: every polarity, damaged, foreign, short and missing frames."""
    from tidelog.functions.frames import encode_frames, with_parsed

    bulk = frames.select("frame", encode_frames(F.col("message"), F.col("tow"), None, F.col("complemented"), F.col("inverted")).alias("bulk")).collect()
    assert all(r.frame == r.bulk for r in bulk)
    rnd = random.Random(8)
    rows = []
    for f, secs in ((bytes(r.frame), r.secs) for r in frames.select("frame", "secs").collect()):
        for _ in range(6):
            b = bytearray(f)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                b[rnd.choice([0, 3, 4, 5, 6, 7, 8, 20, rnd.randrange(38)])] ^= 1 << rnd.randrange(8)
            rows.append((bytes(b), rnd.choice([secs, secs, None, 0])))
    rows += [(bytes(rnd.randrange(256) for _ in range(38)), 60) for _ in range(100)] + [(rows[0][0][:37], 0), (b"", 0), (None, 0), (None, None)]
    df = spark.createDataFrame(rows, "f binary, s int").repartition(3)
    both = with_parsed(with_parsed(df, "f", "s", "b"), "f", None, "d")
    got = both.select(bits.parse_frame(F.col("f"), F.col("s")).alias("a"), "b", bits.parse_frame(F.col("f")).alias("c"), "d").collect()
    assert len(got) == len(rows) and all(r.a == r.b and r.c == r.d for r in got)
    assert len({(r.a.page_number, r.a.parity_ok, r.a.inverted) for r in got if r.a}) > 5
    assert with_parsed(df.where("false"), "f").count() == 0


def test_time_of_week_wraps(spark):
    w2 = 0 << 13 | 4 << 8
    r = one(spark.range(1), bits.handover(F.lit(w2).cast("long"), F.lit(86_394)).alias("h"), bits.handover(F.lit(w2 ^ 0x3FFFFFFF).cast("long"), F.lit(86_394)).alias("i"))[0]
    assert (r.h.tow, r.h.inverted, r.h.subframe_id) == (0, False, 4) and (r.i.tow, r.i.inverted, r.i.subframe_id, r.i.alert_flag) == (0, True, 4, False)


def test_extract_bits(spark):
    rnd = random.Random(0)
    data = bytes(rnd.randrange(256) for _ in range(38))
    whole = int.from_bytes(data, "big")
    df = spark.createDataFrame([(data,)], "d binary")
    cuts = [(0, 30), (7, 1), (8, 8), (13, 22), (270, 30), (100, 48), (303, 1)]
    got = one(df, *(bits.extract_bits(F.col("d"), a, n).alias(f"c{i}") for i, (a, n) in enumerate(cuts)))[0]
    assert list(got) == [whole >> (304 - a - n) & ((1 << n) - 1) for a, n in cuts]


def test_parity_bits_detect_single_errors(spark):
    word = 0b101100111000111100001111 << 6
    df = spark.range(25).withColumn("w", F.lit(word).cast("long"))
    good = bits.with_parity(F.col("w"), F.lit(1).cast("long"), F.lit(0).cast("long"))
    flipped = F.when(F.col("id") == 24, good).otherwise(good.bitwiseXOR(F.expr("shiftleft(1L, cast(6 + id as int))")))
    assert [r.ok for r in one(df, bits.parity_ok(flipped, F.lit(1).cast("long"), F.lit(0).cast("long")).alias("ok"))] == [False] * 24 + [True]


def test_code_page(spark):
    page = X.code_page()
    assert len(page) == 256 and len(set(page)) == 255 and page[0] == "�" and page[1] == "☺" and page[0x7F] == "⌂" and page[0xF8] == "°" and page[0xFF] == " " and page[0xAA] == "¬"
    df = spark.createDataFrame([(bytes(range(256)),), (b"",), (None,)], "b binary")
    assert [r.t for r in one(df, X.decode_message(F.col("b")).alias("t"))] == ["".join(page), "", None]


def test_message_statistics(spark):
    df = spark.createDataFrame([(b"",), (b"aaaa",), (b"abab",), (b"\0\0\0a",), (b"hello world, hello!!!!",), (None,)], "b binary")
    got = [tuple(r.s) if r.s else None for r in one(df, X.message_stats(F.col("b")).alias("s"))]
    assert got[0] == (False, 0, 0, 0.0) and got[1] == (True, 4, 0, 0.0) and got[2][3] == 1.0 and got[3][:3] == (False, 1, 3) and got[4][0] is True


@pytest.mark.parametrize("text,filler,kind,same", [(" " * 22, True, "all_space", True), ("�" * 22, True, "all_nul", True), ("¬" * 22, True, "all_aa", True), ("", True, "all_aa", True), (" ¬", False, "unknown", False), ("a" * 22, False, "unknown", True)])
def test_fillers(spark, text, filler, kind, same):
    r = one(spark.createDataFrame([(text,)], "t string"), X.is_sentinel(F.col("t")).alias("a"), X.sentinel_class(F.col("t")).alias("b"), X.one_character(F.col("t")).alias("c"))[0]
    assert (r.a, r.b, r.c) == (filler, kind, same)


def test_advisory_fields(spark):
    df = spark.createDataFrame([("192025Z JUN 2020", "178/0445-178/1645", 2020), ("not a date", "013/1734-/", 2020), ("312025Z JUN 2020", "/-/", 2020), (None, None, 2020), ("010000z jan 2021", "365/2200-003/0600", 2020), ("", "", 2020)], "s string, p string, y int")
    got = one(df, X.parse_stamp(F.col("s")).cast("string").alias("t"), X.parse_span(F.col("p")).alias("p"), X.event_span(X.parse_span(F.col("p")), F.col("y")).alias("e"))
    assert [r.t for r in got] == ["2020-06-19 20:25:00", None, None, None, None, None] or [r.t for r in got][0] == "2020-06-19 20:25:00"
    assert [tuple(r.p) for r in got][:3] == [(178, "0445", 178, "1645"), (13, "1734", None, None), (None,) * 4]
    assert [str(x) for x in got[4].e] == ["2020-12-30 22:00:00", "2021-01-03 06:00:00"]


def test_sizes(spark):
    df = spark.createDataFrame([("512", 512), ("1.5K", 1536), ("20M", 20 * 1024**2), ("-", None), ("x", None)], "s string, n long")
    assert [r.n for r in one(df, X.parse_size(F.col("s")).alias("n"))] == [512, 1536, 20 * 1024**2, None, None]
    assert [r.t for r in one(df, X.size_text(F.col("n")).alias("t"))][:3] == ["512 B", "1.5 KB", "20.0 MB"]


def test_time_helpers(spark):
    df = spark.sql("select timestamp_ntz'2020-01-05 00:59:00' a, timestamp_ntz'2020-01-05 01:01:00' b")
    r = one(df, TF.hour_boundaries("a", "b").alias("h"), TF.hours_between("a", "b").alias("e"), TF.day_of_week("a").alias("d"), TF.trunc_ntz("week", "a").alias("w"), TF.from_micros(TF.micros("a")).alias("m"), TF.from_year_day(F.lit(2020), F.lit(366), F.lit(86399)).alias("y"))[0]
    assert (r.h, round(r.e, 6), r.d) == (1, round(2 / 60, 6), 0)
    assert [str(x) for x in (r.w, r.m, r.y)] == ["2019-12-30 00:00:00", "2020-01-05 00:59:00", "2020-12-31 23:59:59"]
    assert dict(df.select(TF.trunc_ntz("week", "a").alias("w")).dtypes)["w"] == "timestamp_ntz"


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


L = F.lit


def test_distributions(spark):
    assert abs(value(spark, stats.normal_cdf(L(1.96))) - 0.975) < 1e-4 and value(spark, stats.normal_cdf(L(-9.0))) == 0 and value(spark, stats.normal_cdf(L(9.0))) == 1
    assert abs(value(spark, stats.normal_two_sided(L(-1.96))) - 0.05) < 1e-4
    assert abs(value(spark, stats.poisson_pmf(L(2), L(1.0))) - math.exp(-1) / 2) < 1e-12 and value(spark, stats.poisson_pmf(L(0), L(0.0))) == 1
    assert value(spark, stats.poisson_cdf(L(-1), L(1.0))) == 0 and abs(value(spark, stats.poisson_sf(L(1), L(1.0))) - (1 - 2 * math.exp(-1))) < 1e-12
    want = sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(5, 11))
    assert abs(value(spark, stats.binomial_sf(L(4), L(10), L(0.3))) - want) < 1e-9
    assert [value(spark, stats.binomial_sf(L(k), L(10), L(p))) for k, p in ((-1, 0.5), (10, 0.5), (3, 0.0), (3, 1.0))] == [1, 0, 0, 1]
    assert abs(value(spark, stats.binomial_sf(L(520), L(1000), L(0.5))) - 0.0974) < 1e-3
    assert abs(value(spark, stats.birthday_collisions(L(23), L(365))) - 23 * 22 / 730) < 1e-12
    assert value(spark, stats.ks_p_value(L(0.0), L(5), L(5))) == 1 and value(spark, stats.ks_p_value(L(1.0), L(5), L(5))) == 0 and 0.9 < value(spark, stats.ks_p_value(L(0.1), L(20), L(20)))
    assert abs(value(spark, stats.poisson_binomial_tail(F.array(L(0.5), L(0.5), L(0.2)), L(2))) - (0.25 * 0.8 + 0.5 * 0.2 + 0.25 * 0.2)) < 1e-12
    assert [value(spark, stats.effect_label(L(x))) for x in (0.1, -0.3, 0.6, 2.0)] == ["negligible", "small", "medium", "large"]
    assert abs(stats.field_capacity_bits(45) - 120.8208) < 1e-3


def test_two_sample_tests(spark):
    rnd = random.Random(4)
    rows = [("a", float(rnd.randrange(20))) for _ in range(80)] + [("b", float(rnd.randrange(5, 25))) for _ in range(60)] + [("a", None), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    a, b = (sorted(v for g, v in rows if g == x and v is not None) for x in "ab")
    d = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in set(a + b))
    k = stats.ks_test(df, "v", "g", "a", "b").first()
    assert (k.n1, k.n2) == (80, 60) and abs(k.d - d) < 1e-12
    both = sorted(a + b)
    rank = {v: (2 * both.index(v) + both.count(v) + 1) / 2 for v in set(both)}
    n = len(both)
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    z = (sum(rank[v] for v in a) - 80 * (n + 1) / 2) / math.sqrt(80 * 60 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert abs(stats.rank_sum_test(df, "v", "g", "a", "b").first().z - z) < 1e-9
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert tuple(stats.rank_sum_test(same, "v", "g", "a", "b").first())[2:] == (0.0, 1.0)


def test_chi_squared(spark):
    df = spark.createDataFrame([(10, 8.0), (6, 8.0), (8, 8.0)], "o int, e double")
    r = stats.chi_squared(df, "o", "e").first()
    assert abs(r.chi2 - 1.0) < 1e-12 and r.df == 2 and abs(r.p_value - 0.6065) < 0.02

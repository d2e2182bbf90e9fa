"""Containers, mixtures and look-alikes: invariants, brute force, and awkward tables."""

import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tidelog.llm.lookalike import ALIKE, Trie, canonical_texts, fold, look_alike_classes, look_alike_pairs, spellings, well_spelled
from tidelog.llm.mixing import mix, schedule
from tidelog.llm.packing import BinTree, first_fit_decreasing, pack
from tidelog.llm.tokens import TOKENIZERS, _encoding, count_tokens, token_count


@given(st.lists(st.integers(0, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tree_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(50)
            at = len(room) - 1
        room[at] -= s
        want.append(at)
    assert first_fit_decreasing(sizes, 50) == want


def test_tree_of_one_bin():
    assert BinTree(1, 5).place(5) == 0


LIMITS = "container string, capacity_tokens int"


@pytest.mark.parametrize("group", [4096, 50])
def test_packing_keeps_every_unit(spark, group):
    rnd = random.Random(3)
    items = [(i, rnd.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000]) if rnd.random() < 0.5 else rnd.randrange(60)) for i in range(400)] + [(None, 7), (5, None), (5, -3), (5, 40), (5, 40)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in items], "doc int, n int, grp string, size int").repartition(4)
    out = pack(df, "doc", "n", spark.createDataFrame([("small", 100), ("big", 512)], LIMITS), group_items=group).collect()
    for kind, capacity in (("small", 100), ("big", 512)):
        rows = [r for r in out if r.container == kind]
        assert len({r.row for r in rows}) == len(items)
        assert sum(r.units for r in rows) == sum(max(n or 0, 0) for _, n in items)
        bins = {}
        for r in rows:
            bins[r.grp, r.bin] = bins.get((r.grp, r.bin), 0) + r.units
        assert max(bins.values()) <= capacity
        for row in {r.row for r in rows}:
            mine = sorted((r.piece, r.first_unit, r.units) for r in rows if r.row == row)
            assert [m[1] for m in mine] == [sum(x[2] for x in mine[:i]) for i in range(len(mine))]
            assert len(mine) == 1 or all(m[2] == capacity for m in mine[:-1]) and mine[-1][2] > 0
        if group > 1000:
            assert len(bins) <= 11 / 9 * sum(max(n or 0, 0) for _, n in items) / capacity + 2


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "doc int, n int")
    limits = spark.createDataFrame([("small", 100)], LIMITS)
    assert pack(empty, "doc", "n", limits).count() == 0
    assert pack(spark.createDataFrame([(1, 2)], "doc int, n int"), "doc", "n", limits.where("false")).count() == 0
    with pytest.raises(ValueError):
        pack(empty, "doc", "n", spark.createDataFrame([("bad", 0)], LIMITS))


def test_schedule_follows_weights_everywhere(spark):
    weights = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    rows = schedule(spark, weights, 1000, chunk=64).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1000))
    seen = {n: 0 for n, _ in weights}
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        assert all(abs(seen[n] - w * i) < 4 for n, w in weights)


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(2)
    items = [(i, s, rnd.randrange(1, 40)) for s, n in (("a", 3000), ("b", 800), ("c", 60), (None, 30), ("untargeted", 40)) for i in range(n)]
    items += [(1, "a", None), (2, "a", 0), (None, "b", 5), (7, "c", 3), (7, "c", 3)]
    df = spark.createDataFrame([(*x, "z", 0) for x in items], "doc int, source string, n int, at string, copy int").repartition(4)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("absent", 0.0, 3), ("none", None, 1)], TARGETS)
    mixture, report = mix(df, "doc", "source", "n", targets, block=64, shard_rows=200)
    by = {r.source: r for r in report.collect()}
    for s, share, cap in (("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 4)):
        assert abs(by[s].actual_share - share) < 0.02 and by[s].most_copies <= cap
    assert {s: by[s].mixed for s in (None, "untargeted", "absent", "none")} == {None: 0, "untargeted": 0, "absent": 0, "none": 0}
    rows = mixture.collect()
    uses = {}
    for r in rows:
        uses.setdefault(r.row, []).append(r.copy)
    assert all(len(set(c)) == len(c) for c in uses.values())
    assert by["c"].mixed > by["c"].available
    slots = {}
    for r in rows:
        slots[r.slot] = slots.get(r.slot, 0) + r.size
    assert sum(64 - 40 <= n <= 64 + 40 for n in slots.values()) >= len(slots) - 6


def test_larger_totals_fall_short_and_say_so(spark):
    df = spark.createDataFrame([(i, s, 10) for s in "ab" for i in range(100)], "doc int, source string, n int")
    _, report = mix(df, "doc", "source", "n", spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS), total=2000, block=20)
    by = {r.source: r for r in report.collect()}
    assert by["a"].mixed == 1000 and by["a"].actual_share < 0.9


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc int, source string, n int")
    mixture, report = mix(df, "doc", "source", "n", spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mixture.count() == 0 and [(r.source, r.mixed) for r in report.collect()] == [("a", 0)]


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("é" * 5000,)], "t string")
    got = [r.n for r in df.select(count_tokens("t").alias("n")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[4] > 1000


@given(st.text(alphabet=" \n\t\u00a0a1!é", max_size=40), st.integers(2, 6))
@settings(max_examples=300, deadline=None)
def test_long_blanks_are_counted_like_short_ones(text, least):
    e = _encoding(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert token_count(e, text, least) == len(e.encode_ordinary(text))


def test_millions_of_blanks(spark):
    df = spark.range(1).selectExpr("concat('a', repeat(' ', 3000000), 'b', repeat('\n', 1500000)) as t")
    assert df.select(count_tokens("t").alias("n")).first().n > 1_000_000


CYRILLIC_WORD = "привет"


def test_trie_costs_nothing_for_look_alikes_only():
    t = Trie()
    for w in ("paypal", CYRILLIC_WORD, "café", "Data"):
        t.add(w, 1)
    assert t.match("раураl") == "paypal" and t.match("ｐａｙ​ｐａｌ") == "paypal"
    assert t.match("пpивeт") == CYRILLIC_WORD and t.match("café") == "café"
    assert t.match("cafe") is None and t.match("PayPal") is None and t.match("paypa1") is None and t.match("data") is None
    assert t.match("paypa1", limit=1) == "paypal" and t.match("paypall", limit=1) == "paypal" and t.match("cafes", limit=0) is None
    assert well_spelled("paypal") and well_spelled(CYRILLIC_WORD) and not well_spelled("пpивeт") and not well_spelled("café")


def edits(a, b):
    """Edit distance of two readings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def apart(text):
    return unicodedata.normalize("NFD", fold(text))


@given(st.lists(st.text(alphabet="abcаé", min_size=1, max_size=7), min_size=1, max_size=8), st.text(alphabet="abcаéс\u200b", max_size=7), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_automaton_equals_edit_distance(words, token, limit):
    t = Trie()
    for w in words:
        t.add(w, 1)
    near = min(edits(apart(w), apart(token)) for w in words)
    got = t.match(token, limit)
    assert (got is None) == (near > limit)
    assert got is None or edits(apart(got), apart(token)) == near


def test_edits_of_every_kind():
    t = Trie()
    for w in ("paypal", "data", "date"):
        t.add(w, 1)
    assert t.match("paypl", 1) == "paypal" and t.match("pypl", 1) is None and t.match("pypl", 2) == "paypal"
    assert t.match("dta", 1) == "data" and t.match("dаtee", 1) == "date" and t.match("", 3) is None and t.match("", 4) == "data"


def test_words_of_any_length_take_the_same_way():
    t, long = Trie(), "https://" + "ab" * 500_000
    t.add(long, 1)
    t.add(long + "x", 1)
    assert t.match(long.replace("a", "а", 1)) == long and t.match(long + "хx") is None and len(t.root.after) == 1


def test_more_scripts_fonts_and_hidden_characters():
    for odd in ("ρ", "𝐩", "ｐ", "р", "ⲣ", "p\U000e0101", "p\U000e0041"):
        assert fold(odd) == "p", odd
    assert fold("ɑⅼ") == "al" and fold("Ꭺꓐ") == "AB" and fold("１") == "1" and fold("𝟏") == "𝟏" and fold("ı") == "ı"
    assert all(fold(a) == fold(b) for a, b in ALIKE.items())


@given(st.text(alphabet="aAеЕoо0é́​ｅ Кk1", max_size=12))
@settings(max_examples=300, deadline=None)
def test_fold_is_stable(text):
    assert fold(fold(text)) == fold(text)


def reading(text):
    """The reading of a text, character by character; independent of words and vocabulary."""
    return fold("".join(" " if unicodedata.category(c) == "Zs" else c for c in text))


def disguise(rnd, text):
    twins = {}
    for a, b in ALIKE.items():
        twins.setdefault(b, []).append(a)
    out = []
    for c in text:
        r = rnd.random()
        if r < 0.15 and c in twins:
            c = rnd.choice(twins[c])
        elif r < 0.3 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif r < 0.4:
            c = unicodedata.normalize("NFD", c)
        elif r < 0.5:
            c += rnd.choice("​‍⁠﻿­")
        elif c == " ":
            c = rnd.choice("  　 ")
        out.append(c)
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    words = ["paypal", "data", "naïve", "café", "résumé", "привет", "сор", "cop", "x1", "X1", "Ñandú", "fix", "ok", "—", "中文", "ガラス", "한국", "οχι", "́a", "​"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 7))) + rnd.choice(["", "\n", "\r\nok", "  end", "\ttab"]) for _ in range(150)]
    out += [disguise(rnd, t) for t in out] + [disguise(rnd, t) for t in out[:60]] + out[:20]
    out += ["a" * 1500, "a" * 1499 + "а", "a" * 1500 + "​", "сор", "cop", "a  b", "a b", "a b", "Data", "data", " ", " ", " "]
    return [*enumerate(out), (900, None), (901, None), (902, ""), (903, "")]


def test_pairs_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, sha string, token string").repartition(4)
    got = [(r.doc_id_a, r.doc_id_b) for r in look_alike_pairs(df, "doc_id", "text").collect()]
    full = [(i, t, reading(t)) for i, t in texts if t]
    want = {(a, b) for a, x, r in full for b, y, s in full if a < b and x != y and r == s}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_pairs_survive_a_join_replanned_at_run_time(spark, texts):
    """A join planned as a merge that becomes a broadcast at run time must not tear the buckets."""
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()} == want
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(k)


def test_canonical_texts_keep_rows_and_readings(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id long, text string, _sha string, canonical string, _text string").repartition(4)
    rows = canonical_texts(df, "text").collect()
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "_sha", "canonical", "_text"}
    forms = {}
    for r in rows:
        if r.text is None:
            assert r.canonical is None
        else:
            assert reading(r.canonical) == reading(r.text)
            assert forms.setdefault(reading(r.text), r.canonical) == r.canonical
    own = {r.text: r.canonical for r in rows}
    assert own["cop"] == "cop" == own["сор"] and own["a  b"] == "a  b"
    assert any("привет" in c for c in forms.values())


def test_copies_of_one_text_are_a_third_of_all_rows(spark):
    """Copies are split by their counts; repeated rows, null ids and columns without a hash go along."""
    copies = spark.range(6000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "'сор' as text", "map('a', 1) as more")
    others = spark.range(6000, 18000).selectExpr("id as doc_id", "concat('text ', id) as text", "map('a', 1) as more")
    df = copies.unionByName(copies.limit(500)).unionByName(others).unionByName(spark.sql("select 1000000L as doc_id, 'cop' as text, map('b', 2) as more")).repartition(4)
    forms = {(r.text, r.canonical): r.n for r in canonical_texts(df, "text").where("text in ('сор', 'cop')").selectExpr("text", "canonical", "count(1) over (partition by text) as n").distinct().collect()}
    assert forms == {("сор", "cop"): 6500, ("cop", "cop"): 1} and canonical_texts(df, "text").count() == 18501
    classes = look_alike_classes(df, "doc_id", "text")
    assert {(r.class_size, r.links): r.n for r in classes.groupBy("class_size", "links").agg(F.count(F.lit(1)).alias("n")).collect()} == {(6501, 1): 6500, (6501, 6500): 1}
    assert look_alike_pairs(df.where("doc_id is not null"), "doc_id", "text").count() == 3000


def test_look_alikes_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert look_alike_pairs(df, "doc_id", "text").count() == 0 and canonical_texts(df, "text").count() == 0


def test_classes_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts] + [(7000, "x", "x"), (7000, "x", "x")], "doc_id long, text string, form string").repartition(4)
    full = [(i, t, reading(t)) for i, t in texts if t] + [(7000, "x", "x")] * 2
    want = []
    for i, t, r in full:
        same = [y for _, y, s in full if s == r]
        if len(set(same)) > 1:
            want.append((i, len(same), sum(y != t for y in same)))
    got = look_alike_classes(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.class_size, r.links) for r in got) == sorted(want)
    of = {r.doc_id: r.form for r in got}
    assert all((of[a] == of[b]) == (r == s) for a, _, r in full for b, _, s in full if a in of and b in of)


def test_decomposed_syllables_keep_their_class(spark):
    """Hangul and two-part vowels stored apart meet the composed word, whose spelling the vocabulary prefers."""
    words = ["한국어", "কোন", "ガラス", "привет"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words * 3)] + [(100 + i, unicodedata.normalize("NFD", w) + "\u200b") for i, w in enumerate(words)], "doc_id long, text string")
    assert {r.canonical for r in canonical_texts(df, "text").collect()} == set(words)


def test_a_hundred_thousand_words_of_one_beginning_and_length(spark):
    """No bucket takes all words of one prefix and length, however many of them are asked for."""
    links = spark.range(100_000).selectExpr("concat('https://example.org/', lpad(id, 9, '0')) as text", "id as doc_id")
    odd = links.where("doc_id % 10 = 0").selectExpr("replace(text, 'e', 'е') as text", "doc_id + 1000000 as doc_id")
    both = links.unionByName(odd)
    assert look_alike_pairs(both, "doc_id", "text").count() == 10_000
    tokens = spellings(both, "text", trie_words=100)
    assert tokens.where("spelling like 'https://example.org/%' and n = 1").count() == 10_000

"""Queries on frames, payload bytes, compression, substrings and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import bits, stats, text as X
from tidelog.functions.frames import encode_frames, with_parsed
from tidelog.functions.timefn import from_year_day
from tidelog.operators import information as I
from tidelog.operators.ingest import ingest
from tidelog.plans.base import LOG, log
from tidelog.plans.evidence import sql_binomial_sf, sql_normal_sf, sql_poisson_sf
from tidelog.plans.registry import Registry, table
from tidelog.session import stage

R = Registry()


def distinct_payloads(spark, sf):
    """(message_hash, raw_bytes) of the distinct payloads; deliveries repeat them, so they needn't be told apart first."""
    return table(spark, sf, "special_messages").select(F.lower("message_hash").alias("message_hash"), "raw_bytes").distinct()


_DISTINCT = LOG + ", d AS (SELECT message_hash, any_value(raw_bytes) AS raw_bytes, hex(any_value(raw_bytes)) AS h FROM log GROUP BY message_hash), b AS (SELECT message_hash, p, substr(h, 2 * p - 1, 2) AS x FROM d, generate_series(1, 22) AS g(p))"
#: The value of two hex digits.
_HEX = "CAST((instr('0123456789ABCDEF', substr(x, 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2, 1)) - 1 AS INTEGER)"


@R.query("frames_decoded", "SELECT obs_id, seconds_of_day, alert_flag, hex(raw_bytes) AS payload, 4 AS subframe_id, 17 AS page_number, 55 AS sv_id, true AS parity_ok FROM special_messages")
def frames_decoded(spark, sf):
    """Every message as packed frames, polarity and complementing by row, identified and decoded again."""
    m = table(spark, sf, "special_messages").select("obs_id", "seconds_of_day", "alert_flag", "raw_bytes")
    at = F.pmod(F.col("seconds_of_day") - F.pmod(F.col("seconds_of_day"), F.lit(6)), F.lit(86_400))  # frames begin every six seconds
    tow = F.pmod((at + 6) / F.lit(6), F.lit(14_400.0)).cast("int")
    odd = lambda n: F.pmod(F.floor(F.col("obs_id") / F.lit(n)), F.lit(2)) == 1
    frame = encode_frames(F.col("raw_bytes"), tow, F.col("alert_flag"), complemented=odd(1), inverted=odd(2))
    frames = stage(m.select("obs_id", "seconds_of_day", at.alias("at"), frame.alias("frame")))  # as a receiver's archive has them
    got = with_parsed(frames.where(bits.may_be_special(F.col("frame"))), "frame", "at")
    return got.select("obs_id", "seconds_of_day", "f.alert_flag", F.hex("f.payload").alias("payload"), "f.subframe_id", "f.page_number", "f.sv_id", "f.parity_ok")


_INGESTED = """
    SELECT DISTINCT datetime, prn, sha256(raw_bytes) AS message_hash, hex(raw_bytes) AS payload, ascii_message, alert_first AS alert_flag, true AS parity_ok, printable_chars, null_bytes
    FROM (SELECT *, first_value(alert_flag) OVER (PARTITION BY datetime, prn, raw_bytes ORDER BY source_file, seconds_of_day, multiplicity, alert_flag) AS alert_first FROM special_messages WHERE year > 0 AND day_of_year > 0 AND source_file <> '')
"""


@R.query("observations_ingested", _INGESTED)
def observations_ingested(spark, sf):
    """The log made anew from frames of every message whose file is known: decoded, described, each observation once."""
    m = table(spark, sf, "special_messages").where("year > 0 and day_of_year > 0 and source_file <> ''")
    # seconds that a frame can begin at come through; others keep their place in the day by the row's own second
    tow = F.floor(F.pmod(F.col("seconds_of_day"), F.lit(86_400)) / F.lit(6)).cast("int") + 1
    frames = stage(m.select(F.col("seconds_of_day").alias("time"), "multiplicity", encode_frames(F.col("raw_bytes"), tow, F.col("alert_flag")).alias("navbits"), "year", "day_of_year", "prn", "gps_week", "source_file"))
    log = ingest(frames)
    return log.select("datetime", "prn", "message_hash", F.hex("raw_bytes").alias("payload"), "ascii_message", "alert_flag", "parity_ok", "printable_chars", "null_bytes")


@R.query("messages_decoded", "SELECT obs_id, ascii_message FROM special_messages")
def messages_decoded(spark, sf):
    """Text of the payload bytes by the code page."""
    return table(spark, sf, "special_messages").select("obs_id", X.visible_nulls(X.decode_message(F.col("raw_bytes"))).alias("ascii_message"))


@R.query("payload_hashes", "SELECT obs_id, sha256(raw_bytes) AS message_hash FROM special_messages")
def payload_hashes(spark, sf):
    return table(spark, sf, "special_messages").select("obs_id", X.message_hash(F.col("raw_bytes")).alias("message_hash"))


@R.query(
    "message_stats",
    _DISTINCT + f", c AS (SELECT message_hash, x, count(*) AS n FROM b GROUP BY 1, 2), e AS (SELECT message_hash, -sum(n / 22 * log2(n / 22)) AS entropy FROM c GROUP BY 1), "
    f"k AS (SELECT message_hash, count(*) FILTER ({_HEX} BETWEEN 32 AND 126) AS printable_chars, count(*) FILTER ({_HEX} = 0) AS null_bytes FROM b GROUP BY 1) "
    "SELECT message_hash, CAST(printable_chars AS INTEGER) AS printable_chars, CAST(null_bytes AS INTEGER) AS null_bytes, round(entropy, 6) AS entropy, printable_chars / 22 >= 0.7 AND entropy < 4.5 AND null_bytes / 22 < 0.5 AS is_likely_text FROM k JOIN e USING (message_hash)",
)
def message_stats(spark, sf):
    d = distinct_payloads(spark, sf).select("message_hash", X.message_stats(F.col("raw_bytes")).alias("s"))
    return d.select("message_hash", "s.printable_chars", "s.null_bytes", F.round("s.entropy", 6).alias("entropy"), "s.is_likely_text")


@R.query(
    "calendar_columns",
    "SELECT obs_id, make_timestamp(year, 1, 1, 0, 0, 0) + to_days(CAST(day_of_year - 1 AS INTEGER)) + to_seconds(seconds_of_day) AS at, CAST(dayofyear(make_date(year, 12, 31)) AS INTEGER) AS days FROM special_messages WHERE year > 0 AND day_of_year > 0",
)
def calendar_columns(spark, sf):
    """The time that year, day of year and second say, where they are given."""
    m = table(spark, sf, "special_messages").where("year > 0 and day_of_year > 0")
    return m.select("obs_id", from_year_day("year", "day_of_year", "seconds_of_day").alias("at"), X.days_in_year(F.col("year")).alias("days"))


@R.query(
    "uniform_payloads",
    _DISTINCT + ", t AS (SELECT message_hash, min(ascii_message) AS m FROM log GROUP BY 1) SELECT message_hash, h = repeat(substr(h, 1, 2), 22) AS one_byte, m = repeat(substr(m, 1, 1), 22) AS one_character FROM d JOIN t USING (message_hash)",
)
def uniform_payloads(spark, sf):
    d = log(spark, sf, "raw_bytes", "ascii_message").groupBy("message_hash").agg(F.min("ascii_message").alias("m"), F.min(F.hex("raw_bytes")).alias("h"))
    return d.select("message_hash", X.one_byte(F.unhex("h")).alias("one_byte"), X.one_character(F.col("m")).alias("one_character"))


@R.query(
    "log_lines",
    "SELECT obs_id, '[' || strftime(datetime, '%Y-%m-%d %H:%M:%S') || '] PRN ' || CASE WHEN prn < 10 THEN '0' || prn ELSE left(CAST(prn AS VARCHAR), 2) END || ': ' || ascii_message AS line FROM special_messages",
)
def log_lines(spark, sf):
    return table(spark, sf, "special_messages").select("obs_id", X.log_line(F.col("datetime"), F.col("prn"), F.col("ascii_message")).alias("line"))


@R.query("byte_histogram", _DISTINCT + f"SELECT {_HEX} AS byte, count(*) AS n FROM b GROUP BY 1")
def byte_histogram(spark, sf):
    return I.byte_histogram(distinct_payloads(spark, sf), "raw_bytes")


@R.query("position_histogram", _DISTINCT + f'SELECT CAST(p AS INTEGER) AS "position", {_HEX} AS byte, count(*) AS n FROM b GROUP BY 1, 2')
def position_histogram(spark, sf):
    return I.position_histogram(distinct_payloads(spark, sf), "raw_bytes")


@R.query(
    "alphabet_capacity",
    _DISTINCT + ", a AS (SELECT count(DISTINCT x) AS symbols FROM b) SELECT symbols, round(22 * log2(symbols), 6) AS field_bits, CAST(ceil(128 / log2(symbols)) AS BIGINT) AS symbols_for_128_bits FROM a",
)
def alphabet_capacity(spark, sf):
    a = byte_histogram(spark, sf).agg(F.count(F.lit(1)).alias("symbols"))
    each = F.log2(F.col("symbols").cast("double"))
    return a.select("symbols", F.round(22 * each, 6).alias("field_bits"), F.ceil(F.lit(128.0) / each).alias("symbols_for_128_bits"))


_CHI = (
    "c AS (SELECT sum((n - e) * (n - e) / e) AS chi2, max(df) AS df FROM n, t), w AS (SELECT *, (cbrt(chi2 / df) - (1 - 2 / (9.0::DOUBLE * df))) / sqrt(2 / (9.0::DOUBLE * df)) AS w FROM c) "
    f"SELECT round(chi2, 4) AS chi2, df, round((chi2 - df) / sqrt(2 * df), 4) AS z, round({sql_normal_sf('w')}, 6) AS p_value FROM w"
)


@R.query(
    "byte_uniformity",
    _DISTINCT + f", n AS (SELECT {_HEX} AS byte, count(*) AS n FROM b GROUP BY 1), t AS (SELECT sum(n) / count(*) AS e, count(*) - 1 AS df FROM n), " + _CHI,
)
def byte_uniformity(spark, sf):
    """Chi-squared of the bytes that occur in distinct payloads against equal shares; alphabet_uniformity counts absent symbols too."""
    return uniformity(byte_histogram(spark, sf))


#: The 45 symbols of the text alphabet as bytes of the code page.
ALPHABET = [X.code_page().index(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-.'°/: \""]


@R.query(
    "alphabet_uniformity",
    _DISTINCT + f", a AS (SELECT unnest({ALPHABET}) AS byte), k AS (SELECT {_HEX} AS byte, count(*) AS c FROM b GROUP BY 1), n AS (SELECT byte, coalesce(c, 0) AS n FROM a LEFT JOIN k USING (byte)), "
    "t AS (SELECT sum(n) / count(*) AS e, count(*) - 1 AS df FROM n), " + _CHI,
)
def alphabet_uniformity(spark, sf):
    """Chi-squared of the alphabet's symbols in distinct payloads against equal shares; a symbol that never occurs is a cell, other bytes are none."""
    return uniformity(I.alphabet_histogram(distinct_payloads(spark, sf), "raw_bytes", ALPHABET))


def uniformity(n):
    mean = n.agg(F.nullif(F.sum("n") / F.count(F.lit(1)), F.lit(0.0)).alias("expected"))
    c = stats.chi_squared(n.join(F.broadcast(mean)), "n", "expected")
    return c.select(F.round("chi2", 4).alias("chi2"), "df", F.round("z", 4).alias("z"), F.round("p_value", 6).alias("p_value"))


@R.query(
    "context_model",
    _DISTINCT + ", c AS (SELECT o AS ord, substr(h, 2 * (p - o) - 1, 2 * o) AS ctx, substr(h, 2 * p - 1, 2) AS x FROM d, generate_series(1, 22) AS g(p), generate_series(0, 8) AS k(o) WHERE o < p) "
    f"SELECT CAST(ord AS INTEGER) AS ord, ctx, {_HEX} AS sym, count(*) AS cnt FROM c GROUP BY 1, 2, 3",
)
def context_model(spark, sf):
    m = I.context_model(distinct_payloads(spark, sf), "message_hash", "raw_bytes", 8)
    return m.select("ord", F.hex("ctx").alias("ctx"), "sym", "cnt")


def loo(spark, sf):
    return I.leave_one_out_bits(distinct_payloads(spark, sf), "message_hash", "raw_bytes", 8)


#: Leave-one-out bits in SQL. Symbols seen after a longer context are seen after its suffix too, so the symbols excluded at an order are those of the order above.
_BITS = _DISTINCT + f""",
    sy AS MATERIALIZED (SELECT message_hash, p, {_HEX} AS s FROM b),
    cx AS MATERIALIZED (SELECT d.message_hash, p, o, substr(h, 2 * (p - o) - 1, 2 * o) AS ctx, s FROM d JOIN sy USING (message_hash), generate_series(0, 8) AS k(o) WHERE o < p),
    al AS (SELECT o, ctx, s, count(*) AS c FROM cx GROUP BY ALL),
    ow AS (SELECT message_hash, o, ctx, s, count(*) AS c FROM cx GROUP BY ALL),
    nd AS (SELECT w.message_hash, w.o, w.ctx, al.s, al.c - coalesce(ow.c, 0) AS n FROM (SELECT DISTINCT message_hash, o, ctx FROM cx) w JOIN al USING (o, ctx) LEFT JOIN ow ON ow.message_hash = w.message_hash AND ow.o = w.o AND ow.ctx = w.ctx AND ow.s = al.s WHERE al.c > coalesce(ow.c, 0)),
    lv AS MATERIALIZED (SELECT cx.message_hash, cx.p, cx.o, cx.s AS sym, nd.s, nd.n FROM cx JOIN nd USING (message_hash, o, ctx)),
    fr AS (SELECT l.message_hash, l.p, l.o, l.sym, sum(l.n) AS t, count(*) AS q, max(CASE WHEN l.s = l.sym THEN l.n END) AS c FROM lv l WHERE NOT EXISTS (SELECT 1 FROM lv u WHERE u.message_hash = l.message_hash AND u.p = l.p AND u.o = l.o + 1 AND u.s = l.s) GROUP BY ALL),
    st AS (SELECT *, max(CASE WHEN c IS NOT NULL THEN o END) OVER (PARTITION BY message_hash, p) AS hit FROM fr),
    po AS (SELECT message_hash, p, sum(CASE WHEN c IS NOT NULL THEN -log2(c / (t + q)) ELSE -log2(q / (t + q)) END) AS b, max(hit) AS hit FROM st WHERE hit IS NULL OR o >= hit GROUP BY 1, 2),
    zr AS (SELECT message_hash, p, count(*) AS known FROM lv WHERE o = 0 GROUP BY 1, 2),
    ps AS (SELECT sy.message_hash, coalesce(b, 0) + CASE WHEN hit IS NULL THEN log2(256 - coalesce(known, 0)) ELSE 0 END AS b FROM sy LEFT JOIN po USING (message_hash, p) LEFT JOIN zr USING (message_hash, p)),
    bits AS (SELECT message_hash, sum(b) AS bits FROM ps GROUP BY 1)
"""


@R.query("leave_one_out_bits", _BITS + "SELECT message_hash, round(bits, 6) AS bits FROM bits")
def leave_one_out_bits(spark, sf):
    return loo(spark, sf).withColumn("bits", F.round("bits", 6))


@R.query(
    "leave_one_out_summary",
    _BITS + "SELECT count(*) AS payloads, round(avg(bits), 6) AS mean, round(stddev_samp(bits), 6) AS std, round(min(bits), 6) AS least, round(max(bits), 6) AS most, round(quantile_cont(bits, 0.1), 6) AS p10, round(quantile_cont(bits, 0.5), 6) AS p50, round(quantile_cont(bits, 0.9), 6) AS p90 FROM bits",
)
def leave_one_out_summary(spark, sf):
    b = stage(loo(spark, sf))
    s = b.agg(F.count(F.lit(1)).alias("payloads"), F.avg("bits").alias("mean"), F.stddev_samp("bits").alias("std"), F.min("bits").alias("least"), F.max("bits").alias("most"))
    q = stats.exact_quantiles(b, "bits", [0.1, 0.5, 0.9]).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))
    both = s.join(F.broadcast(q))
    return both.select("payloads", *(F.round(c, 6).alias(c) for c in both.columns if c != "payloads"))


@R.query("random_baseline")
def random_baseline(spark, sf):
    """Cost of random payloads over the log's alphabet, as many a corpus as the log has, in 100 corpora."""
    d = stage(distinct_payloads(spark, sf))
    letters = sorted(r["byte"] for r in I.byte_histogram(d, "raw_bytes").collect())  # at most 256
    scored = I.random_bits(spark, 100, d.count(), 22, letters)
    return scored.groupBy("corpus").agg(F.count(F.lit(1)).alias("payloads"), F.avg("bits").alias("mean"), F.stddev_samp("bits").alias("std"))


_SUBSTRINGS = _DISTINCT + """,
    s AS MATERIALIZED (SELECT message_hash, p, l, substr(h, 2 * p - 1, 2 * l) AS w FROM d, generate_series(1, 22) AS g(p), generate_series(6, 22) AS k(l) WHERE p + l <= 23),
    r AS (SELECT w FROM s GROUP BY w HAVING count(DISTINCT message_hash) > 1),
    o AS MATERIALIZED (SELECT * FROM s SEMI JOIN r USING (w)),
    x AS (SELECT DISTINCT w FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS q WHERE q.message_hash = o.message_hash AND q.l = o.l + 1 AND (q.p = o.p OR q.p = o.p - 1)))
    SELECT w AS substring, CAST(length(w) // 2 AS INTEGER) AS length, count(DISTINCT message_hash) AS messages, count(*) AS occurrences FROM o SEMI JOIN x USING (w) GROUP BY w
"""


@R.query("repeated_substrings", _SUBSTRINGS)
def repeated_substrings(spark, sf):
    """The maximal strings of 6 bytes or more that at least two distinct payloads share."""
    s = I.repeated_substrings(distinct_payloads(spark, sf), "message_hash", "raw_bytes", min_length=6)
    return s.select(F.hex("substring").alias("substring"), "length", "messages", "occurrences")


@R.query("shared_substrings", _SUBSTRINGS)
def shared_substrings(spark, sf):
    """The name under which the significance report has :func:`repeated_substrings`."""
    return repeated_substrings(spark, sf)


_SAMPLES = LOG + ", v AS (SELECT prn % 2 AS g, entropy AS v FROM log WHERE entropy IS NOT NULL)"


@R.query(
    "entropy_ks",
    _SAMPLES + ", c AS (SELECT v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM v GROUP BY v), t AS (SELECT sum(a) AS n1, sum(b) AS n2 FROM c), "
    "r AS (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb FROM c), k AS (SELECT max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2, max(abs(ra / n1 - rb / n2)) AS d FROM r, t), l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM k) "
    "SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 6) AS d, round(CASE WHEN d <= 0 THEN 1.0 WHEN d >= 1 THEN 0.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))))) END, 6) AS p_value FROM l",
)
def entropy_ks(spark, sf):
    """Entropies of entities with even and with odd numbers: the Kolmogorov-Smirnov test."""
    k = stats.ks_test(log(spark, sf, "entropy").withColumn("g", F.pmod("prn", F.lit(2))), "entropy", "g", 0, 1)
    return k.select("n1", "n2", F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value"))


@R.query(
    "entropy_rank_sum",
    _SAMPLES + ", c AS (SELECT v, count(*) FILTER (g = 0) AS a, count(*) AS t FROM v GROUP BY v), r AS (SELECT *, sum(t) OVER (ORDER BY v) - (t - 1) / 2 AS rank FROM c), "
    "s AS (SELECT sum(a)::DOUBLE AS n1, sum(t)::DOUBLE - sum(a) AS n2, sum(rank * a) AS r1, sum(t::DOUBLE * t * t - t) AS ties FROM r), "
    "z AS (SELECT *, (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s) "
    f"SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(z, 4) AS z, round(2.0 * {sql_normal_sf('abs(z)')}, 6) AS p_value FROM z",
)
def entropy_rank_sum(spark, sf):
    w = stats.rank_sum_test(log(spark, sf, "entropy").withColumn("g", F.pmod("prn", F.lit(2))), "entropy", "g", 0, 1)
    return w.select("n1", "n2", F.round("z", 4).alias("z"), F.round("p_value", 6).alias("p_value"))


@R.query(
    "message_concentration",
    LOG + ", c AS (SELECT prn, count(DISTINCT message_hash) AS k FROM log WHERE starts_with(ascii_message, 'TEXT') GROUP BY 1), t AS (SELECT sum(k) AS n, count(*) AS m FROM c) "
    "SELECT prn, k, CAST(n AS BIGINT) AS n, round(1.0 / m, 6) AS p FROM c, t",
)
def message_concentration(spark, sf):
    """Texts per entity and the share that chance would give each."""
    t = concentration(spark, sf)
    return t.select("prn", "k", "n", F.round("p", 6).alias("p"))


def concentration(spark, sf):
    c = log(spark, sf, "ascii_message").where(F.startswith("ascii_message", F.lit("TEXT"))).groupBy("prn").agg(F.count_distinct("message_hash").alias("k"))
    return c.join(F.broadcast(c.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("m")))).withColumn("p", 1.0 / F.col("m"))


@R.query(
    "concentration_p_values",
    LOG + ", c AS (SELECT prn, count(DISTINCT message_hash) AS k FROM log WHERE starts_with(ascii_message, 'TEXT') GROUP BY 1), t AS (SELECT CAST(sum(k) AS BIGINT) AS n, 1.0::DOUBLE / count(*) AS p FROM c) "
    f"SELECT prn, k, n, round({sql_binomial_sf('(k - 1)', 'n', 'p')}, 6) AS p_value, round({sql_poisson_sf('(k - 1)', '(n * p)')}, 6) AS poisson_p FROM c, t",
)
def concentration_p_values(spark, sf):
    """How probable so many texts on one entity are by chance."""
    t = concentration(spark, sf)
    return t.select("prn", "k", "n", F.round(stats.binomial_sf(F.col("k") - 1, F.col("n"), F.col("p")), 6).alias("p_value"), F.round(stats.poisson_sf(F.col("k") - 1, F.col("n") * F.col("p")), 6).alias("poisson_p"))


@R.query("entropy_zscores", LOG + ", p AS (SELECT message_hash, max(entropy) AS e FROM log WHERE entropy IS NOT NULL GROUP BY 1), s AS (SELECT avg(e) AS m, stddev_samp(e) AS s FROM p) SELECT message_hash, round((e - m) / s, 5) AS z FROM p, s WHERE abs(e - m) > 1.96 * s")
def entropy_zscores(spark, sf):
    p = log(spark, sf, "entropy").where("entropy is not null").groupBy("message_hash").agg(F.max("entropy").alias("e"))
    s = p.agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("s"))
    return p.join(F.broadcast(s)).where(F.abs(F.col("e") - F.col("m")) > 1.96 * F.col("s")).select("message_hash", F.round((F.col("e") - F.col("m")) / F.col("s"), 5).alias("z"))


@R.query("entropy_peak", LOG + ", b AS (SELECT floor(entropy / 0.5) AS bin, count(*) AS n FROM log WHERE entropy IS NOT NULL GROUP BY 1) SELECT round(max(n) / (sum(n) * 0.5), 6) AS peak_density FROM b")
def entropy_peak(spark, sf):
    return I.peak_density(log(spark, sf, "entropy"), "entropy").select(F.round("peak_density", 6).alias("peak_density"))


_TEXT_BYTES = LOG + f", d AS (SELECT DISTINCT starts_with(ascii_message, 'TEXT') AS t, hex(raw_bytes) AS h FROM log), b AS (SELECT DISTINCT t, substr(h, 2 * p - 1, 2) AS x FROM d, generate_series(1, 22) AS g(p)) "


@R.query("bytes_outside_texts", _TEXT_BYTES + f"SELECT {_HEX} AS byte FROM (SELECT x FROM b WHERE NOT t EXCEPT SELECT x FROM b WHERE t)")
def bytes_outside_texts(spark, sf):
    """Bytes of other payloads that no text payload has."""
    d = log(spark, sf, "raw_bytes", "ascii_message").select(F.startswith("ascii_message", F.lit("TEXT")).alias("t"), "raw_bytes").distinct()
    return I.byte_histogram(d.where("not t"), "raw_bytes").select("byte").join(I.byte_histogram(d.where("t"), "raw_bytes"), "byte", "left_anti")

"""Packed navigation frames: 10 words of 30 bits, most significant bit first, in 38 bytes. All as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

ALL, DATA = 0x3FFFFFFF, 0x3FFFFFC0  # a whole word; its 24 data bits

# The data bits (numbered 1 to 24) of each parity equation, and whether the previous word's bit 29 or 30 joins.
PARITY = [
    ((1, 2, 3, 5, 6, 10, 11, 12, 13, 14, 17, 18, 20, 23), 29),
    ((2, 3, 4, 6, 7, 11, 12, 13, 14, 15, 18, 19, 21, 24), 30),
    ((1, 3, 4, 5, 7, 8, 12, 13, 14, 15, 16, 19, 20, 22), 29),
    ((2, 4, 5, 6, 8, 9, 13, 14, 15, 16, 17, 20, 21, 23), 30),
    ((1, 3, 5, 6, 7, 9, 10, 14, 15, 16, 17, 18, 21, 22, 24), 30),
    ((3, 5, 6, 8, 9, 10, 11, 13, 15, 19, 22, 23, 24), 29),
]
PREAMBLE, SPECIAL_PAGE_SV, SUBFRAME = 0x8B, 55, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: without it, Catalyst would inline the value into each use."""
    return F.transform(F.array(value), body)[0]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def extract_bits(data: Column, start: int, n: int) -> Column:
    """n bits (at most 48) from bit ``start`` (0 is the most significant) of a binary, as a long."""
    byte, off = divmod(start, 8)
    size = (off + n + 7) // 8
    window = F.conv(F.hex(F.substring(data, byte + 1, size)), 16, 10).cast("long")
    return F.shiftright(window, 8 * size - off - n).bitwiseAND(_long((1 << n) - 1))


def word(frame: Column, k: int) -> Column:
    """Word k (1 to 10) of a frame."""
    return extract_bits(frame, 30 * (k - 1), 30)


def words(frame: Column) -> Column:
    """All ten words, as an array of longs."""
    return F.array(*(word(frame, k) for k in range(1, 11)))


def word_bits(w: Column, first: int, last: int) -> Column:
    """Bits first to last of a word, numbered from 1 at its most significant bit."""
    return F.shiftright(w, 30 - last).bitwiseAND(_long((1 << (last - first + 1)) - 1))


def invert_bits(v: Column, n: int) -> Column:
    return v.bitwiseXOR(_long((1 << n) - 1))


def parity_bits(w: Column, d29: Column, d30: Column) -> Column:
    """The six parity bits of a word after a word that ends in bits d29 and d30 (longs 0 or 1)."""
    out = []
    for i, (bits, star) in enumerate(PARITY):
        mask = sum(1 << (30 - b) for b in bits)
        odd = (F.bit_count(w.bitwiseAND(_long(mask))).cast("long") + (d29 if star == 29 else d30)).bitwiseAND(_long(1))
        out.append(F.shiftleft(odd, 5 - i))
    return reduce(lambda a, b: a + b, out)


def parity_ok(w: Column, d29: Column, d30: Column) -> Column:
    return w.bitwiseAND(_long(63)) == parity_bits(w, d29, d30)


def with_parity(w: Column, d29: Column, d30: Column) -> Column:
    data = w.bitwiseAND(_long(DATA))
    return data + parity_bits(data, d29, d30)


def _bit(w: Column, from_low: int) -> Column:
    return F.shiftright(w, from_low).bitwiseAND(_long(1))


def clean_words(ws: Column, inverted: Column, complemented: bool) -> Column:
    """Words as sent: un-inverted, and with ``complemented`` also with data bits turned back after a word that ends in 1.

    Turning back never touches bits 25 to 30, so each word needs only the stored word before it.
    """
    flip = F.when(inverted, _long(ALL)).otherwise(_long(0))
    up = F.transform(ws, lambda w: w.bitwiseXOR(flip))
    if not complemented:
        return up
    return let(up, lambda u: F.transform(u, lambda w, i: F.when((i > 0) & (_bit(F.get(u, i - 1), 0) == 1), w.bitwiseXOR(_long(DATA))).otherwise(w)))


def message_parity_ok(ws: Column, inverted: Column, complemented: bool) -> Column:
    """Whether words 2 to 10 have valid parity; word 1 only seeds the chain."""
    return let(
        clean_words(ws, inverted, complemented),
        lambda u: F.forall(F.sequence(F.lit(1), F.lit(9)), lambda i: let(F.get(u, i - 1), lambda before: parity_ok(F.get(u, i), _bit(before, 1), _bit(before, 0)))),
    )


def handover(w2: Column, seconds: Column | None = None) -> Column:
    """struct(subframe_id, alert_flag, tow, inverted) of word 2.

    With the second of the day, a frame counts as inverted if only the complemented time of week fits it.
    """
    tow, alert, sub = word_bits(w2, 1, 17), word_bits(w2, 18, 18), word_bits(w2, 20, 22)
    at = lambda t: F.pmod(t * 6 - 6, _long(86_400))
    inverted = F.lit(False) if seconds is None else F.coalesce((at(tow) != seconds) & (at(invert_bits(tow, 17)) == seconds), F.lit(False))
    return F.struct(
        F.when(inverted, invert_bits(sub, 3)).otherwise(sub).cast("int").alias("subframe_id"),
        (alert == F.when(inverted, 0).otherwise(1)).alias("alert_flag"),
        F.when(inverted, invert_bits(tow, 17)).otherwise(tow).cast("int").alias("tow"),
        inverted.alias("inverted"),
    )


def sv_id(w3: Column, inverted: Column) -> Column:
    raw = word_bits(w3, 3, 8)
    return F.when(inverted, invert_bits(raw, 6)).otherwise(raw).cast("int")


def payload(clean: Column) -> Column:
    """The 22 message bytes of clean words: bits 9-24 of word 3, 1-24 of words 4 to 9, 1-16 of word 10."""
    part = lambda i, a, b: F.lpad(F.hex(word_bits(F.get(clean, F.lit(i - 1)), a, b)), (b - a + 1) // 4, "0")
    return F.unhex(F.concat(part(3, 9, 24), *(part(i, 1, 24) for i in range(4, 10)), part(10, 1, 16)))


def may_be_special(frame: Column) -> Column:
    """Cheap native test that special-message frames of any polarity pass; most other frames fail it. Filter by it first."""
    w3 = word_bits(word(frame, 3), 3, 8)
    return word_bits(word(frame, 2), 20, 22).isin(SUBFRAME, SUBFRAME ^ 7) & w3.isin(SPECIAL_PAGE_SV, SPECIAL_PAGE_SV ^ 63)


def parse_frame(frame: Column, seconds: Column | None = None) -> Column:
    """struct(subframe_id, page_number, sv_id, alert_flag, tow, inverted, parity_ok, payload) of a frame.

    ``page_number`` is 17 for special messages, of which ``payload`` has the bytes. Their direct reading is
    confirmed by parity; else by parity with complementing and the SV id of that reading; else by a plausible
    preamble. A reading of the SV id's complement needs parity with complementing. ``parity_ok`` tells whether
    either parity holds. A frame that is null or not 38 bytes gives null.
    """

    def of(ws: Column) -> Column:
        return let(
            F.struct(ws.alias("ws"), handover(F.get(ws, F.lit(1)), seconds).alias("how")),
            lambda x: let(
                F.struct(
                    x["how"].alias("how"),
                    sv_id(F.get(x["ws"], F.lit(2)), x["how"]["inverted"]).alias("sv"),
                    clean_words(x["ws"], x["how"]["inverted"], False).alias("plain"),
                    clean_words(x["ws"], x["how"]["inverted"], True).alias("turned"),
                    message_parity_ok(x["ws"], x["how"]["inverted"], False).alias("ok"),
                    message_parity_ok(x["ws"], x["how"]["inverted"], True).alias("turned_ok"),
                    F.shiftright(F.get(x["ws"], F.lit(0)), 22).isin(PREAMBLE, PREAMBLE ^ 0xFF).alias("preamble"),
                ),
                decide,
            ),
        )

    def decide(y: Column) -> Column:
        paged = y["how"]["subframe_id"] == SUBFRAME
        turned_sv = word_bits(F.get(y["turned"], F.lit(2)), 3, 8) == SPECIAL_PAGE_SV
        direct = paged & (y["sv"] == SPECIAL_PAGE_SV) & F.when(y["ok"], True).when(y["turned_ok"], turned_sv).otherwise(y["preamble"])
        alias = paged & (y["sv"] == (SPECIAL_PAGE_SV ^ 63)) & turned_sv & y["turned_ok"]
        special = direct | alias
        return F.struct(
            y["how"]["subframe_id"].alias("subframe_id"),
            F.when(special, 17).alias("page_number"),
            F.when(y["how"]["subframe_id"].isin(4, 5), F.when(alias, SPECIAL_PAGE_SV).otherwise(y["sv"])).alias("sv_id"),
            y["how"]["alert_flag"].alias("alert_flag"),
            y["how"]["tow"].alias("tow"),
            y["how"]["inverted"].alias("inverted"),
            (y["ok"] | y["turned_ok"]).alias("parity_ok"),
            F.when(special, F.when(~y["ok"] & y["turned_ok"], payload(y["turned"])).otherwise(payload(y["plain"]))).alias("payload"),
        )

    return F.when(F.octet_length(frame) == 38, let(words(frame), of))


def pack_words(ws: Column) -> Column:
    """Ten words as the 38 bytes of a frame; bits above the 30 of a word are ignored."""

    def hexed(u: Column) -> Column:
        w = lambda i: F.get(u, F.lit(i)).bitwiseAND(_long(ALL))
        return F.concat(*(F.lpad(F.hex(F.shiftleft(w(i), 30) + w(i + 1)), 15, "0") for i in range(0, 10, 2)), F.lit("0"))

    return F.unhex(let(ws, hexed))


def encode_frame(message: Column, tow: Column, alert: Column | None = None, complemented: Column | bool = False, inverted: Column | bool = False) -> Column:
    """A special-message frame of 22 bytes with valid parity; optionally with data bits complemented after a 1, or all bits inverted."""
    complemented, inverted = (F.lit(x) if isinstance(x, bool) else x for x in (complemented, inverted))
    bits = lambda start, n: extract_bits(message, start, n)
    alert_bit = _long(0) if alert is None else F.when(alert, _long(1)).otherwise(_long(0))
    data = [
        _long(PREAMBLE << 22),
        F.shiftleft(tow.cast("long"), 13) + F.shiftleft(alert_bit, 12) + _long(SUBFRAME << 8),
        _long((1 << 28) + (SPECIAL_PAGE_SV << 22)) + F.shiftleft(bits(0, 16), 6),
        *(F.shiftleft(bits(16 + 24 * i, 24), 6) for i in range(6)),
        F.shiftleft(bits(160, 16), 14),
    ]
    empty = F.expr("cast(array() as array<bigint>)")
    last = lambda acc, b: F.coalesce(_bit(F.try_element_at(acc, F.lit(-1)), b), _long(0))
    ws = F.aggregate(F.array(*data), empty, lambda acc, d: F.concat(acc, F.array(with_parity(d, last(acc, 1), last(acc, 0)))))
    # complementing is its own inverse
    sent = let(ws, lambda u: F.when(complemented, clean_words(u, F.lit(False), True)).otherwise(u))
    flip = F.when(inverted, _long(ALL)).otherwise(_long(0))
    return pack_words(F.transform(sent, lambda w: w.bitwiseXOR(flip)))

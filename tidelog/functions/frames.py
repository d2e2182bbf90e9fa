"""The frames of :mod:`tidelog.functions.bits` in bulk: whole Arrow batches as NumPy matrices, for tables with many frames.

``bits`` says the same in column expressions, which Spark evaluates element by element; the tests hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidelog.functions.bits import ALL, DATA, PARITY, PREAMBLE, SPECIAL_PAGE_SV, SUBFRAME

_WEIGHTS = 1 << np.arange(29, -1, -1)
_MASKS = [(sum(1 << (30 - b) for b in places), 1 if star == 29 else 0) for places, star in PARITY]
PARSED = "subframe_id int, page_number int, sv_id int, alert_flag boolean, tow int, inverted boolean, parity_ok boolean, payload binary"


def matrix(data: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which binaries have ``width`` bytes, and these as rows."""
    rows = data.to_pylist()
    fits = np.array([r is not None and len(r) == width for r in rows], bool)
    return fits, np.frombuffer(b"".join(r for r, ok in zip(rows, fits) if ok), np.uint8).reshape(-1, width)


def words_of(frames: np.ndarray) -> np.ndarray:
    """(n, 10) words of (n, 38) bytes."""
    return np.unpackbits(frames, axis=1)[:, :300].reshape(-1, 10, 30) @ _WEIGHTS


def frames_of(words: np.ndarray) -> np.ndarray:
    """(n, 38) bytes of (n, 10) words."""
    bits = ((words[:, :, None] >> np.arange(29, -1, -1)) & 1).astype(np.uint8).reshape(-1, 300)
    return np.packbits(bits, axis=1)


def parity_of(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The six parity bits of words after those in ``before``."""
    out = np.zeros(words.shape, np.int64)
    for mask, star in _MASKS:
        out = (out << 1) | ((np.bitwise_count(words & mask).astype(np.int64) + (before >> star)) & 1)
    return out


def turn_back(words: np.ndarray) -> np.ndarray:
    """Words with data bits complemented after a word that ends in 1."""
    out = words.copy()
    out[:, 1:] ^= np.where(words[:, :-1] & 1, DATA, 0)
    return out


def sound(words: np.ndarray) -> np.ndarray:
    """Whether words 2 to 10 have valid parity."""
    return ((words[:, 1:] & 63) == parity_of(words[:, 1:] & DATA, words[:, :-1])).all(1)


def payloads_of(words: np.ndarray) -> np.ndarray:
    """(n, 22) message bytes of clean words."""
    parts = [(words[:, 2] >> 6, 2), *((words[:, i] >> 6, 3) for i in range(3, 9)), (words[:, 9] >> 14, 2)]
    return np.stack([(w >> (8 * k)) & 0xFF for w, size in parts for k in range(size - 1, -1, -1)], 1).astype(np.uint8)


def parse(frames: np.ndarray, seconds: np.ndarray | None) -> dict[str, np.ndarray]:
    """The fields of :func:`tidelog.functions.bits.parse_frame` for (n, 38) bytes; ``seconds`` is -1 where unknown."""
    ws = words_of(frames)
    tow = (ws[:, 1] >> 13) & 0x1FFFF
    at = lambda t: (t * 6 - 6) % 86_400
    inverted = np.zeros(len(ws), bool) if seconds is None else (seconds >= 0) & (at(tow) != seconds) & (at(tow ^ 0x1FFFF) == seconds)
    plain = ws ^ np.where(inverted, ALL, 0)[:, None]
    turned = turn_back(plain)
    ok, turned_ok = sound(plain), sound(turned)
    subframe, sv = (plain[:, 1] >> 8) & 7, (plain[:, 2] >> 22) & 63
    turned_sv = ((turned[:, 2] >> 22) & 63) == SPECIAL_PAGE_SV
    preamble = np.isin(ws[:, 0] >> 22, (PREAMBLE, PREAMBLE ^ 0xFF))
    direct = (subframe == SUBFRAME) & (sv == SPECIAL_PAGE_SV) & np.where(ok, True, np.where(turned_ok, turned_sv, preamble))
    alias = (subframe == SUBFRAME) & (sv == (SPECIAL_PAGE_SV ^ 63)) & turned_sv & turned_ok
    clean = np.where((~ok & turned_ok)[:, None], turned, plain)
    # an inverted frame's alert bit is inverted too
    return {"subframe_id": subframe, "special": direct | alias, "sv_id": np.where(alias, SPECIAL_PAGE_SV, sv), "alert_flag": ((plain[:, 1] >> 12) & 1) == 1, "tow": (plain[:, 1] >> 13) & 0x1FFFF, "inverted": inverted, "parity_ok": ok | turned_ok, "payload": payloads_of(clean)}


def _parsed(data: pa.Array, second: pa.Array) -> pa.Array:
    """The structs of one batch."""
    fits, frames = matrix(data, 38)
    got = parse(frames, second.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)[fits])
    spread = np.full(len(fits), -1)
    spread[fits] = np.arange(len(frames))
    at = pa.array(spread, mask=~fits)
    column = lambda values, kind, keep=None: pa.array(values, kind, mask=None if keep is None else ~keep).take(at)
    bodies = pa.FixedSizeBinaryArray.from_buffers(pa.binary(22), len(frames), [None, pa.py_buffer(np.ascontiguousarray(got["payload"]).tobytes())]).cast(pa.binary())
    special = got["special"]
    fields = [
        column(got["subframe_id"], pa.int32()), column(np.full(len(frames), 17), pa.int32(), special), column(got["sv_id"], pa.int32(), np.isin(got["subframe_id"], (4, 5))), column(got["alert_flag"], pa.bool_()),
        column(got["tow"], pa.int32()), column(got["inverted"], pa.bool_()), column(got["parity_ok"], pa.bool_()), bodies.take(pa.array(np.where(special, np.arange(len(frames)), 0), mask=~special)).take(at),
    ]
    return pa.StructArray.from_arrays(fields, [f.split()[0] for f in PARSED.split(", ")], mask=pa.array(~fits))


def with_parsed(df: DataFrame, frame: str, seconds: str | None = None, name: str = "f") -> DataFrame:
    """``df`` with a struct ``name`` of what :func:`tidelog.functions.bits.parse_frame` reads, over whole batches; null for a frame that is null or not 38 bytes."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StructType.fromDDL(PARSED))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            second = pa.nulls(b.num_rows, pa.int64()) if seconds is None else b.column(names.index(seconds))
            yield pa.RecordBatch.from_arrays([*b.columns, _parsed(b.column(names.index(frame)), second)], names)

    return df.mapInArrow(run, schema)


def encode_frames(message: Column, tow: Column, alert: Column | None = None, complemented: Column | bool = False, inverted: Column | bool = False, sv: Column | int = SPECIAL_PAGE_SV, subframe: Column | int = SUBFRAME, turned_bit: Column | int = -1) -> Column:
    """:func:`tidelog.functions.bits.encode_frame` over whole batches, also for other satellites' pages and subframes.

    ``turned_bit`` is the number of a bit to damage after encoding, -1 for none. A message that is null or not
    22 bytes gives null.
    """
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")

    @F.arrow_udf("binary")
    def of(data: pa.Array, tows: pa.Array, alerts: pa.Array, turn: pa.Array, flip: pa.Array, svs: pa.Array, subs: pa.Array, damage: pa.Array) -> pa.Array:
        fits, m = matrix(data, 22)
        get = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False)[fits].astype(np.int64)
        m = m.astype(np.int64)
        three = lambda k: (m[:, k] << 16 | m[:, k + 1] << 8 | m[:, k + 2]) << 6
        head = [np.full(len(m), PREAMBLE << 22), (get(tows) & 0x1FFFF) << 13 | get(alerts) << 12 | get(subs) << 8, 1 << 28 | get(svs) << 22 | (m[:, 0] << 8 | m[:, 1]) << 6]
        words = np.stack([*head, *(three(2 + 3 * i) for i in range(6)), (m[:, 20] << 8 | m[:, 21]) << 14], 1)
        before = np.zeros(len(m), np.int64)
        for i in range(10):
            words[:, i] |= parity_of(words[:, i], before)
            before = words[:, i]
        words = np.where(get(turn)[:, None] == 1, turn_back(words), words) ^ np.where(get(flip) == 1, ALL, 0)[:, None]
        out = frames_of(words)
        bit = get(damage)
        hit = np.flatnonzero(bit >= 0)
        out[hit, bit[hit] // 8] ^= (128 >> (bit[hit] % 8)).astype(np.uint8)
        frames = iter(out)
        return pa.array([next(frames).tobytes() if ok else None for ok in fits], pa.binary())

    return of(message, *map(number, (tow, False if alert is None else alert, complemented, inverted, sv, subframe, turned_bit)))

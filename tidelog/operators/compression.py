"""Leave-one-out cost of payloads under a compression model of contexts (PPM), over contexts in sorted order."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.session import cluster, stage

#: Orders that a context's bytes as one 64-bit number can hold.
MOST_ORDERS = 8
_SIGN = np.uint64(1 << 63)


def descend(symbol: int, walk: Iterable[tuple[dict, dict]], seen: set) -> tuple[float, bool]:
    """(bits, found): the cost of a symbol down the contexts of ``walk``, longest first, as (counts, own counts).

    Adds the symbols passed over to ``seen``; a context that only the payload itself has is skipped.
    """
    out = 0.0
    for counts, own in walk:
        left = {s: n for s, c in counts.items() if s not in seen and (n := c - own.get(s, 0)) > 0}
        if not left:
            continue
        whole = sum(left.values()) + len(left)
        if symbol in left:
            return out - math.log2(left[symbol] / whole), True
        out -= math.log2(len(left) / whole)
        seen.update(left)
    return out, False


def evenly(seen: set, vocabulary: int) -> float:
    """The cost of a symbol that no context predicts: even among the rest of the vocabulary."""
    rest = vocabulary - len(seen)
    return math.log2(rest if rest > 0 else vocabulary)


def walk_bits(symbol: int, walk: list[tuple[list, list, list, list]], vocabulary: int = 256) -> float:
    """-log2 of one symbol's probability from (symbols, counts, own symbols, own counts) of its contexts, longest first."""
    seen: set = set()
    bits, found = descend(symbol, ((dict(zip(s, c)), dict(zip(o, n))) for s, c, o, n in walk), seen)
    return bits if found else bits + evenly(seen, vocabulary)


def context_arrays(payloads: list[bytes], orders: int) -> tuple[np.ndarray, ...]:
    """(payload, position, symbol, length, context) of every byte: its context of ``length`` bytes, the last byte foremost, as an unsigned number."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    owner = np.repeat(np.arange(len(payloads)), sizes)
    pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context = np.zeros(len(data), np.uint64)
    for j in range(orders):
        at = np.flatnonzero(pos > j)
        context[at] |= data[at - 1 - j].astype(np.uint64) << np.uint64(8 * (7 - j))
    return owner, pos, data.astype(np.int64), np.minimum(pos, orders), context


def prefix(context: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes before a symbol, as a number."""
    return context >> np.uint64(64 - 8 * order) if order else np.zeros_like(context)


def common_orders(context: np.ndarray, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The greatest order at which a context is that of a mark next to its bucket; -1 where there are no marks."""
    depth = np.full(len(context), -1)
    for side in (bucket - 1, bucket):
        at = np.flatnonzero((side >= 0) & (side < len(marks)))
        apart = context[at] ^ marks[side[at]]
        for order in range(MOST_ORDERS + 1):
            same = at[prefix(apart, order) == 0]
            depth[same] = np.maximum(depth[same], order)
    return depth


def _tally(*columns: np.ndarray) -> tuple[list[list], list[int]]:
    """Distinct rows of some columns, column by column, and how often each occurs."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, at = np.unique(c, return_inverse=True)
        code = np.unique(code * len(values) + at, return_inverse=True)[1]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return [c[first].tolist() for c in columns], n.tolist()


def leave_one_out_bits(payloads: DataFrame, payload_id: str, data: str, max_order: int = 8, vocabulary: int = 256, model: str | None = None, bucket_rows: int = 20_000, most_buckets: int = 2000) -> DataFrame:
    """(id, bits): the cost of each payload under the model of all others; an empty or null payload costs 0.

    PPM with escapes: from the longest context down, a symbol seen c times among T of q distinct ones has
    c / (T + q), the escape q / (T + q); symbols that a longer context has seen are excluded. A payload's own
    occurrences are taken off the counts of its contexts. Beyond order 0 the rest of the vocabulary is uniform.
    With a column ``model``, payloads of each model are scored against those of the same; it is put out too.

    Every byte is a row with its context, last byte foremost. In the order of these numbers each context of any
    order is one stretch. Quantiles cut the order into buckets of about ``bucket_rows`` rows; a context that no
    cut falls into lies in one bucket whole, with all rows that its counts need. Those that a cut falls into,
    such as the empty one, are at most ``max_order`` + 1 for each cut: their counts are summed up beforehand
    and sent to the tasks, at most 256 for each. Symbols not found in a bucket are looked up there, grouped by
    payload, from which a payload's own counts come. So no context is a hot key, however frequent: rows whose
    context is a cut itself need no bucket. At most ``most_buckets`` cuts are made.
    """
    if not 0 <= max_order <= MOST_ORDERS:
        raise ValueError(f"max_order must be from 0 to {MOST_ORDERS}")
    of = F.col(model).cast("long") if model else F.lit(0).cast("long")
    ids = stage(payloads.select(F.monotonically_increasing_id().alias("u"), of.alias("g"), F.col(payload_id).alias("id"), F.col(data).cast("binary").alias("payload")))
    size = ids.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("n"), F.count_distinct("g").alias("models")).first()
    buckets = min(most_buckets, -(-size["n"] // (bucket_rows * max(1, size["models"]))))
    rows = ids.where("octet_length(payload) > 0").select("u", "g", "payload")
    signed = lambda c: (c ^ _SIGN).view(np.int64)

    def contexts_of(b: pa.RecordBatch):
        owner, pos, sym, length, context = context_arrays(b.column(2).to_pylist(), max_order)
        u, g = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return u[owner], g[owner], pos, sym, length, context

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(contexts_of(b)[-1]))], ["context"])

    marks = np.zeros(0, np.uint64)
    if buckets > 1:
        cuts = rows.mapInArrow(keys, "context bigint").agg(F.percentile_approx("context", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("m")).first()["m"]  # at most most_buckets numbers
        marks = np.unique(np.array(cuts, np.int64)).view(np.uint64) ^ _SIGN
        marks.sort()

    def placed(b: pa.RecordBatch):
        u, g, pos, sym, length, context = contexts_of(b)
        bucket = np.searchsorted(marks, context)
        return u, g, pos, sym, length, context, bucket, np.minimum(common_orders(context, bucket, marks), length)

    def cut_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, g, _, sym, _, context, _, depth = placed(b)
            for order in range(max_order + 1):
                at = depth >= order
                (of, ctx, symbols), n = _tally(g[at], prefix(context[at], order).view(np.int64), sym[at])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([order] * len(n), pa.int32()), pa.array(ctx, pa.int64()), pa.array(symbols, pa.int32()), pa.array(n, pa.int64())], ["g", "ord", "ctx", "sym", "cnt"])

    cut: dict[tuple, dict[int, int]] = {}
    if len(marks):  # counts of at most (max_order + 1) contexts a cut and model
        for r in rows.mapInArrow(cut_counts, "g bigint, ord int, ctx bigint, sym int, cnt bigint").groupBy("g", "ord", "ctx", "sym").agg(F.sum("cnt").alias("cnt")).toLocalIterator():
            cut.setdefault((r["g"], r["ord"], r["ctx"]), {})[r["sym"]] = r["cnt"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, g, pos, sym, length, context, bucket, depth = placed(b)
            bucket = np.where(depth == length, -1, bucket)  # all orders are those of a cut
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(bucket), pa.array(signed(context)), pa.array(length), pa.array(u), pa.array(pos), pa.array(sym), pa.array(depth)], ["g", "bucket", "context", "length", "u", "pos", "sym", "depth"])

    every = rows.mapInArrow(spread, "g bigint, bucket bigint, context bigint, length bigint, u bigint, pos bigint, sym bigint, depth bigint")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            yield _score_bucket(t, max_order, vocabulary)

    tasks = max(1, min(10_000, 4 * buckets * max(1, size["models"])))  # rows are small and cost far more than their bytes say, so Spark must not put them together
    parts = cluster(every.where("bucket >= 0"), ["g", "bucket"], ["context"], tasks).mapInArrow(score, "u bigint, bits double, pos bigint, start bigint, seen binary")
    if len(marks):
        whole = every.where("bucket < 0").select("u", F.lit(0.0).alias("bits"), "pos", F.col("depth").alias("start"), F.lit(b"").alias("seen"))
        parts = parts.unionByName(whole)
    open_row = F.when(F.col("pos").isNotNull(), F.struct("pos", "start", "seen"))
    cost = parts.repartition(tasks, "u").groupBy("u").agg(F.sum("bits").alias("bits"), F.collect_list(open_row).alias("open"))  # a payload's positions

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models, payload, bits, rest = (c.to_pylist() for c in b.columns[1:5])
            for i, x in _rest_bits(models, payload, rest, cut, max_order, vocabulary):
                bits[i] += x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.float64())], ["u", "bits"])

    if len(marks):
        cost = ids.select("u", "g", "payload").repartition(tasks, "u").join(cost, "u").select("u", "g", "payload", "bits", "open").mapInArrow(finish, "u bigint, bits double")
    out = ids.select("u", "g", "id").join(cost.select("u", "bits"), "u", "left")
    return out.select(*([F.col("g").cast(payloads.schema[model].dataType).alias(model)] if model else []), F.col("id").alias(payload_id), F.coalesce("bits", F.lit(0.0)).alias("bits"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (g, bucket) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g, bucket = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(ends, ends[1:]):
            if held and (held[-1].column(0)[0], held[-1].column(1)[0]) != (b.column(0)[a], b.column(1)[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _score_bucket(t: pa.Table, max_order: int, vocabulary: int) -> pa.RecordBatch:
    """Walk the contexts that lie in one bucket whole; what they don't find stays open at ``depth``, the longest that a cut falls into."""
    context, length, u, pos, sym, depth = (t.column(i).to_numpy() for i in range(2, 8))
    context = context.view(np.uint64) ^ _SIGN
    walks: list[list[tuple[dict, dict]]] = [[] for _ in range(len(u))]
    for order in range(max_order, -1, -1):
        at = np.flatnonzero((length >= order) & (depth < order))
        if not len(at):
            continue
        p = prefix(context[at], order)
        node = np.cumsum(np.r_[False, p[1:] != p[:-1]])  # sorted by context
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        shared = np.minimum.reduceat(u[at], starts) != np.maximum.reduceat(u[at], starts)  # a payload alone has nothing to learn from
        keep = shared[node]
        at, node = at[keep], node[keep]
        counts: dict[int, dict] = {}
        columns, times = _tally(node, sym[at])
        for n, s, c in zip(*columns, times):
            counts.setdefault(n, {})[s] = c
        own: dict[tuple, dict] = {}
        columns, times = _tally(node, u[at], sym[at])
        for n, x, s, c in zip(*columns, times):
            own.setdefault((n, x), {})[s] = c
        for i, n, x in zip(at.tolist(), node.tolist(), u[at].tolist()):
            walks[i].append((counts[n], own[n, x]))
    bits: dict[int, float] = {}
    rest: list[tuple] = []
    for x, i, s, d, walk in zip(u.tolist(), pos.tolist(), sym.tolist(), depth.tolist(), walks):
        seen: set = set()
        cost, found = descend(s, walk, seen)
        if not found:
            if d < 0:
                cost += evenly(seen, vocabulary)
            else:
                rest.append((x, 0.0, i, d, bytes(sorted(seen))))
        bits[x] = bits.get(x, 0.0) + cost
    rows = [(x, b, None, None, None) for x, b in bits.items()] + rest
    kinds = [("u", pa.int64()), ("bits", pa.float64()), ("pos", pa.int64()), ("start", pa.int64()), ("seen", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))


def _rest_bits(models: list[int], payloads: list[bytes], rows: list[list[dict]], cut: dict, max_order: int, vocabulary: int) -> Iterator[tuple[int, float]]:
    """(payload, bits): the rest of the cost of open positions, from the contexts that cuts fall into, of order ``start`` and less."""
    which = [i for i, r in enumerate(rows) if r]
    if not which:
        return
    owner, _, sym, length, context = context_arrays([payloads[i] for i in which], max_order)
    first = np.cumsum([0, *(len(payloads[i]) for i in which)]).tolist()
    of, symbols, own, keys = owner.tolist(), sym.tolist(), [], []
    for order in range(max(r["start"] for i in which for r in rows[i]) + 1):
        p = prefix(context, order).view(np.int64).tolist()
        mine: dict[tuple, dict[int, int]] = {}
        for i in np.flatnonzero(length >= order).tolist():
            at = mine.setdefault((of[i], p[i]), {})
            at[symbols[i]] = at.get(symbols[i], 0) + 1
        own.append(mine)
        keys.append(p)
    for k, i in enumerate(which):
        for r in rows[i]:
            at, seen = first[k] + r["pos"], set(r["seen"])
            walk = ((cut[models[i], o, keys[o][at]], own[o][k, keys[o][at]]) for o in range(r["start"], -1, -1))
            cost, found = descend(symbols[at], walk, seen)
            yield i, cost if found else cost + evenly(seen, vocabulary)

"""Leave-one-out cost of random corpora, drawn where they are scored, so that neither payloads nor contexts are shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.operators.compression import MOST_ORDERS

#: Contexts that a task holds at once; more are taken in several passes over the corpus, which is drawn again each time.
PASS_ROWS = 1 << 23
#: Payloads of a corpus that a task scores; a larger corpus is scored by several tasks, each of which counts it whole.
SHARE = 1 << 23
#: Contexts that are looked at together; a context's last byte keeps them together, however many there are.
_GROUP_ROWS = 1 << 15


def draw_block(alphabet: list[int], length: int, seed: int, corpus: int, k: int, rows: int) -> np.ndarray:
    """The k-th block of a corpus, a payload in each row; every block has its own random stream."""
    letters = np.array(alphabet, np.uint8)
    return letters[np.random.default_rng([seed, corpus, k]).integers(0, len(letters), (rows, length))]


def random_bits(spark: SparkSession, corpora: int, per_corpus: int, length: int, alphabet: list[int], max_order: int = 8, vocabulary: int = 256, seed: int = 42, block: int = 1000, pass_rows: int = PASS_ROWS, share: int = SHARE) -> DataFrame:
    """(corpus, n, bits): what ``leave_one_out_bits`` gives for ``random_payloads``, each scored against those of its corpus.

    A task draws a corpus, counts its contexts and scores at most ``share`` of its payloads. What it holds is
    bounded by ``pass_rows`` and ``share``: contexts are taken by their last byte, about ``pass_rows`` at once.
    """
    if not 0 <= max_order <= MOST_ORDERS:
        raise ValueError(f"max_order must be from 0 to {MOST_ORDERS}")
    shares = max(1, -(-per_corpus // share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, part in (divmod(i, shares) for i in b.column(0).to_pylist()):
                first, last = per_corpus * part // shares, per_corpus * (part + 1) // shares

                def blocks(c=c) -> Iterator[tuple[int, np.ndarray]]:
                    for k, at in enumerate(range(0, per_corpus, block)):
                        yield at, draw_block(alphabet, length, seed, c, k, min(block, per_corpus - at))

                bits = corpus_bits(blocks, first, last, length, max_order, vocabulary, pass_rows)
                for at in range(0, len(bits), 100_000):
                    out = bits[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), c)), pa.array(np.arange(first + at, first + at + len(out))), pa.array(out)], ["corpus", "n", "bits"])

    return spark.range(0, corpora * shares, 1, corpora * shares).mapInArrow(score, "corpus bigint, n bigint, bits double")


def corpus_bits(blocks, first: int, last: int, length: int, max_order: int, vocabulary: int, pass_rows: int = PASS_ROWS) -> np.ndarray:
    """The costs of the payloads ``first`` to ``last`` of a corpus; ``blocks()`` goes over it as (number of the first payload, payloads)."""
    bits = np.zeros(last - first)
    totals, ends = np.zeros(256, np.int64), np.zeros(256, np.int64)
    kept: list | None = []
    for at, x in blocks():
        totals += np.bincount(x.ravel(), minlength=256)
        ends += np.bincount(x[:, :-1].ravel(), minlength=256)
        if kept is not None:
            kept.append((at, x))
            if totals.sum() > pass_rows:  # too large to be kept, so it is drawn again
                kept = None
    again = (lambda: kept) if kept is not None else blocks

    rest: list[tuple] = []
    for letters in _parts(ends, pass_rows) if max_order else []:
        for u, b, open_rows in _pass_bits(again(), letters, ends, first, last, max_order):
            np.add.at(bits, u - first, b)
            rest.append(open_rows)
    if max_order:
        u, pos, seen = (np.concatenate(c) for c in zip(*rest)) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 32), np.uint8))
        order = np.argsort(u, kind="stable")
        u, pos, seen = u[order], pos[order], seen[order]
    for at, x in again():
        a, z = max(at, first), min(at + len(x), last)
        if a >= z or not length:
            continue
        own = x[a - at : z - at]
        if not max_order:
            who, where = (c.ravel() for c in np.indices(own.shape))
            bits[a - first : z - first] += np.bincount(who, _even_bits(own, who, where, np.zeros((len(who), 256), bool), totals, vocabulary), z - a)
            continue
        bits[a - first : z - first] += _even_bits(own, np.arange(z - a), np.zeros(z - a, np.int64), None, totals, vocabulary)
        i, j = np.searchsorted(u, [a, z])
        if i < j:
            s = np.unpackbits(seen[i:j], axis=1).astype(bool)
            bits[a - first : z - first] += np.bincount(u[i:j] - a, _even_bits(own, u[i:j] - a, pos[i:j], s, totals, vocabulary), z - a)
    return bits


def _parts(ends: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The bytes that occur, in order, in parts of about ``most`` occurrences."""
    letters = np.flatnonzero(ends)
    part = (np.cumsum(ends[letters]) - 1) // most
    for k in np.unique(part):
        yield letters[part == k]


def _even_bits(x: np.ndarray, who: np.ndarray, pos: np.ndarray, seen: np.ndarray | None, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """The cost at order 0 and below of the symbols at ``pos`` of the payloads ``who``; ``seen``, if any, are the symbols passed over before."""
    rows, of = np.unique(who, return_inverse=True)
    own = np.bincount((np.arange(len(rows))[:, None] * 256 + x[rows]).ravel(), minlength=256 * len(rows)).reshape(-1, 256)
    left = totals - own
    kinds = np.count_nonzero(left, axis=1)[of]
    n = left[of, x[who, pos]]
    if seen is None:
        total, q = left.sum(1)[of], kinds
    else:
        left = np.where(seen, 0, left[of])
        total, q = left.sum(1), np.count_nonzero(left, axis=1)
    rest = np.where(kinds < vocabulary, vocabulary - kinds, vocabulary)
    over = np.maximum(q, 1)  # where no symbol is left, the order is skipped
    return np.where(n > 0, np.log2(np.maximum(total + q, 1)) - np.log2(np.maximum(n, 1)), np.where(q > 0, np.log2(np.maximum(total + q, 1)) - np.log2(over), 0.0) + np.log2(rest))


def _pass_bits(blocks: Iterable[tuple[int, np.ndarray]], letters: np.ndarray, ends: np.ndarray, first: int, last: int, max_order: int) -> Iterator[tuple]:
    """(payloads, bits, open positions) of groups of contexts that end in ``letters``."""
    group, groups = np.full(256, -1, np.int16), 0
    for part in _parts(np.where(np.isin(np.arange(256), letters), ends, 0), _GROUP_ROWS):
        group[part] = groups
        groups += 1
    held: list[tuple] = []
    chunk: list[tuple] = []

    def sort() -> None:
        context, u, pos, sym, g = (np.concatenate(c) for c in zip(*chunk))
        chunk.clear()
        order = np.argsort(g, kind="stable")
        held.append((context[order], u[order], pos[order], sym[order], np.searchsorted(g[order], np.arange(groups + 1)).tolist()))

    rows = 0
    for at, x in blocks:
        n, length = x.shape
        back = np.zeros((n, length + 7), np.uint8)
        back[:, : length - 1] = x[:, -2::-1]
        # eight bytes from each place on, read as a number, are the context of the symbol before which they stand
        context = np.lib.stride_tricks.sliding_window_view(back, 8, axis=1)[:, length - 2 :: -1].view(">u8")[..., 0].astype(np.uint64).ravel()
        g = group[x[:, :-1].ravel()]
        u, pos, sym = np.repeat(np.arange(at, at + n), length - 1), np.tile(np.arange(1, length, dtype=np.int32), n), x[:, 1:].ravel()
        if (g < 0).any():
            take = np.flatnonzero(g >= 0)
            context, u, pos, sym, g = context[take], u[take], pos[take], sym[take], g[take]
        chunk.append((context, u, pos, sym, g))
        rows += len(g)
        if rows >= 2 * _GROUP_ROWS:
            sort()
            rows = 0
    if chunk:
        sort()
    for k in range(groups):
        context, u, pos, sym = (np.concatenate([h[i][h[4][k] : h[4][k + 1]] for h in held]) for i in range(4))
        order = np.argsort((context >> np.uint64(56)).astype(np.uint8), kind="stable")  # by the last byte, then payload and position
        of = _Group(context[order], u[order], pos[order], sym[order].astype(np.int64), max_order)
        mine, bits, seen = of.score(first, last)
        left = np.flatnonzero(of.alive)
        yield of.u[mine], bits[mine], (of.u[left], of.pos[left].astype(np.int64), seen)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it, the first place included."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _ranks(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each key among the distinct ones, how often these occur, where they do, these in order); all are below ``top``."""
    n = len(key)
    if top <= 4 * n:
        times = np.bincount(key, minlength=top)
        keys = np.flatnonzero(times)
        place = np.empty(top, np.int64)
        place[keys] = np.arange(len(keys))
        rank = place[key]
        member = np.empty(len(keys), np.int64)
        member[rank] = np.arange(n)
        return rank, times[keys], member, keys
    width = max(1, n - 1).bit_length()
    both = key << width
    both |= np.arange(n)
    both.sort()  # sorts numbers, which is faster than an order of them
    at = both & ((1 << width) - 1)
    both >>= width
    new = _changes(both)
    begins = np.flatnonzero(new)
    times = np.empty(len(begins), np.int64)
    np.subtract(begins[1:], begins[:-1], out=times[:-1])
    times[-1:] = n - begins[-1:]
    rank = np.empty(n, np.int64)
    rank[at] = np.cumsum(new) - 1
    return rank, times, at[begins], both[begins]


class _Level:
    """The rows whose context of one order others or the row's own payload have too: ``node`` is the context, ``entry`` context and symbol."""

    def __init__(self, rows: np.ndarray, node: np.ndarray, sym: np.ndarray, n: int, below: _Level | None):
        self.rows, self.node = rows, node
        self.size = np.bincount(node)
        self.entry, self.count, member, self.keys = _ranks(node << 8 | sym[rows], len(self.size) << 8)
        of = self.keys >> 8
        self.kinds = np.bincount(of)
        self.place = None if below is None else np.full(n, -1)
        if below is not None:
            self.place[rows] = np.arange(len(rows))
            # of the symbols here, their occurrences in the context that is shorter by one
            self.below = np.bincount(of, below.count[below.entry[below.at(rows[member])]]).astype(np.int64)

    def at(self, rows: np.ndarray) -> np.ndarray:
        return rows if self.place is None else self.place[rows]

    def occurrences(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """How often symbols occur after contexts."""
        key = node << 8 | sym
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.count[i], 0)


class _Group:
    """All rows of some contexts of order 1, ordered by context, payload and position.

    A row has only itself to take off the counts, except where its payload has the context again: such pairs of
    rows are few, and are looked at one by one.
    """

    def __init__(self, context: np.ndarray, u: np.ndarray, pos: np.ndarray, sym: np.ndarray, max_order: int):
        self.u, self.pos, self.sym, n = u, pos, sym, len(u)
        byte = lambda rows, order: (context[rows] >> np.uint64(64 - 8 * order) & np.uint64(255)).astype(np.int64)
        end = byte(slice(None), 1)
        self.levels = [_Level(np.arange(n), np.cumsum(_changes(end)) - 1, sym, n, None)]
        while len(self.levels) < max_order:
            low, order = self.levels[-1], len(self.levels) + 1
            more = np.flatnonzero((low.size[low.node] > 1) & (pos[low.rows] >= order))
            node, size, _, _ = _ranks(low.node[more] << 8 | byte(low.rows[more], order), len(low.size) << 8)
            keep = size[node] > 1
            if not keep.any():
                break
            self.levels.append(_Level(low.rows[more[keep]], (np.cumsum(size > 1) - 1)[node[keep]], sym, n, low))
        # pairs of rows of one payload and context of order 1, each way, and up to which order they share it
        a, away = [], 1
        left = np.flatnonzero((u[1:] == u[:-1]) & (end[1:] == end[:-1]))
        while len(left):
            a.append((left, left + away))
            away += 1
            left = left[left < n - away]
            left = left[(u[left] == u[left + away]) & (end[left] == end[left + away])]
        i, j = (np.concatenate(c) for c in zip(*a)) if a else (left, left)
        apart, shared = context[i] ^ context[j], np.ones(len(i), np.int64)
        for order in range(2, len(self.levels) + 1):
            shared += (apart >> np.uint64(64 - 8 * order) == 0) & (pos[i] >= order) & (pos[j] >= order)
        self.i, self.j, self.shared = np.r_[i, j], np.r_[j, i], np.r_[shared, shared]

    def score(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows to score, bits of all rows down to order 1, symbols seen by those still open, packed)."""
        n, sym = len(self.u), self.sym
        alive = self.alive = (self.u >= first) & (self.u < last)
        mine = np.flatnonzero(alive)
        unlikely, passed = np.ones(n), np.zeros(n, np.int64)  # one by the probability, at most (all rows + 256) ** 8
        for order in range(len(self.levels), 0, -1):
            v, up = self.levels[order - 1], self.levels[order] if order < len(self.levels) else None
            here = np.flatnonzero(alive[v.rows])
            r, node, entry = v.rows[here], v.node[here], v.entry[here]
            count = v.count[entry]
            c, total, kinds = count - 1, v.size[node] - 1, v.kinds[node]
            kinds = kinds - (c == 0)
            if up is not None:  # symbols seen after the longer context are left out
                above = up.place[r]
                longer = np.flatnonzero(above >= 0)
                total[longer] -= up.below[up.node[above[longer]]] - count[longer]
            k = np.flatnonzero((self.shared >= order) & alive[self.i])
            if len(k):
                self._own(order, v, up, k, r, c, total, kinds)
            q = kinds - passed[r]
            found = c > 0
            part = np.where(found, c, q)
            unlikely[r] *= np.maximum(total + q, 1) / np.maximum(part, 1)  # an order without symbols left is skipped
            passed[r] = kinds
            alive[r[found]] = False
        return mine, np.log2(unlikely), self._seen()

    def _own(self, order: int, v: _Level, up: _Level | None, k: np.ndarray, r: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """Put right the rows ``r`` whose payload has their context again, in the pairs ``k``."""
        number = np.zeros(len(self.u), np.int64)
        number[self.i[k]] = 1
        row = np.flatnonzero(number)
        number[row] = np.arange(len(row))
        which = np.searchsorted(r, row)
        i, j = np.r_[np.arange(len(row)), number[self.i[k]]], np.r_[row, self.j[k]]  # a row is one of its own
        group, times, member, keys = _ranks(i << 8 | self.sym[j], len(row) << 8)
        g, s = keys >> 8, keys & 255
        at = v.at(j[member])
        all_ = v.count[v.entry[at]]
        others = all_ - times
        sums = lambda x: np.bincount(g, x, len(row)).astype(np.int64)
        c[which] = others[group[: len(row)]]
        total[which] = v.size[v.node[v.at(row)]] - sums(times)
        kinds[which] = v.kinds[v.node[v.at(row)]] - sums(others == 0)
        if up is None:
            return
        above = up.place[row]
        longer = above >= 0
        node = up.node[above]
        deeper = np.bincount(group, np.r_[np.ones(len(row), bool), self.shared[k] > order], len(keys))
        there = np.where(longer[g], up.occurrences(node[g], s), 0)
        lost = np.where(there > deeper, times, np.where(there > 0, all_, 0))
        total[which] -= np.where(longer, up.below[node], 0) - sums(lost)

    def _seen(self) -> np.ndarray:
        """The symbols that open rows have seen at order 1, 256 bits each."""
        v, rows = self.levels[0], np.flatnonzero(self.alive)
        out = [np.zeros((0, 32), np.uint8)]
        if len(rows):
            table = np.zeros((len(v.size), 256), np.int64)
            table[v.keys >> 8, v.keys & 255] = v.count
            k = np.flatnonzero(self.alive[self.i])
            k = k[np.argsort(self.i[k], kind="stable")]
            for a in range(0, len(rows), 10_000):
                part = rows[a : a + 10_000]
                left = table[v.node[part]]
                left[np.arange(len(part)), self.sym[part]] -= 1
                x, z = np.searchsorted(self.i[k], [part[0], part[-1] + 1])
                np.subtract.at(left, (np.searchsorted(part, self.i[k[x:z]]), self.sym[self.j[k[x:z]]]), 1)
                out.append(np.packbits(left > 0, axis=1))
        return np.concatenate(out)

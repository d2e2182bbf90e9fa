"""Runs of identical or near-identical consecutive events, collapsed into one event each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.functions.timefn import DAY_US, micros
from tidelog.session import cluster, stage

#: Payloads longer than this are compared one pair at a time instead of as a matrix of the batch.
_WIDE = 4096


def differing(a: bytes | None, b: bytes | None) -> float:
    """Byte positions in which two payloads differ; positions that only one has count too. A missing payload differs from all."""
    if a is None or b is None:
        return np.inf
    n = min(len(a), len(b))
    return float(np.count_nonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) + abs(len(a) - len(b)))


def neighbour_costs(payloads: list[bytes | None]) -> np.ndarray:
    """``differing`` of each payload and the one before it; the first entry is inf."""
    out = np.full(len(payloads), np.inf)
    if len(payloads) < 2:
        return out
    sizes = {-1 if p is None else len(p) for p in payloads}
    if len(sizes) == 1 and 0 <= (n := sizes.pop()) <= _WIDE:
        m = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), n)
        out[1:] = np.count_nonzero(m[1:] != m[:-1], axis=1)
    else:
        out[1:] = [differing(a, b) for a, b in zip(payloads, payloads[1:])]
    return out


class NeighbourCost:
    """Dissimilarity within a run: the sum of the differences between neighbours.

    What an event adds is the same for every open candidate (``alike``), so candidates of equal sums stay equal
    and the programme needs one of them only.
    """

    alike, missing = True, 0.0

    def __init__(self):
        self.total, self.since = 0.0, []

    def extend(self, step: float) -> list[float]:
        """The costs of all candidates after an event that differs by ``step`` from the one before; the event opens one more."""
        if step == np.inf:  # no run goes on over it
            costs = [np.inf] * len(self.since)
        else:
            self.total += step if self.since else 0.0
            costs = [self.total - s for s in self.since]
        self.since.append(self.total)
        return [*costs, 0.0]

    def keep(self, which: list[int]) -> None:
        self.since = [self.since[i] for i in which]


class ConsensusCost:
    """Dissimilarity within a run: byte positions in which its events differ from its most frequent byte there.

    A run's cost is that of the best representative payload, so events far apart in a run count against each
    other, unlike with neighbours: a payload that drifts by a byte at a time is cut into several runs. A
    position that a shorter payload lacks counts as a symbol of its own. Splitting a run never costs more, which
    is what the programme's pruning needs.
    """

    alike, missing = False, b""

    def __init__(self):
        self.width, self.n = 0, np.zeros(0, np.int64)
        self.counts, self.top = np.zeros((0, 0, 257), np.int32), np.zeros((0, 0), np.int32)

    def _widen(self, width: int) -> None:
        more = width - self.width
        self.counts = np.pad(self.counts, ((0, 0), (0, more), (0, 0)))
        self.counts[:, self.width :, 256] = self.n[:, None]
        self.top = np.concatenate([self.top, np.repeat(self.n[:, None], more, 1).astype(np.int32)], 1)
        self.width = width

    def extend(self, payload: bytes) -> list[float]:
        if len(payload) > self.width:
            self._widen(len(payload))
        self.counts = np.concatenate([self.counts, np.zeros((1, self.width, 257), np.int32)])
        self.top = np.concatenate([self.top, np.zeros((1, self.width), np.int32)])
        self.n = np.append(self.n, 0) + 1
        symbols = np.full(self.width, 256)
        symbols[: len(payload)] = np.frombuffer(payload, np.uint8)
        at = np.arange(self.width)
        self.counts[:, at, symbols] += 1
        self.top = np.maximum(self.top, self.counts[:, at, symbols])
        return (self.n * self.width - self.top.sum(1)).astype(float).tolist()

    def keep(self, which: list[int]) -> None:
        self.n, self.counts, self.top = self.n[which], self.counts[which], self.top[which]


class _Boundary:
    """A place where a run can begin: before event ``at``, at the least cost ``best`` of all before it."""

    __slots__ = ("at", "best", "before", "mark")

    def __init__(self, at: int, best: float, before: _Boundary | None, mark):
        self.at, self.best, self.before, self.mark = at, best, before, mark


class Segmentation:
    """Optimal segmentation of a sequence into runs, event by event.

    Minimises the sum over runs of ``penalty`` plus the dissimilarity inside the run. Dynamic programming over
    the last boundary: best(t) = min over s < t of best(s) + inside(s, t) + penalty. A candidate s with
    best(s) + inside(s, t) >= best(t) is never better than t from then on and is pruned (PELT), as splitting a
    run doesn't raise its dissimilarity; where all candidates grow alike, the first of those with equal sums is
    kept, so that whole numbers of bytes leave at most twice the penalty of them. Once one candidate is left, every later segmentation goes through it: the runs before it are final and handed out,
    so what is held is the boundaries since then, whatever the length of the sequence.
    """

    def __init__(self, penalty: float, cost: type = NeighbourCost):
        self.penalty, self.kind = penalty, cost
        self.restart()

    def restart(self) -> None:
        self.cost, self.n, self.value, self.last, self.alive = self.kind(), 0, 0.0, None, []

    def feed(self, step, mark=None) -> list[tuple[_Boundary, _Boundary]]:
        """Take the next event; the runs now final, as pairs of boundaries."""
        self.alive.append(_Boundary(self.n, self.value, self.last, mark))
        sums = [b.best + c for b, c in zip(self.alive, self.cost.extend(step))]
        least = min(sums)
        best = sums.index(least)
        self.n, self.value, self.last = self.n + 1, least + self.penalty, self.alive[best]
        if len(sums) > 1:
            which = [i for i, s in enumerate(sums) if s < self.value]
            if self.cost.alike and len(which) > 1:
                first: dict[float, int] = {}
                for i in which:
                    first.setdefault(sums[i], i)
                which = list(first.values())
            if len(which) < len(sums):
                self.alive = [self.alive[i] for i in which]
                self.cost.keep(which)
        return self._final(self.alive[0]) if len(self.alive) == 1 and self.alive[0].before else []

    def close(self, mark=None) -> list[tuple[_Boundary, _Boundary]]:
        """The remaining runs, as the sequence ends; ``mark`` is that of the end. The next event begins another sequence."""
        done = self._final(_Boundary(self.n, self.value, self.last, mark)) if self.n else []
        self.restart()
        return done

    @staticmethod
    def _final(end: _Boundary) -> list[tuple[_Boundary, _Boundary]]:
        done, at = [], end
        while at.before is not None:
            done.append((at.before, at))
            at = at.before
        end.before = None
        return done[::-1]


def segment(steps, penalty: float, cost: type = NeighbourCost) -> tuple[np.ndarray, float]:
    """Which events of a sequence begin a run, and the least total cost; a step is what ``cost`` takes of an event."""
    programme, total, begins = Segmentation(penalty, cost), 0.0, np.zeros(len(steps), bool)
    for s in steps:
        for a, _ in programme.feed(s):
            begins[a.at] = True
    total = programme.value
    for a, _ in programme.close():
        begins[a.at] = True
    return begins, total


def _runs(schema: pa.Schema, penalty: float, max_gap_us: int, cost: type):
    """Runs of each (entity, slice); rows come sorted by entity, slice and time.

    The programme goes on over batches. It starts anew with each slice, after a silence, and around a missing
    payload, where no run can go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme = Segmentation(penalty, cost)
        last = None  # (entity, slice, time, payload) of the row before
        done: list[tuple] = []

        def take(runs: list, ends: bool = False) -> None:
            # marks: (entity, slice, time, payload, time before, payload before, begins its slice)
            for i, (a, b) in enumerate(runs):
                done.append((*a.mark[:3], b.mark[4], b.at - a.at, a.mark[3], b.mark[5], a.mark[6], ends and i == len(runs) - 1))

        for b in batches:
            if not b.num_rows:
                continue
            k, p = b.column(0).to_pylist(), b.column(3).to_pylist()
            s, t = (b.column(i).to_numpy(zero_copy_only=False).tolist() for i in (1, 2))
            steps = neighbour_costs(p).tolist() if cost is NeighbourCost else p
            if last is not None and cost is NeighbourCost:
                steps[0] = differing(last[3], p[0])
            for row in zip(k, s, t, p, steps):
                other = last is None or last[0] != row[0] or last[1] != row[1]
                before = (None, None) if last is None else last[2:4]
                if last is not None and (other or row[2] - last[2] > max_gap_us or row[3] is None or last[3] is None):
                    take(programme.close((*row[:4], *before, other)), other)
                take(programme.feed(row[4] if row[3] is not None else cost.missing, (*row[:4], *before, other)))
                last = row[:4]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        if last is not None:
            take(programme.close((None, None, None, None, *last[2:4], True)), True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _joined(schema: pa.Schema, penalty: float, max_gap_us: int):
    """Runs across the seams of slices, from the first and the last run of each slice, sorted by entity and time.

    The programme goes on over the slices of an entity and over batches, with runs as its events. The boundaries
    inside a slice are decided: no run goes on over them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme = Segmentation(penalty)
        last = None  # (entity, start, stop, events, first, final, begins its slice) of the row before
        done: list[tuple] = []
        events = 0  # of the entity's rows so far

        def take(runs: list) -> None:
            # marks: (entity, start, payload, stop before, events before)
            done.extend((a.mark[0], a.mark[1], b.mark[3], b.mark[4] - a.mark[4], a.mark[2]) for a, b in runs)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                step = 0.0
                if last is not None and last[0] != row[0]:
                    take(programme.close((None, None, None, last[2], events)))
                    events = 0
                elif last is not None:
                    step = differing(last[5], row[4]) if row[6] and row[1] - last[2] <= max_gap_us else np.inf
                take(programme.feed(step, (row[0], row[1], row[4], last and last[2], events)))
                events, last = events + row[3], row
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        if last is not None:
            take(programme.close((None, None, None, last[2], events)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def collapse_runs(df: DataFrame, entity: str, time: str, payload: str, max_differing: int = 2, max_gap_us: int = 6 * 3_600_000_000, slice_us: int = DAY_US, cost: type = NeighbourCost) -> DataFrame:
    """Each run of near-identical consecutive events as one event.

    Returns (entity, start_us, stop_us, duration_us, events, payload), with the first event's payload and
    times in microseconds since 1970-01-01; every event is in exactly one run. The runs are the optimal
    segmentation of each entity's sequence (:class:`Segmentation`): the boundary penalty lies half a byte above
    ``max_differing``, and no run goes over a silence of more than ``max_gap_us``.

    With :class:`NeighbourCost` two neighbours are in one run exactly if their payloads differ in at most
    ``max_differing`` byte positions and they are near enough in time: costs that add up over neighbours make
    every boundary a decision of its own. With :class:`ConsensusCost` runs are the best trade-off between the
    number of runs and the bytes that differ from a run's representative.

    A null payload is a run of its own; events without entity or time have no place in a sequence and are left
    out. Events of one entity at the same time are ordered by payload. Repeated rows are events of their own:
    drop repeated deliveries before. Empty tables and extra columns of any name are fine.

    The sequence of an entity is cut into slices of ``slice_us``, so that a busy entity is many tasks. Costs
    between neighbours make the optimum of a whole sequence consist of the optima of its slices and of those at
    their seams, over which the same programme goes on with two rows per slice. The consensus of a run
    doesn't come apart like this: with it, a sequence is an entity's slice, and runs end with it.
    """
    kind = df.schema[entity].dataType
    rows = df.select(F.col(entity).alias("k"), micros(time).alias("t"), F.col(payload).cast("binary").alias("p")).where("k is not null and t is not null")
    rows = cluster(rows.select("k", F.floor(F.col("t") / F.lit(slice_us)).alias("slice"), "t", "p"), ["k", "slice"], ["t", "p"])
    fields = [("k", to_arrow_type(kind)), ("slice", pa.int64()), ("start_us", pa.int64()), ("stop_us", pa.int64()), ("events", pa.int64()), ("first", pa.binary()), ("final", pa.binary()), ("begins", pa.bool_()), ("ends", pa.bool_())]
    ddl = f"k {kind.simpleString()}, slice bigint, start_us bigint, stop_us bigint, events bigint, first binary, final binary, begins boolean, ends boolean"
    runs = stage(rows.mapInArrow(_runs(pa.schema(fields), max_differing + 0.5, max_gap_us, cost), ddl))

    if not cost.alike:
        return runs.select(F.col("k").alias(entity), "start_us", "stop_us", (F.col("stop_us") - F.col("start_us")).alias("duration_us"), "events", F.col("first").alias("payload"))
    edge = F.col("begins") | F.col("ends")
    # a slice's first and last run may start at the same time
    edges = cluster(runs.where(edge).select("k", "start_us", "stop_us", "events", "first", "final", "begins", "slice", "ends"), ["k"], ["start_us", "slice", "ends"]).drop("slice", "ends")
    joined = pa.schema([("k", to_arrow_type(kind)), ("start_us", pa.int64()), ("stop_us", pa.int64()), ("events", pa.int64()), ("payload", pa.binary())])
    seams = edges.mapInArrow(_joined(joined, max_differing + 0.5, max_gap_us), f"k {kind.simpleString()}, start_us bigint, stop_us bigint, events bigint, payload binary")
    inner = runs.where(~edge).select("k", "start_us", "stop_us", "events", F.col("first").alias("payload"))
    return inner.unionByName(seams).select(F.col("k").alias(entity), "start_us", "stop_us", (F.col("stop_us") - F.col("start_us")).alias("duration_us"), "events", "payload")

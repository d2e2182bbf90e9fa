"""Continuous periods and gaps of overlapping time intervals per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.functions.timefn import DAY_US, micros
from tidelog.session import cluster, stage


class IntervalMap:
    """Ordered, disjoint, closed intervals. Gap i lies between interval i and i + 1, so replacing intervals replaces gaps."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        """Merge [start, end] with all intervals that share an instant with it; both bounds are found by binary search."""
        lo, hi = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))

    def __len__(self) -> int:
        return len(self.starts)


def _partial(schema: pa.Schema, held: int = 200_000):
    """Merge intervals inside a map task, so that copies and nested intervals aren't shuffled; memory holds ``held`` intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        seen = 0

        def rows() -> pa.RecordBatch:
            out = [(k, s, a, b) for (k, s), m in maps.items() for a, b in zip(m.starts, m.ends)]
            maps.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            for k, s, a, e in zip(*(c.to_pylist() for c in b.columns)):
                maps.setdefault((k, s), IntervalMap()).insert(a, e)
            seen += b.num_rows
            if seen >= held:
                yield rows()
                seen = 0
        if maps:
            yield rows()

    return run


def _final(schema: pa.Schema):
    """Merge the intervals of each slice; rows come sorted by slice, so one map is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, IntervalMap()
        for b in batches:
            done = []
            for k, s, a, e in zip(*(c.to_pylist() for c in b.columns)):
                if (k, s) != key:
                    if key is not None:
                        done.append((*key, held.starts, held.ends))
                    key, held = (k, s), IntervalMap()
                held.insert(a, e)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if key is not None:
            done = [(*key, held.starts, held.ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def continuous_periods(df: DataFrame, entity: str, start: str, end: str, slice_us: int = DAY_US) -> DataFrame:
    """Merge each entity's intervals into continuous periods and list the gaps between them.

    Returns (entity, kind 'period' or 'gap', start_us, stop_us), times in microseconds since 1970-01-01.
    Ends belong to an interval. A row without entity or start, or with its end before its start, has no
    place in time and is left out; a row without end covers its start only. Repeated rows change nothing,
    ties and empty tables are fine, other columns of any name are ignored.

    Each entity's time is cut into slices of ``slice_us`` by where intervals begin. Keyed state holds an
    ordered disjoint-interval map per (entity, slice): first inside the map tasks, then, after one shuffle,
    one slice at a time. A long interval reaches into later slices only through the largest end so far,
    which is one number per slice; so no task ever holds all intervals of an entity.
    """
    kind = df.schema[entity].dataType
    rows = df.select(F.col(entity).alias("k"), micros(start).alias("s"), micros(end).alias("e")).where("k is not null and s is not null and (e is null or e >= s)")
    rows = rows.select("k", F.floor(F.col("s") / F.lit(slice_us)).alias("slice"), "s", F.coalesce("e", "s").alias("e"))
    flat = rows.schema
    part_schema = pa.schema([pa.field("k", _arrow(kind)), ("slice", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
    full_schema = pa.schema([pa.field("k", _arrow(kind)), ("slice", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    part = rows.mapInArrow(_partial(part_schema), flat)
    slices = stage(cluster(part, ["k", "slice"]).mapInArrow(_final(full_schema), _ddl(kind)))

    by = W.partitionBy("k").orderBy("slice")
    reach = slices.select("k", "slice", F.element_at("ends", -1).alias("top")).select(
        "k", "slice", F.max("top").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("carry"), F.max("top").over(W.partitionBy("k")).alias("last")
    )
    # ``a`` leading intervals of a slice begin inside an earlier period; the others begin periods of their own
    fresh = (
        slices.join(reach, ["k", "slice"])
        .withColumn("a", F.when(F.col("carry").isNull(), 0).otherwise(F.size(F.filter("starts", lambda x: x <= F.col("carry")))))
        .withColumn("m", F.size("starts") - F.col("a"))
        .where("m > 0")
        .withColumn("before", F.when(F.col("a") > 0, F.greatest("carry", F.get("ends", F.col("a") - 1))).otherwise(F.col("carry")))
        .withColumn("news", F.slice("starts", F.col("a") + 1, F.col("m")))
        .withColumn("prevs", F.concat(F.array("before"), F.slice("ends", F.col("a") + 1, F.col("m") - 1)))
    )
    inside = fresh.select(
        "k",
        F.inline(
            F.concat(
                F.filter(F.transform("news", lambda x, i: F.struct(F.lit("gap").alias("kind"), F.get("prevs", i).alias("start_us"), x.alias("stop_us"))), lambda g: g["start_us"].isNotNull()),
                F.filter(F.transform("news", lambda x, i: F.struct(F.lit("period").alias("kind"), x.alias("start_us"), F.get("prevs", i + 1).alias("stop_us"))), lambda g: g["stop_us"].isNotNull()),
            )
        ),
    )
    tails = fresh.select("k", "slice", "last", F.element_at("news", -1).alias("start_us"), "before").select(
        "k", F.lit("period").alias("kind"), "start_us", F.coalesce(F.lead("before").over(by), "last").alias("stop_us")
    )
    return inside.unionByName(tails).withColumnRenamed("k", entity)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _ddl(kind) -> str:
    return f"k {kind.simpleString()}, slice bigint, starts array<bigint>, ends array<bigint>"

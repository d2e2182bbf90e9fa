"""Filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.session import stage

#: A table of containers, targets or the like is a parameter; beyond this many rows it is refused.
PARAMETER_ROWS = 1000


def parameter_rows(df: DataFrame) -> list:
    """The rows of a parameter table, of which the size is checked."""
    rows = df.limit(PARAMETER_ROWS + 1).collect()
    if len(rows) > PARAMETER_ROWS:
        raise ValueError(f"a parameter table has more than {PARAMETER_ROWS} rows")
    return rows


class BinTree:
    """Tournament tree over the room left in each bin; the winner of a subtree is its roomiest bin."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Put an item in the first bin with enough room, and return the bin."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        room[i] -= need
        at = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ``sizes`` must be falling and none above ``capacity``."""
    tree = BinTree(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def _pack_group(schema: pa.Schema):
    def pack(group: pa.Table) -> pa.Table:
        container, capacity, grp = (group.column(c)[0].as_py() for c in ("container", "capacity", "grp"))
        rows, rest = [], []
        for size, u, i in zip(*(group[c].to_pylist() for c in ("size", "u", "id"))):
            pieces, left = divmod(size, capacity) if size > capacity else (0, size)
            rows += [(i, u, p, p * capacity, capacity) for p in range(pieces)]
            if left or not pieces:
                rest.append((left, i, u, pieces, pieces * capacity))
        rest.sort(key=lambda x: (-x[0], x[2]))
        bins = first_fit_decreasing([r[0] for r in rest], capacity)
        opened = max(bins, default=-1) + 1
        out = [(container, capacity, grp, b, i, u, p, first, n) for b, (n, i, u, p, first) in zip(bins, rest)]
        out += [(container, capacity, grp, opened + k, i, u, p, first, n) for k, (i, u, p, first, n) in enumerate(rows)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pack


def pack(items: DataFrame, item: str, size: str, limits: DataFrame, container: str = "container", capacity: str = "capacity_tokens", group_items: int = 4096, seed: int = 42) -> DataFrame:
    """Assign items to containers of fixed capacity by first-fit decreasing, once for each kind of container.

    Returns (container, capacity, grp, bin, item, row, piece, first_unit, units): (container, grp, bin) is one
    container, ``row`` tells rows with equal items apart. An item is split only if it is larger than the
    capacity: full pieces have containers of their own and the remainder is packed like an item. Items of
    size 0, null or less take no room but are assigned, so that each input row comes out. Equal and null
    items and ties are fine; other columns of any name are ignored. ``limits`` is a parameter table (at most
    1,000 rows); capacities must be positive.

    Items are dealt at random to groups of about ``group_items``, each packed in one task with a tournament
    tree: no group grows with the input, and what a group wastes by its last container is about
    1 / (group_items * mean size / capacity).
    """
    kinds = [(r[0], int(r[1])) for r in parameter_rows(limits.select(container, capacity).where(F.col(capacity).isNotNull()))]
    if any(c <= 0 for _, c in kinds):
        raise ValueError("capacities must be positive")
    rows = stage(items.select(F.col(item).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("size"), F.monotonically_increasing_id().alias("u")))
    groups = max(1, round(rows.count() / group_items))
    each = F.array(*(F.struct(F.lit(n).cast("string").alias("container"), F.lit(c).cast("long").alias("capacity")) for n, c in kinds)) if kinds else F.expr("cast(array() as array<struct<container:string,capacity:bigint>>)")
    dealt = rows.select("id", "size", "u", F.pmod(F.xxhash64(F.lit(seed), "u"), F.lit(groups)).alias("grp"), F.inline(each))
    id_type = items.schema[item].dataType
    fields = [("container", pa.string()), ("capacity", pa.int64()), ("grp", pa.int64()), ("bin", pa.int64()), ("id", to_arrow_type(id_type)), ("row", pa.int64()), ("piece", pa.int64()), ("first_unit", pa.int64()), ("units", pa.int64())]
    ddl = f"container string, capacity bigint, grp bigint, bin bigint, id {id_type.simpleString()}, row bigint, piece bigint, first_unit bigint, units bigint"
    return dealt.groupBy("container", "grp").applyInArrow(_pack_group(pa.schema(fields)), ddl).withColumnRenamed("id", item)

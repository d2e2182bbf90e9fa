"""Values of the next or previous row of each entity, without one task per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_neighbours(df: DataFrame, entity: str, order: Sequence[str], after: dict[str, str] | None = None, before: dict[str, str] | None = None, slice_by: Column | None = None) -> DataFrame:
    """``df`` with the columns {new: old} of the entity's next row (``after``) and previous row (``before``) by ``order``; null at the ends.

    Equals lead() and lag() over (partition by entity order by ``order``), but a window covers one slice of an
    entity (its days, where ``slice_by`` isn't given; it must not fall along ``order``). Only a slice's outer
    rows look beyond it: these, at most two per slice, are a series of their own, so no row is joined, and both
    series and both directions come from one shuffle. ``order`` must be unique per entity for a defined result.
    Rows with a null entity are kept and have no neighbours.
    """
    d = df.withColumn("_slice", F.to_date(order[0]) if slice_by is None else slice_by)
    inside, whole, one = W.partitionBy(entity, "_slice").orderBy(*order), W.partitionBy(entity).orderBy("_slice", *order), F.lit(1)
    looks = [(name, step, outer, F.struct(*(F.col(old).alias(new) for new, old in columns.items())), columns) for name, step, outer, columns in (("_after", F.lead, "_last", after), ("_before", F.lag, "_first", before)) if columns]
    seen = d.withColumns({"_first": F.lag(one).over(inside).isNull(), "_last": F.lead(one).over(inside).isNull(), **{name: step(row).over(inside) for name, step, _, row, _ in looks}})
    edges = seen.where("_first or _last").withColumns({name: F.when(F.col(outer), step(row).over(whole)).otherwise(F.col(name)) for name, step, outer, row, _ in looks})
    both = seen.where("not (_first or _last)").unionByName(edges)
    return both.select(*(F.col(c) for c in df.columns), *(F.when(F.col(entity).isNotNull(), F.col(f"{name}.{new}")).alias(new) for name, _, _, _, columns in looks for new in columns))


def with_neighbour(df: DataFrame, entity: str, order: Sequence[str], columns: dict[str, str], forward: bool = True, slice_by: Column | None = None) -> DataFrame:
    """:func:`with_neighbours` in one direction."""
    return with_neighbours(df, entity, order, columns if forward else None, None if forward else columns, slice_by)

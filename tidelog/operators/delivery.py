"""Exactly one copy of messages that were delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _known(key: Sequence[str]) -> Column:
    c = F.lit(True)
    for k in key:
        c = c & F.col(k).isNotNull()
    return c


def _identifier(df: DataFrame, identifier: dict[str, Column | str], row_id: str, order: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    keys, by = [f"_k{i}" for i in range(len(identifier))], [f"_o{i}" for i in range(len(order))]
    parts = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(keys, identifier.values())]
    return df.select(*parts, *(F.col(o).alias(b) for o, b in zip(order, by)), F.col(row_id).alias("_id")), keys, by


def first_deliveries(df: DataFrame, identifier: dict[str, Column | str], row_id: str, order: Sequence[str] = ()) -> DataFrame:
    """(row_id, copies): the row to keep of each group with the same identifier, and the size of the group.

    The kept row has the least struct of the ``order`` columns (delivery time first), then the least
    ``row_id`` as tie-break; min_by combines inside map tasks, so a group of any size shuffles one row per
    task. Spark aggregates structs by sorting inside the task; without ``order`` the id alone decides, and a
    hash table does. Rows with a null in the identifier have none: see :func:`redelivered`. Nulls in ``order``
    sort first, as Spark orders structs.
    """
    rows, keys, by = _identifier(df, identifier, row_id, order)
    least = F.struct(*by, "_id") if by else F.col("_id")
    return rows.where(_known(keys)).groupBy(*keys).agg(F.min_by("_id", least).alias(row_id), F.count(F.lit(1)).alias("copies")).select(row_id, "copies")


def redelivered(df: DataFrame, identifier: dict[str, Column | str], row_id: str, order: Sequence[str] = ()) -> DataFrame:
    """(row_id): the rows to drop so that exactly one copy of each identifier stays.

    All rows are held against the kept ones by ``row_id`` (unique, so this join has no skew, however large a
    group of copies is). Rows with a null in the identifier can't be told to be copies and are never dropped.
    """
    rows, keys, _ = _identifier(df, identifier, row_id, order)
    kept = first_deliveries(df, identifier, row_id, order).select(F.col(row_id).alias("_id"))
    return rows.where(_known(keys)).select("_id").join(kept, "_id", "left_anti").select(F.col("_id").alias(row_id))


def exactly_once(df: DataFrame, identifier: dict[str, Column | str], row_id: str, order: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df``, whole, with one copy per identifier; rows without a complete identifier all stay.

    One scan and one shuffle: min_by takes whole rows, and a row without a complete identifier is a group of
    its own by its ``row_id``.
    """
    keys, by = [f"_k{i}" for i in range(len(identifier))], [f"_o{i}" for i in range(len(order))]
    parts = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(keys, identifier.values())]
    rows = df.select(*parts, *(F.col(o).alias(b) for o, b in zip(order, by)), F.col(row_id).alias("_id"), F.struct(*df.columns).alias("_row"))
    return rows.groupBy(*keys, F.when(~_known(keys), F.col("_id")).alias("_alone")).agg(F.min_by("_row", F.struct(*by, "_id")).alias("_row")).select("_row.*")


def one_payload(df: DataFrame, identifier: dict[str, Column | str], row_id: str, payload: Sequence[str]) -> DataFrame:
    """One row per complete identifier with the ``payload`` columns of its first delivery, in a single shuffle."""
    names = list(identifier)
    rows = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in identifier.items()), F.struct(*payload).alias("_p"), F.col(row_id).alias("_id"))
    return rows.where(_known(names)).groupBy(*names).agg(F.min_by("_p", "_id").alias("_p")).select(*names, "_p.*")

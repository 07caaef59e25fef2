"""Numbers of rows in an order, without a sort in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.session import materialize

_ROW_BITS = 33  # of monotonically_increasing_id: the row inside its partition
_FIRST, _BEFORE, _SIZE, _AT, _TIE, _PART = (f"_numbered_{n}" for n in ("first", "before", "size", "at", "tie", "part"))


def numbered(
    rows: DataFrame,
    order: Sequence[Column | str],
    *,
    by: Sequence[str] = (),
    number: str = "number",
    size: str | None = None,
) -> DataFrame:
    """``rows`` with ``number``, counted from 0 in ``order`` over all rows or inside each group ``by``.

    One range exchange sorts the rows; a partition's rows then need only the number of rows before the partition, which
    are sums over one row for each partition and group it holds. ``size`` names a column for the size of the group. Groups
    are told apart with null as a value of its own, and sorted before ``order``. Rows that tie in everything are dealt out
    by their place in the input, so a row that makes up a third of all does not meet in one task; ``rows`` should
    therefore be a read of stored rows, whose places do not change when a task runs again.
    """
    keys = [*[F.col(b).asc_nulls_first() for b in by], *order]
    placed = rows.withColumn(_TIE, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, F.col(_TIE)).sortWithinPartitions(*keys, _TIE)
    placed = materialize(placed.drop(_TIE).withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(_PART, F.shiftright(_AT, _ROW_BITS))
    spans = placed.groupBy(_PART, *by).agg(F.min(_AT).alias(_FIRST), F.count(F.lit(1)).alias(_SIZE))
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns(
        {_BEFORE: F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)), _SIZE: F.sum(_SIZE).over(group)}
    )
    names = {k: f"_numbered_by_{i}" for i, k in enumerate([_PART, *by])}
    spans = spans.select(*[F.col(k).alias(n) for k, n in names.items()], _FIRST, _BEFORE, _SIZE)
    same = F.col(_PART) == F.col(names[_PART])
    for key in by:
        same &= F.col(key).eqNullSafe(F.col(names[key]))
    out = {number: F.col(_AT) - F.col(_FIRST) + F.col(_BEFORE)} | ({size: F.col(_SIZE)} if size else {})
    return placed.join(spans, same).select(*[F.col(c) for c in rows.columns], *[c.alias(n) for n, c in out.items()])

"""As-of joins: one shuffle on the key, no Cartesian product, no driver-side search."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    *,
    direction: str = "backward",
    strict: bool = False,
    tolerance_days: int | None = None,
    matched_time: str | None = None,
    block: str | None = None,
    unique_left: bool = False,
) -> DataFrame:
    """`left` plus the payload of the nearest `right` row at or before (`backward`) or at or after
    (`forward`) `left_time`; `strict` excludes equal times. NULL where there is none, or where it is
    further away than `tolerance_days`.

    The match depends on (by, time) only, so the probes are first reduced to distinct keys: however
    many left rows share a key, the sorted group holds at most one probe per instant. With day-grained
    times a group is bounded by the calendar. For finer times pass `block` (a `date_trunc` unit): groups
    become (key, block), and the last payload of earlier blocks is carried in as one extra row.
    """
    by = list(by)
    backward = direction == "backward"
    value = F.struct(*[F.col(c) for c in payload], F.col(right_time).alias("_at"))
    if unique_left:
        probes = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"))
    else:
        probes = left.select(*by, F.col(left_time).alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_l", F.lit(None).cast("int"))
    carried_type = probes.schema["_l"].dataType
    points = right.select(*by, F.col(right_time).alias("_t"), value.alias("_p")).where(F.col("_t").isNotNull())
    probe_first = strict
    rows = probes.select(*by, "_t", F.lit(not probe_first).alias("_late"), F.lit(None).cast(points.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_probe"), "_l").unionByName(
        points.select(*by, "_t", F.lit(probe_first).alias("_late"), "_p", F.lit(False).alias("_probe"), F.lit(None).cast(carried_type).alias("_l"))
    )
    parts: list[str] = by
    if block:
        rows = rows.withColumn("_block", F.date_trunc(block, F.col("_t")))
        rows = rows.unionByName(_carried(rows, by, backward), allowMissingColumns=True)
        parts = [*by, "_block"]
    time_order = F.col("_t").asc_nulls_first() if backward else F.col("_t").desc_nulls_first()
    w = Window.partitionBy(*parts).orderBy(time_order, F.col("_late")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select(*by, "_t", "_l", "_probe", F.last("_p", ignorenulls=True).over(w).alias("_p")).where("_probe")
    hit: Column = F.col("_p")
    if tolerance_days is not None:
        gap = F.datediff(F.col("_t"), F.col("_p._at")) if backward else F.datediff(F.col("_p._at"), F.col("_t"))
        hit = F.when(gap <= tolerance_days, F.col("_p"))
    extra = [F.col(f"_p.{c}").alias(c) for c in payload]
    if matched_time:
        extra.append(F.col("_p._at").alias(matched_time))
    if unique_left:
        return found.withColumn("_p", hit).select("_l.*", *extra)
    found = found.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_t").alias("_k_t"), hit.alias("_p"))
    on = (F.col(left_time) == F.col("_k_t"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    return left.join(found, on, "left").select(*[left[c] for c in left.columns], *extra)


def _carried(rows: DataFrame, by: list[str], backward: bool) -> DataFrame:
    """For every (key, block): the nearest payload of the blocks before it (after it when looking forward)."""
    pick = F.max_by if backward else F.min_by
    blocks = rows.groupBy(*by, "_block").agg(pick(F.col("_p"), F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_edge"))
    order = F.col("_block").asc() if backward else F.col("_block").desc()
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*by, "_block", F.last("_edge", ignorenulls=True).over(w).alias("_p")).where("_p is not null")
    return carry.select(*by, F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), F.lit(False).alias("_late"), "_p", F.lit(False).alias("_probe"), "_block")

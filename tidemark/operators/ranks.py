"""Order statistics that never need a whole group in one task.

A cross-section (one date, one measure) can be as large as the symbol table, and one tied value can
be a third of it. So ranks, quantiles and running totals are built in two levels:

1. rows collapse to one per distinct value (map-side combined, so a hot tie costs one row),
2. a group with many distinct values is cut into bins of about equal numbers of them, a running total over the
   *bins* gives each bin its offset, and a window inside each bin finishes the job.

Where a group is cut follows its data: the cuts are those of its distinct values whose hash falls in a fixed share, a
summary that merges by union. As the hash depends on the value alone, a retried task finds the same cuts, and however
close the values lie, bins hold about as many each. Smaller groups are one bin.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: distinct values of a group for each of its cuts: about what one window sorts
BIN_VALUES = 8192
#: tasks that share the rows of one cut value
SPREAD = 16


def _place(value: Column) -> Column:
    """How many of the sorted cuts lie at or below the value: of every `_step`th, then of those after the last hit."""
    below = lambda among: F.size(F.filter(among, lambda c: c <= value))
    done = below(F.col("_coarse")) * F.col("_step")
    return done + below(F.slice("_cuts", done + 1, F.col("_step")))


def binned(cells: DataFrame, by: Sequence[str], value: str, bin_values: int | None = None) -> DataFrame:
    """`cells`, one row per (by, value), with the column `_bin`: weakly rising with the value inside a group. A group of n
    distinct values has about n / bin_values cuts, most groups none."""
    # the test also reads the sums, in a way that never matters: so it stays above the aggregate, whose one shuffle then
    # serves the cuts, the bins and the result
    rest = [c for c in cells.columns if c not in (*by, value)]
    odd = (F.xxhash64(*rest) == F.lit(0x5DEECE66D1234567)).cast("int")
    chosen = cells.where(F.pmod(F.xxhash64(value) + odd, F.lit(bin_values or BIN_VALUES)) == 0)
    cuts = chosen.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_cuts")).withColumn("_step", F.greatest(F.lit(1), F.sqrt(F.size("_cuts")).cast("int")))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % F.col("_step") == F.col("_step") - 1))
    place = F.coalesce(F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_place(F.col(value))), F.lit(0))  # never NULL: no test for it is planned
    return cells.join(cuts, list(by), "left").withColumn("_bin", place).drop("_cuts", "_step", "_coarse")


def running_totals(df: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row per (by, value) with, for every name in `sums`, the aggregate itself, `<name>_before`
    (its sum over smaller values of the group) and `<name>_total` (over the whole group)."""
    keys = list(by) or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    cells = binned(rows.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()]), keys, value)
    bins = cells.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(n) for n in sums])
    group = Window.partitionBy(*keys)
    earlier_bins = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        *keys, "_bin",
        *[F.coalesce(F.sum(n).over(earlier_bins), F.lit(0)).alias(f"_{n}_offset") for n in sums],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(offsets, [*keys, "_bin"]).select(
        *by, value, *sums,
        *[(F.col(f"_{n}_offset") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def unpivot(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide -> long with one pass over the input."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
    return df.select(*keys, F.expr(f"stack({len(measures)}, {pairs}) as (`{name}`, `{value}`)"))


def average_ranks(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per distinct (by, value): ascending and descending average rank of ties, and the group's non-NULL count."""
    t = running_totals(long, by, value, {"n": F.count(F.lit(1))})
    return t.select(
        *by, value,
        (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank_up"),
        (F.col("n_total") - F.col("n_before") - (F.col("n") - 1) / 2).alias("rank_down"),
        F.col("n_total").alias("rank_count"),
    )


def percentile_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str], measures: Mapping[str, bool]) -> DataFrame:
    """(keys, by, m, pct): average rank over the non-NULL count within `by`, m the position of the measure in
    `measures`, which maps a column to True when higher is better. NULL values produce no row. Measures
    travel as small numbers: they are part of every shuffle key here.

    Rows are shuffled once, to the bin that a sample of their group's rows cuts. A cut value is a bin of its own, whose
    rows share one rank whatever the task: they are dealt over SPREAD tasks. A value that many rows share is in the sample,
    so no window meets it whole. `df` is read three times."""
    pairs = ", ".join(f"{i}, cast(`{name}` as double)" for i, name in enumerate(measures))
    long = df.select(*keys, *by, F.expr(f"stack({len(measures)}, {pairs}) as (m, value)")).where("value is not null")
    group, taken = [*by, "m"], F.pmod(F.xxhash64(*keys, *by, "m", "value"), F.lit(BIN_VALUES)) == 0
    cuts = long.where(taken).groupBy(*group).agg(F.sort_array(F.collect_set("value")).alias("_cuts")).withColumn("_step", F.greatest(F.lit(1), F.sqrt(F.size("_cuts")).cast("int")))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % F.col("_step") == F.col("_step") - 1))
    # at most one row for BIN_VALUES rows: a summary that may go to every task
    placed = long.join(F.broadcast(cuts), group, "left")
    placed = placed.withColumn("_at", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_place(F.col("value"))))
    is_cut = F.coalesce((F.col("_at") > 0) & (F.element_at("_cuts", F.greatest(F.col("_at"), F.lit(1))) == F.col("value")), F.lit(False))
    # even numbers lie between two cuts, odd ones are a cut
    placed = placed.select(*keys, *group, "value", (F.col("_at") * 2 - is_cut.cast("int")).alias("_bin"))
    lower = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_bin", "_n", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    sizes = sizes.withColumn("_part", F.explode(F.when(F.col("_bin") % 2 == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1)))))
    rows = placed.withColumn("_part", F.when(F.col("_bin") % 2 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int")))
    inside = Window.partitionBy(*group, "_bin", "_part").orderBy("value")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows below plus rows up to its peers, halved: the mean of the ranks that a tie takes
    rows = rows.withColumn("_twice", F.rank().over(inside) + F.count(F.lit(1)).over(upto)).drop("value")
    ranked = rows.join(sizes, [*group, "_bin", "_part"])
    twice = F.col("_before") * 2 + F.when(F.col("_bin") % 2 == 0, F.col("_twice")).otherwise(F.col("_n") + 1)
    falling = [i for i, up in enumerate(measures.values()) if not up]
    if falling:
        twice = F.when(F.col("m").isin(falling), (F.col("_total") + 1) * 2 - twice).otherwise(twice)
    return ranked.select(*keys, *group, (twice / 2 / F.col("_total")).alias("pct"))


def by_measure(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, m, pct) -> one row per key with a column per measure. Rows travel as they are and become wide where they
    meet: an aggregate before the shuffle would send every row with a column for each measure."""
    return rows.repartition(*keys).groupBy(*keys).agg(*[F.max(F.when(F.col("m") == i, F.col("pct"))).alias(name) for i, name in enumerate(names)])


def percentiles(df: DataFrame, keys: Sequence[str], by: Sequence[str], measures: Mapping[str, bool], suffix: str = "_pct") -> DataFrame:
    """The percentiles as columns next to (keys, by); rows without any non-NULL measure are absent."""
    long = percentile_rows(df, keys, by, measures)
    return by_measure(long, [*keys, *by], [f"{name}{suffix}" for name in measures])


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: name -> probability."""
    t = running_totals(df, by, value, {"n": F.count(F.lit(1))})

    def at(index: Column) -> Column:
        hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    out = []
    for name, q in points.items():
        position = F.lit(float(q)) * (F.col("n_total") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        weight = F.max(position - F.floor(position))
        out.append((low + (high - low) * weight).alias(name))
    return t.groupBy(*by).agg(*out)


def spearman(df: DataFrame, by: Sequence[str], keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group over rows where both sides are present."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *keys, x, y)
    rx = average_ranks(pairs.withColumnRenamed(x, "_v"), by, "_v").select(*by, F.col("_v").alias(x), F.col("rank_up").alias("_rx"))
    ry = average_ranks(pairs.withColumnRenamed(y, "_v"), by, "_v").select(*by, F.col("_v").alias(y), F.col("rank_up").alias("_ry"))
    joined = pairs.join(rx, [*by, x]).join(ry, [*by, y])
    return joined.groupBy(*by).agg(
        F.when((F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), F.corr("_rx", "_ry")).alias("rho"), F.count(F.lit(1)).alias("n")
    )


__all__ = ["binned", "running_totals", "unpivot", "average_ranks", "percentile_rows", "by_measure", "percentiles", "quantiles", "spearman"]

"""Column expressions shared by the operators. All stay inside whole-stage code generation."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den; NULL when either is NULL or the denominator is 0."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0)))


def positive_ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is above 0, else NULL."""
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0)))


def growth(current: Column, prior: Column) -> Column:
    """Change relative to the size of the prior value, so a loss that shrinks counts as growth."""
    return ratio(current - prior, F.abs(prior))


def change(current: Column, earlier: Column) -> Column:
    return ratio(current, earlier) - 1


def count_present(columns: Iterable[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def mean_present(columns: Iterable[Column]) -> Column:
    """Row-wise mean of the non-NULL columns; NULL when all are NULL."""
    columns = list(columns)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return ratio(total, count_present(columns).cast("double"))


def not_nan(column: Column) -> Column:
    """NaN and infinities become NULL: "missing" has one spelling in this package."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def clipped(column: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL (plain least/greatest would return the bound)."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Literal dictionary lookup; NULL for unknown or NULL keys."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


# fixed values: multipliers of the size letters in "$152B"
CAP_UNITS = {"M": 1e6, "B": 1e9, "T": 1e12}


def parse_market_cap(text: Column) -> Column:
    """`$152B` -> 1.52e11; anything else -> NULL."""
    pattern = r"^\$([\d.]+)([MBT])$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return number * lookup(F.regexp_extract(text, pattern, 2), CAP_UNITS)


# fixed values: right-closed market-cap classes
CAP_EDGES = [2e9, 10e9, 50e9, 200e9]
CAP_LABELS = ["<2B", "2-10B", "10-50B", "50-200B", ">200B"]


def cap_bucket(cap: Column) -> Column:
    out = F.when(~(cap > 0), F.lit(None).cast("string"))
    for edge, label in zip(CAP_EDGES, CAP_LABELS):
        out = out.when(cap <= edge, F.lit(label))
    return out.when(cap.isNotNull(), F.lit(CAP_LABELS[-1]))


def sic_bucket(sic: Column, digits: int) -> Column:
    """Leading digits of a 4-digit SIC code as a nullable int."""
    return F.floor(sic / F.lit(10 ** (4 - digits))).cast("int")


def log_cap(cap: Column) -> Column:
    return F.when(cap > 0, F.log10(cap))


def output_number(column: Column) -> Column:
    return F.round(not_nan(column), 4)


def output_date(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")

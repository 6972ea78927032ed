"""Column helpers shared by the operators.

Money is aggregated as whole cents in a long: sums are exact, do not depend on the order
in which partial aggregates are merged (so a retried task cannot change a report), and stay
in hash aggregation with fixed-width buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits after the point to which binary products are taken before money is rounded: far more than
#: amounts and factors have, far fewer than the noise of binary products.
EXACT = "decimal(38,10)"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period(yy: str | Column = "inforce_yy", mm: str | Column = "inforce_mm") -> Column:
    return (as_col(yy) * 100 + as_col(mm)).cast("int")


def period_year(p: str | Column) -> Column:
    return F.floor(as_col(p) / 100).cast("int")


def period_month(p: str | Column) -> Column:
    return (as_col(p) % 100).cast("int")


def month_index(yy: str | Column = "inforce_yy", mm: str | Column = "inforce_mm") -> Column:
    """Months since year 0: adding one is the next calendar month."""
    return (as_col(yy) * 12 + as_col(mm) - 1).cast("int")


def index_of_date(d: str | Column) -> Column:
    return month_index(F.year(as_col(d)), F.month(as_col(d)))


def index_year(i: str | Column) -> Column:
    return F.floor(as_col(i) / 12).cast("int")


def index_month(i: str | Column) -> Column:
    return (as_col(i) % 12 + 1).cast("int")


def month_end(yy: str | Column = "inforce_yy", mm: str | Column = "inforce_mm") -> Column:
    return F.last_day(F.make_date(as_col(yy), as_col(mm), F.lit(1)))


def cents(c: str | Column) -> Column:
    """Whole cents; null for what is no amount (NaN, infinite)."""
    return F.rint(as_col(c) * 100).try_cast("long")


def basis_points(c: str | Column) -> Column:
    """Exposure shares as ten-thousandths, for exact sums."""
    return F.rint(as_col(c) * 10000).try_cast("long")


def half_up(c: str | Column, scale: int = 2) -> Column:
    """Round half away from zero in decimal arithmetic; null for what is no amount."""
    return F.round(as_col(c).try_cast(EXACT), scale).cast("double")


def money_sum(c: str | Column) -> Column:
    return F.sum(cents(c)) / 100


def money_mean(c: str | Column) -> Column:
    return F.try_divide(F.sum(cents(c)), F.count(cents(c))) / 100


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, null for an empty whole."""
    return F.try_divide(part, whole) * 100


def rounded_ratio(num: Column, den: Column, scale: int) -> Column:
    """num / den (both whole numbers) rounded half away from zero, as a decimal."""
    wide = "decimal(20,0)"
    return F.round(F.try_divide(num.cast(wide), den.cast(wide)), scale)


def padded(number: str | Column, width: int) -> Column:
    """A number as text with leading zeros; a longer one is kept whole, never cut."""
    text = as_col(number).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def assignment_key(vehicle: str = "vehicle_no", driver: str = "driver_no") -> Column:
    """vehicle_driver; null when either part is null."""
    return F.concat(F.col(vehicle), F.lit("_"), F.col(driver))


def composite(scope: str, key: str) -> Column:
    """The counted key: the bare number, or the number within its policy."""
    if scope == "raw":
        return F.col(key)
    if scope == "composite":
        return F.when(F.col(key).isNotNull(), F.struct("policy", key))
    raise ValueError(f"unknown key scope: {scope}")


def age_at(birthday: str | Column, on: str | Column) -> Column:
    """Full years between a birthday and a date, by (month, day) comparison."""
    b, d = as_col(birthday), as_col(on)
    before = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return (F.year(d) - F.year(b) - before.cast("int")).cast("int")


def step_factor(age: str | Column, steps: dict, default: float = 1.0) -> Column:
    """Factor of the greatest step at or below the age; default below the first step."""
    a = as_col(age)
    out = None
    for key in sorted(steps, reverse=True):
        out = (F if out is None else out).when(a >= key, float(steps[key]))
    return F.lit(default) if out is None else out.otherwise(default)


def named_factor(name: str | Column, factors: dict, default: float = 1.0) -> Column:
    c = as_col(name)
    out = None
    for key, value in factors.items():
        out = (F if out is None else out).when(c == key, float(value))
    return F.lit(default) if out is None else out.otherwise(default)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, compared without case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem

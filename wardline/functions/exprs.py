"""Scalar column expressions. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000.0
US_PER_HOUR = 3_600_000_000.0

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: str | datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def day_lit(value: str | date) -> Column:
    return F.lit(str(value)).cast("date")


# --- text ---------------------------------------------------------------------------------------


def full_name(first: ColumnLike, last: ColumnLike) -> Column:
    """``a || ' ' || b``: NULL if either part is."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def concat_skip_null(*cols: ColumnLike) -> Column:
    """Joins the parts, a NULL part counting as the empty string."""
    return F.concat(*[F.coalesce(_col(c), F.lit("")) for c in cols])


def contains_ci(col: ColumnLike, term: str) -> Column:
    """Substring test without case; ``%`` and ``_`` in the term stand for themselves."""
    return F.lower(_col(col)).contains(term.lower())


# --- time ---------------------------------------------------------------------------------------


def day(col: ColumnLike) -> Column:
    return F.to_date(_col(col))


def trunc_ntz(unit: str, col: ColumnLike) -> Column:
    """``date_trunc`` that keeps the zone-free type; weeks start on Monday."""
    return F.date_trunc(unit, _col(col)).cast("timestamp_ntz")


def hour_of(col: ColumnLike) -> Column:
    return F.hour(_col(col)).cast("bigint")


def hour_or(col: ColumnLike, default: int = 12) -> Column:
    return F.coalesce(F.hour(_col(col)), F.lit(default)).cast("bigint")


def dow(col: ColumnLike) -> Column:
    """Day of week with Sunday = 0."""
    return (F.dayofweek(_col(col)) - 1).cast("bigint")


# Day names in the order of dow().
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def day_name(col: ColumnLike) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.dayofweek(_col(col)))


def weekday_flag(col: ColumnLike) -> Column:
    return F.when(dow(col).isin(0, 6), "Weekend").otherwise("Weekday")


def elapsed_us(start: ColumnLike, end: ColumnLike) -> Column:
    """Exact elapsed time in whole microseconds."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def los_us() -> Column:
    return elapsed_us("admission_date", "discharge_date")


def los_days(start: ColumnLike = "admission_date", end: ColumnLike = "discharge_date") -> Column:
    return elapsed_us(start, end) / F.lit(US_PER_DAY)


def los_hours(start: ColumnLike = "admission_date", end: ColumnLike = "discharge_date") -> Column:
    return elapsed_us(start, end) / F.lit(US_PER_HOUR)


def shift(col: ColumnLike, **parts: int) -> Column:
    """``shift("t", days=-30)``: a timestamp moved by an interval."""
    names = {"years": 0, "months": 1, "weeks": 2, "days": 3, "hours": 4, "mins": 5, "secs": 6}
    args: list[Column | None] = [F.lit(0)] * 7
    for name, amount in parts.items():
        args[names[name]] = F.lit(amount)
    return (_col(col) + F.make_interval(*args)).cast("timestamp_ntz")


def age_years(dob: ColumnLike, as_of: str) -> Column:
    """Completed years on ``as_of``: one less while this year's birthday is still to come."""
    today = date.fromisoformat(as_of[:10])
    birth = _col(dob)
    month_day = F.month(birth) * 100 + F.dayofmonth(birth)
    before_birthday = month_day > today.month * 100 + today.day
    return (F.lit(today.year) - F.year(birth) - before_birthday.cast("int")).cast("bigint")


def month_index(later: ColumnLike, earlier: ColumnLike, wrap: bool = False) -> Column:
    """Calendar months between two dates; ``wrap`` keeps only the 0-11 part."""
    a, b = _col(later), _col(earlier)
    months = ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("bigint")
    return months % 12 if wrap else months


# --- numbers ------------------------------------------------------------------------------------


def round_n(col: ColumnLike, digits: int) -> Column:
    return F.round(_col(col).cast("double"), digits)


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as double, NULL for a zero denominator."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def pct(num: ColumnLike, den: ColumnLike, digits: int = 2) -> Column:
    return F.round(ratio(num, den) * 100, digits)


def clip(col: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds a number; NULL stays NULL."""
    out = c = _col(col)
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    return out


def differs(a: ColumnLike, b: ColumnLike) -> Column:
    """Null-safe inequality: NULL equals NULL and differs from every value."""
    return ~_col(a).eqNullSafe(_col(b))


# --- aggregates ---------------------------------------------------------------------------------


def mean_of_us(us: ColumnLike, unit: float) -> Column:
    """Mean of a microsecond column in ``unit`` microseconds.

    Seconds and the rest are added up as longs: the result does not depend on the order in
    which partitions are merged, and a sum over 10^13 stays still fits.
    """
    c = _col(us)
    seconds = F.sum(F.call_function("div", c, F.lit(1_000_000))) + F.sum(c % 1_000_000) / F.lit(1e6)
    return seconds / F.nullif(F.count(c), F.lit(0)) / F.lit(unit / 1e6)


def weighted_mean_of_us(us: ColumnLike, times: ColumnLike, unit: float) -> Column:
    """``mean_of_us`` of a column in which each value stands for as many as ``times`` says."""
    c, n = _col(us), _col(times)
    seconds = F.sum(F.call_function("div", c, F.lit(1_000_000)) * n) + F.sum((c % 1_000_000) * n) / F.lit(1e6)
    return seconds / F.nullif(F.sum(F.when(c.isNotNull(), n)), F.lit(0)) / F.lit(unit / 1e6)


def mean_days(us: ColumnLike) -> Column:
    return mean_of_us(us, US_PER_DAY)


def mean_hours(us: ColumnLike) -> Column:
    return mean_of_us(us, US_PER_HOUR)


def total_days(us: ColumnLike) -> Column:
    c = _col(us)
    seconds = F.sum(F.call_function("div", c, F.lit(1_000_000))) + F.sum(c % 1_000_000) / F.lit(1e6)
    return seconds / F.lit(86400)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def count_type(kind: str) -> Column:
    return count_where(F.col("admission_type") == kind)


# --- categories ---------------------------------------------------------------------------------


def map_case(col: ColumnLike, mapping: Mapping, default: object = None) -> Column:
    """Simple CASE; without a default unmatched values give NULL."""
    out = None
    for key, value in mapping.items():
        cond = _col(col) == key
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def buckets(col: ColumnLike, bounds: Sequence[tuple[float, str]], last: str) -> Column:
    """First bucket whose exclusive upper bound lies above the value; NULL goes to ``last``."""
    out = None
    for upper, label in bounds:
        cond = _col(col) < upper
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(last)


# Bucket labels and bounds of the published reports.
AGE_GROUPS = [(18, "0-17"), (35, "18-34"), (55, "35-54"), (75, "55-74")], "75+"
AGE_GROUPS_LONG = (
    [(18, "0-17 (Pediatric)"), (35, "18-34 (Young Adult)"), (55, "35-54 (Middle Age)"), (75, "55-74 (Senior)")],
    "75+ (Elderly)",
)
AGE_GROUPS_STAGING = [(18, "Pediatric"), (65, "Adult")], "Senior"
LOS_BUCKETS = [(1, "0-1 day"), (3, "1-3 days"), (7, "3-7 days")], "7+ days"
VISIT_BUCKETS = [(1, "0 visits"), (2, "1 visit"), (4, "2-3 visits"), (6, "4-5 visits")], "6+ visits"
INSURANCE_CATEGORY = {
    "Private Insurance": "Commercial",
    "Private": "Commercial",
    "Medicare": "Government",
    "Medicaid": "Government",
    "Self-Pay/Uninsured": "Self-Pay",
    "Uninsured": "Self-Pay",
}
SEVERITY = {
    "Cardiac": 5,
    "Respiratory": 4,
    "Neurological": 4,
    "Orthopedic": 3,
    "Gastrointestinal": 3,
    "Infectious Disease": 4,
    "Endocrine": 3,
    "Renal": 4,
    "Psychiatric": 3,
    "General": 2,
}
DEFAULT_SEVERITY = 2


def los_category(los: ColumnLike) -> Column:
    """Closed upper bounds at 3 and 7 days; an open stay has no length and falls in the last class."""
    c = _col(los)
    return (
        F.when(c < 1, "Short (0-1 day)")
        .when(c <= 3, "Medium (1-3 days)")
        .when(c <= 7, "Extended (3-7 days)")
        .otherwise("Long (7+ days)")
    )


def insurance_category(col: ColumnLike) -> Column:
    return map_case(col, INSURANCE_CATEGORY)


def severity(col: ColumnLike) -> Column:
    return map_case(col, SEVERITY, DEFAULT_SEVERITY).cast("bigint")


def bucket_order(col: ColumnLike, labels: Sequence[str]) -> Column:
    """Position of a label in ``labels``, counted from 1."""
    return F.array_position(F.array(*[F.lit(v) for v in labels]), _col(col)).cast("bigint")


def labels_of(spec: tuple) -> list[str]:
    bounds, last = spec
    return [label for _, label in bounds] + [last]


def json_field(col: ColumnLike, path: str) -> Column:
    return F.get_json_object(_col(col), f"$.{path}")

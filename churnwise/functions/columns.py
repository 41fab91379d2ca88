"""Column helpers: scalar functions and predicates that stay JVM-side.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``,
so they fuse into whole-stage codegen with the surrounding projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# G1 -------------------------------------------------------------------------
def clip(col, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; a null stays null."""
    out = _c(col)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(out)


# G2 -------------------------------------------------------------------------
def round_even(col, digits: int = 0) -> Column:
    """Round half to even (0.125 -> 0.12)."""
    return F.bround(_c(col), digits)


# G4 -------------------------------------------------------------------------
def per_unit(col, divisor: float) -> Column:
    """The value in a larger unit: an amount of 2,500,000 with 1e6 is 2.5."""
    return _c(col).cast("double") / F.lit(float(divisor))


# G5 -------------------------------------------------------------------------
def cut(col, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed binning: (e0, e1], (e1, e2], ...; outside or null gives null.

    With ``include_lowest`` the first bin is [e0, e1].
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = _c(col)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast(T.StringType()))


# G6 -------------------------------------------------------------------------
def band(col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed banding with open ends: x < e0, e0 <= x < e1, ..., x >= e_last."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need len(edges)+1 labels")
    x = _c(col)
    expr = F.when(x.isNull(), F.lit(None).cast(T.StringType()))
    for edge, label in zip(edges, labels):
        expr = expr.when(x < F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


# G7 -------------------------------------------------------------------------
def encode(col, mapping: Mapping[str, int], default: int) -> Column:
    """Code lookup with a default for unknown and null values."""
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(lookup, _c(col)), F.lit(default))


# G8 / S11 ---------------------------------------------------------------------
def null_false(cond: Column) -> Column:
    """A comparison with a missing value counts as False."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """Boolean to 0/1 with null as 0."""
    return null_false(cond).cast("int")


def equals_flag(col, value) -> Column:
    return flag(_c(col) == F.lit(value))


# G9 -------------------------------------------------------------------------
def to_class(prob, threshold: float = 0.5) -> Column:
    """Probability to class; a tie goes to 0."""
    return flag(_c(prob) > F.lit(threshold))


# G10 ------------------------------------------------------------------------
def month(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


# G11 ------------------------------------------------------------------------
def whole_days(start, end) -> Column:
    """Whole 24-hour days from start to end (20:00 to 10:00 two dates later is 1)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


# G12 ------------------------------------------------------------------------
def zscore(col, mean: Column, std: Column) -> Column:
    return F.try_divide(_c(col) - mean, std)


# G13 ------------------------------------------------------------------------
def percent_text(col, decimals: int = 1, factor: float = 100.0) -> Column:
    return F.format_string(f"%.{decimals}f%%", _c(col) * F.lit(factor))


# G14 ------------------------------------------------------------------------
def thousands(col, decimals: int = 0) -> Column:
    return F.format_number(_c(col), decimals)


# G15 ------------------------------------------------------------------------
def title_case(col) -> Column:
    """snake_case name to Title Case."""
    return F.initcap(F.regexp_replace(_c(col), "_", " "))


def upper_name(col) -> Column:
    """snake_case name in capitals, as the factor headings show it."""
    return F.upper(F.regexp_replace(_c(col), "_", " "))


# G16 ------------------------------------------------------------------------
def padded_key(col, prefix: str = "CUST_", width: int = 5) -> Column:
    return F.format_string(f"{prefix}%0{width}d", _c(col))


# B1 ---------------------------------------------------------------------------
def select_available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[c for c in wanted if c in present])


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in wanted if c in present]


# B6 ---------------------------------------------------------------------------
def above(col, threshold: float, inclusive: bool = False) -> Column:
    x = _c(col)
    return null_false(x >= F.lit(threshold) if inclusive else x > F.lit(threshold))


def high_risk(df: DataFrame, col: str = "churn_probability", threshold: float = 0.7,
              inclusive: bool = False) -> DataFrame:
    """Rows above a threshold: ``p > 0.7`` (dashboard) or ``score >= 70`` (pages)."""
    return df.filter(above(col, threshold, inclusive))


# B9 ---------------------------------------------------------------------------
def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


# B10 --------------------------------------------------------------------------
def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("customer_id",)) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


# B11 --------------------------------------------------------------------------
def as_of_stamp(as_of) -> Column:
    """The as-of moment of a report as a column, from a value or a scalar subquery."""
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).alias("as_of")

"""Numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Cutoffs

_NUMERIC = (T.NumericType,)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _NUMERIC)


def numeric_columns(df: DataFrame, of: Sequence[str] | None = None) -> list[str]:
    """Columns by type: numbers."""
    return [c for c in of or df.columns if is_numeric(df, c)]


def text_columns(df: DataFrame, of: Sequence[str] | None = None) -> list[str]:
    """Columns by type: strings."""
    return [c for c in of or df.columns if isinstance(df.schema[c].dataType, T.StringType)]


def number(c: Column) -> Column:
    """As a double, NaN as null, so that averages and quantiles agree everywhere."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def safe_float(c: Column) -> Column:
    """A number from text, NaN where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def cut(x: Column, breaks: Column) -> Column:
    """Right-closed bins: the number of breaks below x; null falls into bin 0."""
    return F.size(F.filter(breaks, lambda b: b < x))


def present(df: DataFrame, name: str) -> Column:
    """Presence of a value: non-zero for numbers, non-null for all else."""
    c = F.col(name)
    return F.coalesce(number(c), F.lit(0.0)) != 0 if is_numeric(df, name) else c.isNotNull()


def severity(x: Column, cut_: Cutoffs) -> Column:
    return (
        F.when(x < cut_.mild, "NONE").when(x < cut_.moderate, "MILD").when(x < cut_.severe, "MODERATE").when(x.isNotNull(), "SEVERE").otherwise("NONE")
    )


def severity_of(x: float, cut_: Cutoffs) -> str:
    return "NONE" if not x >= cut_.mild else "MILD" if x < cut_.moderate else "MODERATE" if x < cut_.severe else "SEVERE"


def linspace(low: Column, high: Column, n: int) -> Column:
    """n + 1 equally spaced edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: low + (high - low) * k / n)


def midpoints(edges: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: (F.element_at(edges, k) + F.element_at(edges, k + 1)) / 2)

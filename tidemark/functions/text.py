"""Text and label functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DATE_FORMATS, MONTHS, NULL_LEVEL, NULL_TOKENS, POSITIVE_HINTS, SHORT_TESTS, STABLE, TREATMENTS, UNTREATED


def normalise(c: Column) -> Column:
    """Lower case, outer white space off, hyphens and underscores to spaces, runs of white space to one.

    The outer white space goes first, so a leading hyphen leaves a leading space behind.
    """
    stripped = F.regexp_replace(F.lower(c.cast("string")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, "[-_]", " "), r"\s+", " ")


def level(c: Column) -> Column:
    """The normalised category, null as a level of its own."""
    return F.coalesce(normalise(c), F.lit(NULL_LEVEL))


def null_tokens(c: Column) -> Column:
    """Text that stands for null becomes null."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def date_shape(pattern: str) -> str:
    """A regular expression that all text of a date pattern matches: digits, dashes and letters by position."""
    parts = {"yyyy": "[+-]?[0-9]{4,}", "yy": "[0-9]{2}", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}", "dd": "[0-9]{2}"}
    return re.sub("yyyy|yy|MMM|MM|dd", lambda m: parts[m[0]], pattern)


def parses_as_date(c: Column) -> Column:
    """Whether a string parses under any of the known formats: one test of its shape, then only the formats of that shape."""
    shapes: dict[str, list[str]] = {}
    for f in DATE_FORMATS:
        shapes.setdefault(date_shape(f), []).append(f)
    tried = F.lit(False)
    for shape, formats in shapes.items():
        tried = F.when(c.rlike(f"^{shape}$"), F.coalesce(*[F.try_to_date(c, f) for f in formats]).isNotNull()).otherwise(tried)
    return F.when(c.rlike(f"^(?:{'|'.join(shapes)})$"), tried).otherwise(False)


def month_number(label: Column) -> Column:
    """Month from its English abbreviation, or from a number; anything else is null."""
    names = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, k)])
    return F.coalesce(F.try_element_at(names, label), label.try_cast("int"))


def month_key(label: Column) -> Column:
    """(year, month) of ``YY-Mon`` or ``YYYY-MM`` labels, ordered by time: first part and last part of the label."""
    parts = F.split(label, "-")
    return F.struct(parts[0].try_cast("int").alias("y"), month_number(F.element_at(parts, -1)).alias("m"))


def positive_label(labels: list[str]) -> str | None:
    """The positive one of exactly two labels: the first hint that begins a label wins, labels in order."""
    found = sorted(labels)
    if len(found) != 2:
        raise ValueError(f"a binary target needs two labels, not {found}")
    return next((x for hint in POSITIVE_HINTS for x in found if x.lower().startswith(hint)), found[-1])


def positive_label_of_view(labels: list[str]) -> str:
    """The positive label as the score view picks it: the first that is a hint as it stands, whatever the case, else the last one seen."""
    return next((x for x in labels if x.lower() in POSITIVE_HINTS), labels[-1])


def short_test_name(c: Column) -> Column:
    """Test names as charts show them."""
    out = c
    for long, short in SHORT_TESTS:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def treatment_name(c: Column) -> Column:
    """Treatments as tables show them; a dash for none."""
    names = F.create_map(*[F.lit(x) for kv in TREATMENTS.items() for x in kv])
    told = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(names, told), F.when(told.isin("none", STABLE, UNTREATED), "—").otherwise(F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))))

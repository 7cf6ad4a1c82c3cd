"""Column profiles and semantic types."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import is_numeric, number, numeric_columns, text_columns
from tidemark.functions.text import parses_as_date

#: Aggregate expressions in one job: wide tables go in pieces, so that generated methods stay small.
PIECE = 200
STATS = ("mean", "std", "p25", "p75", "skewness")  # in the order of all tables of statistics


def _unpivoted(df: DataFrame, cols: Sequence[str], exprs: dict[str, callable]) -> DataFrame:
    """(feature, *names): global aggregates of many columns as rows; partial aggregates only, no shuffle of rows."""
    parts = []
    size = max(1, PIECE // max(1, len(exprs)))
    for at in range(0, len(cols), size):
        some = cols[at : at + size]
        wide = df.agg(*[e(c).alias(f"{n}_{k}") for k, c in enumerate(some) for n, e in exprs.items()])
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{k}").alias(n) for n in exprs]) for k, c in enumerate(some)])
        parts.append(wide.select(F.explode(pairs).alias("p")).select("p.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Columns whose sketches one task holds at a time, and their accuracy: ranks are known to within one in so many.
SKETCHED, ACCURACY = 64, 10_000
#: Distinct values of a bracket that one task sorts at most, and the parts that a further scan cuts a larger bracket into.
BRACKET, CUTS = 1 << 18, 64


@dataclass(frozen=True)
class Bracket:
    """Where a wanted rank lies: between two values, each of them in it unless ``open``; None is unbounded."""

    rank: int
    part: float
    lo: float | None = None
    hi: float | None = None
    lo_open: bool = False
    hi_open: bool = False

    def below(self, x: Column) -> Column:
        return F.lit(False) if self.lo is None else (x <= F.lit(self.lo) if self.lo_open else x < F.lit(self.lo))

    def above(self, x: Column) -> Column:
        return F.lit(False) if self.hi is None else (x >= F.lit(self.hi) if self.hi_open else x > F.lit(self.hi))

    def within(self, x: Column) -> Column:
        return x.isNotNull() & ~self.below(x) & ~self.above(x)

    def narrowed(self, below: int, inside: int, at_lo: int, at_hi: int, grid: list[float]) -> Bracket:
        """A smaller bracket, from the rows below and inside this one, those at its ends, and ``CUTS`` parts of the rows inside."""
        at = (self.rank - below) / inside * CUTS
        first, last = math.floor(at) - 1, math.ceil(at) + 1
        lo = grid[first] if first >= 0 else self.lo
        hi = grid[last] if last <= CUTS else self.hi
        new = replace(self, lo=lo, hi=hi, lo_open=self.lo_open and lo == self.lo, hi_open=self.hi_open and hi == self.hi)
        if new != self:
            return new
        # many rows share an end: either the rank is among them, or they leave
        if at_lo and self.rank < below + at_lo:
            return replace(self, hi=self.lo, hi_open=False)
        if at_hi and self.rank >= below + inside - at_hi:
            return replace(self, lo=self.hi, lo_open=False)
        return replace(self, lo_open=self.lo is not None, hi_open=self.hi is not None)


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float], extras: dict[str, Callable[[Column], Column]] | None = None) -> dict[str, tuple[list[float] | None, list]]:
    """{name: (quantiles, extras)}: exact quantiles with linear interpolation of many number columns, and other aggregates of them.

    Sketches bracket each wanted rank (and give the extras). A bracket that may hold more than ``BRACKET`` distinct values is cut down by further
    scans, some sixteen times each, until it does not. Then one scan counts the values below each bracket and groups the few within, and
    running sums pick the wanted ranks: two jobs up to some 10^8 rows, one more for each factor of sixteen, and no task ever sorts more than
    ``BRACKET`` values of a rank. Where a bracket misses its rank, that one starts anew without bounds, so the result is exact in any case.
    """
    extras, out = extras or {}, {}
    names = list(values)
    for at in range(0, len(names), SKETCHED):
        some = names[at : at + SKETCHED]
        margin = 4 / ACCURACY
        asked = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
        told = df.agg(
            *[F.count(values[c]).alias(f"n{k}") for k, c in enumerate(some)], *[F.percentile_approx(values[c], asked, ACCURACY).alias(f"q{k}") for k, c in enumerate(some)],
            *[e(values[c]).alias(f"e{k}_{n}") for k, c in enumerate(some) for n, e in extras.items()],
        ).first()
        found = {c: [told[f"e{k}_{n}"] for n in extras] for k, c in enumerate(some)}
        wanted, rows = {}, {}
        for k, c in enumerate(some):
            n, edges = told[f"n{k}"], told[f"q{k}"]
            if not n:
                out[c] = (None, found[c])
                continue
            for i, p in enumerate(probs):
                lo = edges[i] if p > margin else None
                hi = edges[len(probs) + i] if p < 1 - margin else None
                rank = (n - 1) * p
                wanted[c, i] = Bracket(math.floor(rank), rank - math.floor(rank), lo, hi)
                rows[c, i] = math.ceil(2 * (margin + 1 / ACCURACY) * n)  # ties aside, which are one value
        picked: dict[tuple[str, int], float] = {}
        anew: set[tuple[str, int]] = set()
        while wanted:
            wanted = _narrowed(df, values, wanted, {key for key in wanted if rows[key] > BRACKET})
            got = _picked(df, values, wanted)
            picked |= got
            left = set(wanted) - set(got)
            if left & anew:
                raise RuntimeError(f"no value has the rank wanted of {sorted(left & anew)}: the data changed between two reads")
            anew = left
            wanted = {key: Bracket(wanted[key].rank, wanted[key].part) for key in left}
            rows |= {key: told[f"n{some.index(key[0])}"] for key in left}
        for c in some:
            if c not in out:
                out[c] = ([picked[c, i] for i in range(len(probs))], found[c])
    return out


def _narrowed(df: DataFrame, values: dict[str, Column], wanted: dict[tuple[str, int], Bracket], large: set[tuple[str, int]]) -> dict[tuple[str, int], Bracket]:
    """The brackets, with those in ``large`` cut down until they hold at most ``BRACKET`` distinct values; a rank that is outside its bracket keeps it."""
    wanted = dict(wanted)
    grid = [i / CUTS for i in range(CUTS + 1)]
    while large:
        keys, told = sorted(large), {}
        for at in range(0, len(keys), PIECE // 6):
            asked = []
            for k, key in enumerate(keys[at : at + PIECE // 6]):
                b, x = wanted[key], values[key[0]]
                inner = F.when(b.within(x), x)
                ends = [F.count_if(inner == F.lit(e)) if e is not None else F.lit(0) for e in (b.lo, b.hi)]
                stats = [F.count_if(b.below(x)), F.count(inner), F.approx_count_distinct(inner, 0.02), *ends, F.percentile_approx(inner, grid, 1000)]
                asked += [a.alias(f"s{k}_{i}") for i, a in enumerate(stats)]
            row = df.agg(*asked).first()
            told |= {key: [row[f"s{k}_{i}"] for i in range(6)] for k, key in enumerate(keys[at : at + PIECE // 6])}
        for key in keys:
            below, inside, distinct, at_lo, at_hi, parts = told[key]
            if distinct <= BRACKET or not below <= wanted[key].rank < below + inside:
                large = large - {key}
            else:
                wanted[key] = wanted[key].narrowed(below, inside, at_lo, at_hi, parts)
    return wanted


def _place(ends: list[float], inside: set[int]) -> Callable[[Column], Column]:
    """The cell of a value as ``_picked`` numbers them, found by halves; -1 less the cell where it isn't one of ``inside``."""

    def run(x: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        value, kept = x.fill_null(0).to_numpy(zero_copy_only=False), np.zeros(2 * len(ends) + 1, bool)
        kept[list(inside)] = True
        cell = np.searchsorted(np.array(ends, float), value) + np.searchsorted(np.array(ends, float), value, side="right")
        return pa.array(np.where(kept[cell], cell, -1 - cell).astype(np.int32), mask=x.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "int")


def _picked(df: DataFrame, values: dict[str, Column], wanted: dict[tuple[str, int], Bracket]) -> dict[tuple[str, int], float]:
    """Interpolated values at the wanted ranks; left out where the bracket misses.

    The ends of a column's brackets cut its values into cells, numbered by 2 for each end below, and 1 more at an end. A row is looked up once, however
    many ranks are wanted; cells are counted, and those within a bracket keep their distinct values. One scan and one shuffle give both.
    """
    keys, names = list(wanted), list(dict.fromkeys(c for c, _ in wanted))
    ends = {c: sorted({e for (name, _), b in wanted.items() if name == c for e in (b.lo, b.hi) if e is not None}) for c in names}
    cells = {c: {e: 2 * k + 1 for k, e in enumerate(ends[c])} for c in names}
    rows, inside = [], {k: set() for k in range(len(names))}
    for k, (c, i) in enumerate(keys):
        b = wanted[c, i]
        lo = 0 if b.lo is None else cells[c][b.lo] + b.lo_open
        hi = 2 * len(ends[c]) if b.hi is None else cells[c][b.hi] - b.hi_open
        rows.append((k, names.index(c), lo, hi))
        inside[names.index(c)] |= set(range(lo, hi + 1))
    one = [F.struct(F.lit(k).alias("c"), values[c].alias("x"), _place(ends[c], inside[k])(values[c].cast("double")).alias("at")) for k, c in enumerate(names)]
    long = df.select(F.explode(F.array(*one)).alias("s")).select("s.*").where("x IS NOT NULL")
    long = long.select("c", "x", F.expr("CASE WHEN at < 0 THEN -1 - at ELSE at END AS cell"), F.expr("CASE WHEN at >= 0 THEN x END AS v"))
    counted = long.groupBy("c", "cell", "v").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x")).persist()
    brackets = F.broadcast(df.sparkSession.createDataFrame(rows, "key int, b int, lo int, hi int"))
    told = counted.join(brackets, F.col("c") == F.col("b"))
    sides = told.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("cell") < F.col("lo"), F.col("n"))), F.lit(0)).alias("below"), F.min(F.when(F.col("cell") > F.col("hi"), F.col("x"))).alias("next"))
    inner = told.where("cell BETWEEN lo AND hi").select("key", "x", "n")
    ranks = F.array(*[F.lit(w.rank).cast("long") for w in wanted.values()])
    rank = F.element_at(ranks, F.col("key") + 1)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = inner.withColumn("cum", before).join(F.broadcast(sides), "key").withColumn("cum", F.col("cum") + F.col("below"))
    told = joined.groupBy("key").agg(
        F.first("below").alias("below"), F.first("next").alias("next"), F.max("cum").alias("upto"),
        F.min(F.when(F.col("cum") > rank, F.col("x"))).alias("v0"), F.min(F.when(F.col("cum") > rank + 1, F.col("x"))).alias("v1"),
    )
    try:
        found = told.collect()
    finally:
        counted.unpersist()
    out = {}
    for r in found:
        want = wanted[keys[r["key"]]]
        v1 = r["v1"] if r["v1"] is not None else r["next"]
        if r["below"] <= want.rank < r["upto"] and (not want.part or v1 is not None):
            out[keys[r["key"]]] = r["v0"] if not want.part else r["v0"] * (1 - want.part) + v1 * want.part
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(feature, q): exact quantiles with linear interpolation, null where a column has no values. A row per column."""
    found = exact_quantiles(df, {c: number(F.col(c)) for c in cols}, probs)
    return df.sparkSession.createDataFrame([(c, found[c][0]) for c in cols], "feature string, q array<double>")


_MOMENTS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "std": F.stddev_samp, "skewness": F.skewness}


def _stats_rows(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple]:
    found = exact_quantiles(df, values, [0.25, 0.75], _MOMENTS)
    return {c: (e[0], e[1], *(q or (None, None)), e[2]) for c, (q, e) in found.items()}


def _sides(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both splits as one table with columns a<k> for train's numbers and b<k> for test's, so that jobs read both at once."""
    x = [number(F.col(c)) for c in cols]
    none = F.lit(None).cast("double")
    side = lambda df, a: df.select(*[(v if a else none).alias(f"a{k}") for k, v in enumerate(x)], *[(none if a else v).alias(f"b{k}") for k, v in enumerate(x)])
    return side(train, True).union(side(test, False))


def both_quantiles(train: DataFrame, test: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(feature, a_q, b_q): ``quantiles`` of train and test side by side, both in the same jobs."""
    both = _sides(train, test, cols)
    found = exact_quantiles(both, {c: F.col(c) for c in both.columns}, probs)
    return train.sparkSession.createDataFrame([(c, found[f"a{k}"][0], found[f"b{k}"][0]) for k, c in enumerate(cols)], "feature string, a_q array<double>, b_q array<double>")


def numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, std, p25, p75, skewness): sample deviation, population skewness, exact quartiles. A row per column."""
    found = _stats_rows(df, {c: number(F.col(c)) for c in cols})
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in cols], "feature string, mean double, std double, p25 double, p75 double, skewness double")


def both_stats(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, a_mean, .., b_mean, ..): ``numeric_stats`` of train and test side by side, both in the same jobs."""
    both = _sides(train, test, cols)
    found = _stats_rows(both, {c: F.col(c) for c in both.columns})
    names = ", ".join(f"{s}_{n} double" for s in "ab" for n in STATS)
    return train.sparkSession.createDataFrame([(c, *found[f"a{k}"], *found[f"b{k}"]) for k, c in enumerate(cols)], f"feature string, {names}")


def null_zero_rates(df: DataFrame, cols: Sequence[str], config: Config = DEFAULT) -> DataFrame:
    """(feature, null_rate, zero_rate); a null counts as a zero in a numeric column unless the switch says otherwise."""

    def zero(c: str):  # noqa: ANN202
        if not is_numeric(df, c):
            return F.lit(0.0) + F.sum(F.lit(0.0))
        x = number(F.col(c))
        return F.avg((F.coalesce(x, F.lit(0.0)) == 0).cast("int")) if config.zero_counts_null else F.avg(F.coalesce((x == 0).cast("int"), F.lit(0)))

    null = lambda c: F.avg((number(F.col(c)) if is_numeric(df, c) else F.col(c)).isNull().cast("int"))
    return _unpivoted(df, list(cols), {"null_rate": null, "zero_rate": zero}).fillna(0.0)


def distinct_values(df: DataFrame, cols: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """(feature, n_unique, date_rate): distinct counts with null as a value, and for ``texts`` the share of distinct non-null values that are dates.

    All columns in one shuffle of distinct values, as two 64-bit hashes each and whether it is a date: 128 bits tell values apart at any
    size that can be stored, and a value's text is never shuffled.
    """

    def seen(k: int, c: str) -> Column:
        x = F.col(f"`{c}`")
        x = x + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x  # minus zero is zero
        date = F.when(x.isNotNull(), parses_as_date(x)) if c in texts else F.lit(None)
        x = F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(k), x, F.lit(1)).alias("g")))
        return F.struct(F.lit(k).alias("k"), x["h"].alias("h"), x["g"].alias("g"), date.cast("tinyint").alias("date"))

    rows = df.select(F.explode(F.array(*[seen(k, c) for k, c in enumerate(cols)])).alias("p")).select("p.*")
    found = rows.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n_unique"), F.avg("date").alias("date_rate"))
    every = df.sparkSession.createDataFrame(list(enumerate(cols)), "k int, feature string")
    return F.broadcast(every).join(found, "k", "left").select("feature", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "date_rate")


def cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_unique): distinct counts with null as a value."""
    return distinct_values(df, cols).select("feature", "n_unique")


def bounded_cardinality(df: DataFrame, cols: Sequence[str], rows: int, config: Config = DEFAULT, texts: Sequence[str] = ()) -> DataFrame:
    """(feature, n_unique, date_rate) as ``distinct_values``, but exact only for columns whose sketched count is within a tenth of a cut-off of the rules, or
    small, and for texts that are not surely near-unique; of those the date rate is not asked, as an earlier rule settles them.

    The sketch has fixed memory and shuffles nothing but itself, so unique ids of a huge table are never shuffled.
    """
    told = df.agg(*[F.approx_count_distinct(F.col(c), 0.01).alias(f"a{k}") for k, c in enumerate(cols)], *[F.max(F.col(c).isNull().cast("long")).alias(f"n{k}") for k, c in enumerate(cols)]).first()
    guess = {c: (told[f"a{k}"] or 0) + (told[f"n{k}"] or 0) for k, c in enumerate(cols)}
    cuts = (config.high_cardinality, config.int_category_levels, config.int_category_ratio * rows, config.metadata_ratio * rows)
    unique = {c for c in cols if guess[c] > 1.04 * config.metadata_ratio * rows}  # four deviations of the sketch
    near = [c for c in cols if c not in unique and (guess[c] < 10_000 or c in texts or any(abs(guess[c] - x) <= 0.1 * x for x in cuts))]
    rest = df.sparkSession.createDataFrame([(c, int(guess[c]), None) for c in cols if c not in near], "feature string, n_unique long, date_rate double")
    return distinct_values(df, near, [c for c in texts if c in near]).union(rest) if near else rest


def date_parse_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, date_rate) of the text columns: share of all distinct non-null values that are dates; columns without values are left out."""
    return distinct_values(df, cols, cols).select("feature", "date_rate").where("date_rate IS NOT NULL")


def kinds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, ordinal, dtype, kind): physical type and its family."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.StringType):
            return "string"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        if isinstance(t, T.IntegralType):
            return "integer"
        return "float" if isinstance(t, T.NumericType) else "other"

    rows = [(c, k, df.schema[c].dataType.simpleString(), kind(df.schema[c].dataType)) for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, ordinal int, dtype string, kind string")


def profile(df: DataFrame, roles: dict[str, str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row per column: ordinal, dtype, n_rows, n_unique, null and zero rates, statistics, and feature_type.

    ``roles`` names structural columns: {"CustomerID": "metadata", ...}. Rules in order, the first that holds wins: structural,
    constant, metadata, time, sparse, high cardinality, categorical, numerical; other types are unsupported.
    """
    roles = roles or {}
    cols = df.columns
    rows = df.count()
    numbers, texts = numeric_columns(df), text_columns(df)
    distinct = distinct_values(df, cols, texts) if config.cardinality == "exact" else bounded_cardinality(df, cols, rows, config, texts)
    told = kinds(df, cols).join(distinct, "feature").join(null_zero_rates(df, cols, config), "feature")
    if numbers:
        told = told.join(numeric_stats(df, numbers), "feature", "left")
    else:
        told = told.select("*", *[F.lit(None).cast("double").alias(s) for s in STATS])
    return classify(told.withColumn("n_rows", F.lit(rows)), roles, config)


def classify(told: DataFrame, roles: dict[str, str], config: Config = DEFAULT) -> DataFrame:
    """Adds feature_type; statistics stay only for structural, sparse and numerical columns."""
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("feature")) if roles else F.lit(None).cast("string")
    share = F.col("n_unique") / F.greatest(F.col("n_rows"), F.lit(1))
    labelled = F.col("kind").isin("string", "boolean")
    kind = (
        F.when(role.isNotNull(), role)
        .when(F.col("n_unique") <= 1, "constant")
        .when((F.col("kind") == "string") & (share > config.metadata_ratio), "metadata")
        .when((F.col("kind") == "date") | (F.coalesce("date_rate", F.lit(0.0)) >= config.date_parse_rate), "time")
        .when((F.col("null_rate") > config.sparse_null) | (F.col("kind").isin("integer", "float") & (F.col("zero_rate") > config.sparse_zero)), "sparse")
        .when(labelled & (F.col("n_unique") > config.high_cardinality), "high_cardinality")
        .when(labelled | ((F.col("kind") == "integer") & (F.col("n_unique") <= config.int_category_levels) & (share < config.int_category_ratio)), "categorical")
        .when(F.col("kind").isin("integer", "float"), "numerical")
        .otherwise("unsupported")
    )
    out = told.withColumn("feature_type", kind)
    keep = role.isNotNull() | F.col("feature_type").isin("sparse", "numerical")
    return out.select(
        "ordinal", F.col("feature").alias("name"), "dtype", "feature_type", F.col("n_rows").cast("long").alias("n_rows"), "n_unique", "null_rate", "zero_rate",
        *[F.when(keep, F.col(s)).alias(s) for s in STATS],
    )


def manifest(profiles: DataFrame) -> dict[str, str]:
    """{column: feature_type} in column order: one small row per column."""
    return {r["name"]: r["feature_type"] for r in profiles.select("ordinal", "name", "feature_type").orderBy("ordinal").collect()}


def of_type(types: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t in wanted]

"""The tables behind charts: histograms, shares, tops and counts, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import cut, number, ratio
from tidemark.operators.cumulative import running_sums
from tidemark.operators.drift import two_sample_counts
from tidemark.operators.profile import quantiles


def _splits(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    side = lambda df, s: df.select(F.lit(s).alias("split"), number(F.col(col)).alias("x"))
    return side(train, "train").unionByName(side(test, "test")).where("x IS NOT NULL")


def hist_equal_width(train: DataFrame, test: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(split, bin, n, share): equal widths over the joint range, half a unit each way if it is a point; the last bin is closed."""
    rows = _splits(train, test, col)
    lo, hi = F.min("x"), F.max("x")
    edges = rows.agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))
    at = F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int")
    counts = rows.join(F.broadcast(edges)).groupBy("split", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def hist_quantile_edges(train: DataFrame, test: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(split, bin, n): right-closed bins between train's quantiles, the lowest edge included; values outside fall in no bin."""
    edges = quantiles(train, [col], [k / bins for k in range(bins + 1)]).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    rows = _splits(train, test, col).join(F.broadcast(edges))
    first, last = F.col("edges")[0], F.element_at("edges", -1)
    at = F.when((F.col("x") >= first) & (F.col("x") <= last), F.greatest(cut(F.col("x"), F.col("edges")) - 1, F.lit(0)))
    return rows.select("split", at.cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("split", "bin").agg(F.count(F.lit(1)).alias("n"))


def hist_occupancy(train: DataFrame, test: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(split, bin, n, share): how full each of train's equal-frequency bins is in either split, of all its rows with a value; empty bins too."""
    counts = hist_quantile_edges(train, test, col, bins)
    rows = _splits(train, test, col).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    grid = train.sparkSession.createDataFrame([(s, k) for s in ("train", "test") for k in range(bins)], "split string, bin int")
    told = F.broadcast(grid).join(counts, ["split", "bin"], "left").join(F.broadcast(rows), "split", "left")
    return told.select("split", "bin", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("n", F.lit(0)), F.col("rows")).alias("share"))


def category_shares(df: DataFrame, col: str) -> DataFrame:
    """(category, n, share): labels in lower case without outer spaces, null as ``(null)``."""
    label = F.coalesce(F.trim(F.lower(F.col(col).cast("string"))), F.lit("(null)"))
    counts = df.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("rows"))  # one row
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("rows")).alias("share"))


def top_categories(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    return category_shares(df, col).orderBy(F.desc("n"), "category").limit(k)


def category_rates(df: DataFrame, col: str, y: str) -> DataFrame:
    """(category, n, rate) of a 0/1 column."""
    label = F.coalesce(F.trim(F.lower(F.col(col).cast("string"))), F.lit("(null)"))
    return df.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def robust_view(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """(split, median, iqr)."""
    side = lambda df, s: quantiles(df, [col], [0.25, 0.5, 0.75]).select(F.lit(s).alias("split"), F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    return side(train, "train").unionByName(side(test, "test"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """(x, n, ecdf): one row per value."""
    counts = df.select(F.lit(col).alias("feature"), number(F.col(col)).alias("x")).where("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running_sums(counts, ["n"]).join(F.broadcast(total)).select("x", "n", (F.col("cum_n") / F.col("total")).alias("ecdf"))


def ecdf_gap(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """One row (x, gap): where the two distribution functions are furthest apart, and by how much; the least such x."""
    counts = two_sample_counts(train, test, [col])
    totals = counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide(F.col("cum_a").cast("double"), F.col("na")) - F.try_divide(F.col("cum_b").cast("double"), F.col("nb")))
    told = running_sums(counts, ["a", "b"]).join(F.broadcast(totals), "feature").select("x", F.round(gap, 12).alias("gap"))
    return told.agg(F.max_by("x", F.struct(F.col("gap"), -F.col("x"))).alias("x"), F.max("gap").alias("gap"))


def severity_counts(verdicts: DataFrame) -> DataFrame:
    """(severity, n): drifted columns by severity and the rest as STABLE."""
    label = F.when(F.col("drift_detected"), F.upper("drift_severity")).otherwise("STABLE")
    return verdicts.groupBy(label.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def phase_counts(verdicts: DataFrame) -> DataFrame:
    """One row: columns tested, flagged, confirmed, temporal, and upgraded by a sub-population."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("tested"), F.count_if("prescreen_flagged").alias("flagged"), F.count_if("drift_detected").alias("confirmed"),
        F.count_if(F.col("phase_c_drift_is_temporal")).alias("temporal"), F.count_if(F.col("phase_c_drift_detected")).alias("upgraded"),
    )


def by_severity(verdicts: DataFrame) -> DataFrame:
    """Worst first, then by statistic."""
    order = F.when(F.col("drift_severity") == "SEVERE", 0).when(F.col("drift_severity") == "MODERATE", 1).when(F.col("drift_severity") == "MILD", 2).otherwise(3)
    return verdicts.orderBy(order, F.desc_nulls_last("test_statistic"), "column")


def importance_severity(importance: DataFrame, verdicts: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features with their drift severity, STABLE where none."""
    named = verdicts.where("drift_detected").select(F.col("column").alias("feature"), "drift_severity")
    return importance.orderBy("rank").limit(k).join(named, "feature", "left").fillna("STABLE", ["drift_severity"])


def drifted_among_top(importance: DataFrame, verdicts: DataFrame, k: int = 7) -> DataFrame:
    """One row (n): severely or moderately drifted features among the k most important."""
    told = importance_severity(importance, verdicts, k)
    return told.agg(F.count_if(F.upper("drift_severity").isin("HIGH", "SEVERE", "MODERATE")).alias("n"))


def matching(verdicts: DataFrame, query: str, column: str = "column") -> DataFrame:
    """Rows whose feature name contains the query, whatever the case."""
    return verdicts.where(F.lower(column).contains(query.lower()))


def find_feature(verdicts: DataFrame, name: str, column: str = "column") -> DataFrame:
    """The exact feature, else the first whose name contains the query or is contained in it."""
    low, q = F.lower(column), F.lit(name.lower())
    rank = F.when(low == q, 0).when(F.contains(low, q) | F.contains(q, low), 1)
    return verdicts.withColumn("tm_rank__", rank).where("tm_rank__ IS NOT NULL").orderBy("tm_rank__", column).limit(1).drop("tm_rank__")


def page(df: DataFrame, number_: int, order: str, size: int = 5) -> DataFrame:
    """One page (from 0) of a small table."""
    return df.orderBy(order).offset(number_ * size).limit(size)


def with_synonyms(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to the first name they are a synonym of, if that is free."""
    out = df
    for name, others in synonyms.items():
        hit = next((c for c in others if c in out.columns), None)
        if name not in out.columns and hit:
            out = out.withColumnRenamed(hit, name)
    return out


def feature_count(types: dict[str, str]) -> int:
    """Columns but ids, time and target; constant ones count."""
    return sum(t not in ("metadata", "time", "target") for t in types.values())

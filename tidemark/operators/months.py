"""Month labels: order, recency, per-month means and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import number
from tidemark.functions.text import month_key


def month_counts(df: DataFrame, month: str) -> DataFrame:
    """(month, n): rows per month label; null labels left out."""
    return df.where(F.col(month).isNotNull()).groupBy(F.col(month).cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def month_rank(df: DataFrame, month: str) -> DataFrame:
    """(month, n, rank): 0-based, by year and month of the label; by text if no label has a month at all. One row per month."""
    counts = month_counts(df, month)
    any_month = F.max(F.col("k")["m"].isNotNull().cast("int")).over(Window.partitionBy()) == 1
    keyed = counts.withColumn("k", month_key(F.col("month"))).withColumn("any", any_month)
    by_time = [F.when(F.col("any"), F.col("k")["y"]).asc_nulls_first(), F.when(F.col("any"), F.col("k")["m"]).asc_nulls_first(), F.col("month")]
    return keyed.select("month", "n", (F.row_number().over(Window.orderBy(*by_time)) - 1).alias("rank"))


def recent_months(df: DataFrame, month: str, config: Config = DEFAULT) -> DataFrame:
    """(month): the last few labels, in text order (parity) or by time."""
    if config.month_order == "chronological":
        return month_rank(df, month).orderBy(F.desc("rank")).limit(config.recent_months).select("month")
    return month_counts(df, month).select("month").orderBy(F.desc("month")).limit(config.recent_months)


def recency_weights(df: DataFrame, month: str, config: Config = DEFAULT) -> DataFrame:
    """(month, n, rank, weight, fraction): exponential weight of each month and its share of all weighted rows."""
    weight = F.exp(F.lit(config.decay) * F.col("rank"))
    mass = F.col("weight") * F.col("n")
    return month_rank(df, month).withColumn("weight", weight).withColumn("fraction", mass / F.sum(mass).over(Window.partitionBy()))


def row_weights(df: DataFrame, month: str, config: Config = DEFAULT) -> DataFrame:
    """Each row with its month's weight (months are few: a broadcast join)."""
    weights = recency_weights(df, month, config).select(F.col("month").alias("m_"), F.col("weight").alias("recency_weight"))
    return df.join(F.broadcast(weights), F.col(month).cast("string") == F.col("m_"), "left").drop("m_")


def recency_factor(df: DataFrame, month: str, config: Config = DEFAULT) -> DataFrame:
    """One row (recency_factor): the sum of squared fractions; 1 when one month holds all rows."""
    return recency_weights(df, month, config).agg(F.coalesce(F.sum(F.col("fraction") ** 2), F.lit(0.0)).alias("recency_factor"))


def month_sums(df: DataFrame, cols: Sequence[str], month: str) -> DataFrame:
    """(feature, month, total, n): sums and numbers of values, all columns in one grouping; rows without a month are a month of their own."""
    x = [number(F.col(c)) for c in cols]
    wide = df.groupBy(F.col(month).cast("string").alias("month")).agg(*[F.sum(v).alias(f"s{k}") for k, v in enumerate(x)], *[F.count(v).alias(f"n{k}") for k, v in enumerate(x)])
    triples = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{k}").alias("total"), F.col(f"n{k}").alias("n")) for k, c in enumerate(cols)])
    return wide.select("month", F.explode(triples).alias("p")).select("p.feature", "month", "p.total", "p.n")


def monthly_means(df: DataFrame, cols: Sequence[str], month: str, empty: float | None = 0.0) -> DataFrame:
    """(feature, month, mean): a month without values has the mean ``empty``."""
    return means_of(month_sums(df, cols, month), empty)


def means_of(sums: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """``monthly_means`` of ``month_sums``."""
    return sums.select("feature", "month", F.coalesce(F.try_divide(F.col("total"), F.col("n")), F.lit(empty)).alias("mean"))


def mean_of_means(means: DataFrame) -> DataFrame:
    """(feature, mean): every month with values weighs the same; give means whose empty months are null."""
    return means.groupBy("feature").agg(F.avg("mean").alias("mean"))


def temporal_means(train: DataFrame, test: DataFrame, cols: Sequence[str], month: str, recent: Sequence[str]) -> DataFrame:
    """(feature, near, full, then): train's mean over its recent months and over all rows, and the mean of test's monthly means.

    near falls back on full, the others on 0.
    """
    return temporal_of(month_sums(train, cols, month), month_sums(test, cols, month), recent)


def temporal_of(train: DataFrame, test: DataFrame, recent: Sequence[str]) -> DataFrame:
    """``temporal_means`` of both splits' ``month_sums``."""
    late = lambda x: F.sum(F.when(F.col("month").isin(*recent), F.col(x)))
    mean = lambda total, n: F.try_divide(total, n.cast("double"))
    a = train.groupBy("feature").agg(mean(late("total"), late("n")).alias("near"), mean(F.sum("total"), F.sum("n")).alias("full"))
    b = mean_of_means(means_of(test, None)).select("feature", F.col("mean").alias("then"))
    told = a.join(F.broadcast(b), "feature", "left")
    return told.select("feature", F.coalesce("near", "full", F.lit(0.0)).alias("near"), F.coalesce("full", F.lit(0.0)).alias("full"), F.coalesce("then", F.lit(0.0)).alias("then"))


def segment_ranges(means: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, low, high) of the train months, two at least: their range widened by the tolerance."""
    told = means.groupBy("feature").agg(
        F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.avg("mean").alias("mu"), F.stddev_pop("mean").alias("sd"), F.count(F.lit(1)).alias("k")
    )
    wide = F.when(F.col("mu") == 0, F.greatest("sd", F.lit(1e-6))).otherwise(F.greatest(F.col("sd"), F.abs(F.col("mu")) * config.segment_tolerance))
    return told.where("k >= 2").select("feature", (F.col("lo") - wide).alias("low"), (F.col("hi") + wide).alias("high"))


def drifted_months(train_means: DataFrame, test_means: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, stable, months): test months outside the train months' range, in order; features with a range only."""
    ranges = F.broadcast(segment_ranges(train_means, config))
    out = (F.col("mean") < F.col("low")) | (F.col("mean") > F.col("high"))
    months = F.array_join(F.array_sort(F.collect_list(F.when(out, F.coalesce("month", F.lit("None"))))), ",")
    return test_means.join(ranges, "feature").groupBy("feature").agg((F.count_if(out) == 0).alias("stable"), months.alias("months"))


def ratio_to_total(c: str) -> Column:
    return F.col(c) / F.sum(c).over(Window.partitionBy())

"""Drift statistics over long frequency and value tables: every function handles all features of a kind in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import number, present, ratio, severity
from tidemark.operators.cumulative import bucketed, within_buckets
from tidemark.operators.frequency import aligned, floored, long_form, rescaled, top, top_other_of
from tidemark.operators.profile import both_stats


def category_tests(pair: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row per feature of a paired table (``frequency.paired``), all from one aggregate.

    psi: floored shares, not rescaled. chi2, cells: goodness of fit of the test counts to the train shares over cells with an expectation
    of 5 or more, rescaled to the same sum; null with fewer than two cells, NaN where those cells have no test rows. category, shift: the
    category whose share moved most. top_p, top_q: each side's largest share.
    """
    p, q = floored("p", config.psi_floor), floored("q", config.psi_floor)
    o, e = F.col("q") * F.col("rows_test"), F.greatest("p", F.lit(1e-9)) * F.col("rows_test")
    kept = lambda x: F.sum(F.when(e >= config.chi2_min_expected, x))
    shift = F.abs(F.col("p") - F.col("q"))
    told = pair.groupBy("feature").agg(
        F.sum((q - p) * F.ln(q / p)).alias("psi"), kept(o).alias("so"), kept(e).alias("se"), kept(o * o / e).alias("soe"),
        F.count_if(e >= config.chi2_min_expected).alias("cells"), F.max_by("category", F.struct(shift, "category")).alias("category"), F.max(shift).alias("shift"),
        F.max("p").alias("top_p"), F.max("q").alias("top_q"),
    )
    # with every expectation times so / se: sum of (o - e)^2 / e = se / so * sum of o^2 / e - so
    chi2_ = F.coalesce(F.try_divide(F.col("se"), F.col("so")) * F.col("soe") - F.col("so"), F.lit(float("nan")))
    return told.select("feature", "psi", F.when(F.col("cells") >= 2, chi2_).alias("chi2"), "cells", "category", "shift", "top_p", "top_q")


def _pair(train: DataFrame, test: DataFrame) -> DataFrame:
    rows = test.groupBy("feature").agg(F.sum("n").alias("rows_test"))  # a row per feature
    return aligned(train, test).join(F.broadcast(rows), "feature", "left").fillna(0, ["rows_test"])


def psi(train: DataFrame, test: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, psi) of two frequency tables."""
    return category_tests(_pair(train, test), config).select("feature", "psi")


def chi2(train: DataFrame, test: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, chi2, cells) of two frequency tables."""
    return category_tests(_pair(train, test), config).select("feature", "chi2", "cells")


def l1(train: DataFrame, test: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return l1_of(aligned(train, test), config)


def l1_of(pair: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, l1): distance of the full tables' shares over the most frequent categories of either side."""
    kept = top(pair, config.l1_top, "n_train").select("feature", "category").union(top(pair, config.l1_top, "n_test").select("feature", "category")).distinct()
    shares = pair.join(F.broadcast(kept), ["feature", "category"], "left_semi")  # at most twice ``l1_top`` rows a feature
    return shares.groupBy("feature").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"))


def js(train: DataFrame, test: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, js): Jensen-Shannon divergence in bits over the train side's top k and the rest."""
    return js_of(top_other_of(aligned(train, test), config.top_k), config)


def js_of(binned: DataFrame, config: Config = DEFAULT) -> DataFrame:
    lifted = rescaled(binned.select("feature", "category", floored("p", config.js_floor).alias("p"), floored("q", config.js_floor).alias("q")))
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.col(x) * F.ln(F.col(x) / m) / 2
    return lifted.groupBy("feature").agg((F.sum(half("p") + half("q")) / F.log(F.lit(2.0))).alias("js"))


def max_share_shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """(feature, category, shift): the category whose share moved most."""
    return category_tests(_pair(train, test)).select("feature", "category", "shift")


def two_sample_counts(train: DataFrame, test: DataFrame, cols: Sequence[str], nonzero: bool | Sequence[str] = False) -> DataFrame:
    """(feature, x, a, b): how often each value occurs in either split; of all columns, or those that ``nonzero`` names, values that are not zero only."""
    sides = [long_form(df, cols, "x", "double").select("feature", number(F.col("x")).alias("x"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")) for df, a in ((train, 1), (test, 0))]
    rows = sides[0].union(sides[1]).where("x IS NOT NULL")
    if nonzero:
        rows = rows.where(F.col("x") != 0 if nonzero is True else ~F.col("feature").isin(*nonzero) | (F.col("x") != 0))
    return rows.groupBy("feature", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks(train: DataFrame, test: DataFrame, cols: Sequence[str], nonzero: bool = False) -> DataFrame:
    """(feature, ks, n_train, n_test): the exact two-sample Kolmogorov-Smirnov distance, no sampling."""
    return ks_of(two_sample_counts(train, test, cols, nonzero))


def ks_of(counts: DataFrame) -> DataFrame:
    """(feature, ks, n_train, n_test) of ``two_sample_counts``, which is read several times.

    Both distribution functions only rise, so what they are at the ends of a bucket of values bounds the gap within it. Only
    buckets whose bound is above the largest gap at an end can hold a larger one: of these alone every value is looked at.
    """
    placed, carried = bucketed(counts, ["a", "b"])
    every = Window.partitionBy("feature")
    share = lambda x, n: F.try_divide(x.cast("double"), F.col(n))
    carried = carried.withColumns({"n_train": F.sum("t_a").over(every), "n_test": F.sum("t_b").over(every)})
    low_a, low_b = share(F.col("before_a"), "n_train"), share(F.col("before_b"), "n_test")
    high_a, high_b = share(F.col("before_a") + F.col("t_a"), "n_train"), share(F.col("before_b") + F.col("t_b"), "n_test")
    ends = carried.withColumn("most", F.max(F.abs(high_a - high_b)).over(every))
    inner = within_buckets(placed, ends.where(F.greatest(high_a - low_b, high_b - low_a) > F.col("most")), ["a", "b"])
    inner = inner.groupBy("feature").agg(F.max(F.abs(share(F.col("cum_a"), "n_train") - share(F.col("cum_b"), "n_test"))).alias("inner"))
    told = ends.groupBy("feature").agg(F.first("most").alias("most"), F.first("n_train").alias("n_train"), F.first("n_test").alias("n_test"))
    return told.join(F.broadcast(inner), "feature", "left").select("feature", F.greatest("most", "inner").alias("ks"), "n_train", "n_test")


def presence(df: DataFrame, cols: Sequence[str], side: str) -> DataFrame:
    """(feature, pos_<side>, n_<side>): rows where the value is present; one aggregate, no shuffle of rows."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(present(df, c)).alias(f"c{k}") for k, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{k}").alias(f"pos_{side}")) for k, c in enumerate(cols)])
    return wide.select(F.explode(pairs).alias("p"), F.col("n").alias(f"n_{side}")).select("p.*", f"n_{side}")


def two_proportion_z(pos_a: Column, n_a: Column, pos_b: Column, n_b: Column) -> Column:
    """Pooled z of a minus b; 0 where a side is empty or the error vanishes."""
    pooled = F.try_divide((pos_a + pos_b).cast("double"), n_a + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    gap = F.try_divide(pos_a.cast("double"), n_a) - F.try_divide(pos_b.cast("double"), n_b)
    return F.coalesce(F.when(error >= 1e-9, gap / error), F.lit(0.0))


def proportion_test(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, rate_train, rate_test, z)."""
    both = presence(train, cols, "train").join(F.broadcast(presence(test, cols, "test")), "feature")
    z = two_proportion_z(F.col("pos_train"), F.col("n_train"), F.col("pos_test"), F.col("n_test"))
    rate = lambda s: ratio(F.col(f"pos_{s}"), F.col(f"n_{s}")).alias(f"rate_{s}")
    return both.select("feature", rate("train"), rate("test"), z.alias("z"))


# ---- pre-screens ----


def numeric_prescreen(train: DataFrame, test: DataFrame, cols: Sequence[str], config: Config = DEFAULT) -> DataFrame:
    """(feature, shift, iqr_gap, score, flagged) from means, deviations and quartiles; a test quartile of exactly 0 counts as missing."""
    j = both_stats(train, test, cols)
    mean = F.coalesce("b_mean", F.lit(0.0))
    lo_a, hi_a = F.coalesce("a_p25", "a_mean"), F.coalesce("a_p75", "a_mean")
    lo_b, hi_b = (F.coalesce(F.nullif(F.col(c), F.lit(0.0)), mean) for c in ("b_p25", "b_p75"))
    shift = F.abs(F.col("a_mean") - mean) / (F.coalesce("a_std", F.lit(1.0)) + 1e-9)
    overlap = F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    gap = F.when(hi_a - lo_a > 1e-9, 1 - overlap / (hi_a - lo_a)).otherwise(0.0)
    told = j.select("feature", F.coalesce(shift, F.lit(0.0)).alias("shift"), F.coalesce(gap, F.lit(0.0)).alias("iqr_gap"))
    return told.select("*", F.greatest("shift", "iqr_gap").alias("score"), ((F.col("shift") > config.shift) | (F.col("iqr_gap") > config.iqr_gap)).alias("flagged"))


def category_prescreen(pair: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(feature, score, flagged) from a paired table."""
    return l1_of(pair, config).select("feature", F.col("l1").alias("score"), (F.col("l1") > config.l1).alias("flagged"))


def sparse_prescreen(train: DataFrame, test: DataFrame, cols: Sequence[str], config: Config = DEFAULT) -> DataFrame:
    """(feature, score, flagged) from presence rates."""
    gap = F.abs(F.col("rate_train") - F.col("rate_test"))
    return proportion_test(train, test, cols).select("feature", gap.alias("score"), (gap > config.sparse_rate).alias("flagged"))


def psi_severity(train: DataFrame, test: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return psi(train, test, config).withColumn("severity", severity(F.col("psi"), config.psi))

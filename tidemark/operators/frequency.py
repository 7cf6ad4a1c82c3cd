"""Category frequencies in long form: any number of columns, one scan, one shuffle of distinct texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import OTHER_LEVEL
from tidemark.functions.text import level


def long_form(df: DataFrame, cols: Sequence[str], value: str = "category", as_type: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value, *keep): one row per row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(as_type).alias(value)) for c in cols])
    return df.select(F.explode(pairs).alias("p"), *keep).select("p.*", *keep)


def levels(counts: DataFrame, *sums: str) -> DataFrame:
    """(feature, category, *sums) of texts as they are, added up by normalised category: a text is normalised once, not once a row."""
    return counts.groupBy("feature", level(F.col("category")).alias("category")).agg(*[F.sum(c).alias(c) for c in sums])


def category_freq(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category, n, freq): normalised categories, null a level, shares of all rows."""
    counts = levels(long_form(df, cols).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n")), "n")
    total = df.agg(F.count(F.lit(1)).alias("rows"))  # one row
    return counts.join(F.broadcast(total)).select("feature", "category", "n", (F.col("n") / F.col("rows")).alias("freq"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """One column's normalised value counts, most frequent first."""
    return category_freq(df, [col]).drop("feature").orderBy(F.desc("n"), "category")


def top(freq: DataFrame, k: int, n: str = "n") -> DataFrame:
    """The k most frequent categories of each feature by the count ``n``; Spark keeps k per task before it shuffles."""
    order = Window.partitionBy("feature").orderBy(F.desc(n), "category")
    return freq.where(F.col(n) > 0).withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k).drop("rank_")


def paired(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category, n_train, n_test, rows_test, p, q): counts and shares of both splits side by side, all columns in one shuffle of distinct texts and one of categories."""
    side = lambda df, a: long_form(df, cols).select("*", F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
    counts = levels(side(train, 1).union(side(test, 0)).groupBy("feature", "category").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test")), "n_train", "n_test")
    rows = train.agg(F.count(F.lit(1)).alias("rows_train")).join(F.broadcast(test.agg(F.count(F.lit(1)).alias("rows_test"))))  # one row
    share = lambda n: F.coalesce(F.try_divide(F.col(f"n_{n}").cast("double"), F.col(f"rows_{n}")), F.lit(0.0))
    return counts.join(F.broadcast(rows)).select("feature", "category", "n_train", "n_test", "rows_test", share("train").alias("p"), share("test").alias("q"))


def aligned(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union of the categories of two frequency tables: (feature, category, n_train, n_test, p, q), a missing side 0."""
    a = train.select("feature", "category", F.col("n").alias("n_train"), F.col("freq").alias("p"))
    b = test.select("feature", "category", F.col("n").alias("n_test"), F.col("freq").alias("q"))
    both = a.join(b, ["feature", "category"], "full_outer").fillna(0.0, ["p", "q"]).fillna(0, ["n_train", "n_test"])
    return both.select("feature", "category", "n_train", "n_test", "p", "q")


def top_other(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    return top_other_of(aligned(train, test), k)


def top_other_of(pair: DataFrame, k: int) -> DataFrame:
    """(feature, category, p, q) over the train side's top k, all else in one level if it has any mass; each side adds up to one."""
    kept = top(pair, k, "n_train").select("feature", "category", F.lit(True).alias("kept_"))
    name = F.when(F.col("kept_"), F.col("category")).otherwise(F.lit(OTHER_LEVEL))
    both = pair.select("feature", "category", "p", "q").join(F.broadcast(kept), ["feature", "category"], "left")  # k rows a feature
    binned = both.groupBy("feature", name.alias("category")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return rescaled(binned.where((F.col("p") > 0) | (F.col("q") > 0)))


def rescaled(binned: DataFrame) -> DataFrame:
    """Both sides of each feature add up to one. The sums come from a table with a row per feature."""
    total = binned.groupBy("feature").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    share = lambda x, t: F.coalesce(F.try_divide(F.col(x), F.col(t)), F.lit(0.0)).alias(x)
    return binned.join(F.broadcast(total), "feature").select("feature", "category", share("p", "tp"), share("q", "tq"))


def floored(x: str, floor: float) -> Column:
    return F.greatest(F.col(x), F.lit(floor))

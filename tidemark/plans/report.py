"""The console report of a run, table by table: what drifted and how, the policy, scores, the decision at one threshold, the time taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import treatment_name
from tidemark.operators.views import by_severity
from tidemark.sources.writers import drift_results


def description(kind: str = "feature_type", severity: str = "drift_severity") -> Column:
    """One sentence on a drifted column, by type and severity."""
    s, k = F.upper(severity), F.lower(kind)
    number = F.when(s == "SEVERE", "values of the test set leave the range of train").when(s == "MODERATE", "the distribution moved clearly in the test set").otherwise("the distribution moved a little in the test set")
    words = F.when(s == "SEVERE", "the test set has categories of its own").otherwise("the categories' shares moved in the test set")
    return F.when(k == "numerical", number).when(k.isin("categorical", "high_cardinality"), words).otherwise(F.concat(F.lower(s), F.lit(" drift")))


def drift_summary(verdicts: DataFrame) -> DataFrame:
    """Drifted columns, worst first: type, description, treatment, and the months that left their range."""
    months = F.when(F.col("phase_c_segment_stable"), "stable in all months").when(F.col("phase_c_drifted_months") != "", F.col("phase_c_drifted_months")).otherwise("—")
    rows = by_severity(drift_results(verdicts).withColumnRenamed("feature", "column"))
    return rows.select("column", "feature_type", "drift_severity", description().alias("description"), treatment_name(F.col("mitigation")).alias("treatment"), months.alias("segment"))


def policy_summary(spark: SparkSession, policy: str, features: Sequence[str]) -> DataFrame:
    """The policy of mildly and moderately drifted numbers, and the columns it holds for."""
    return spark.createDataFrame([(policy, f) for f in features] or [(policy, "—")], "policy string, feature string")


def score_table(spark: SparkSession, train: float, test: float | None) -> DataFrame:
    return spark.createDataFrame([("train", train), ("test", test)], "split string, average_precision double")


def runtime(spark: SparkSession, seconds: float) -> DataFrame:
    return spark.createDataFrame([(round(seconds, 1),)], "seconds double")

"""Ranking of drifted features by severity and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.operators.months import recency_factor

RANKED = "feature string, col_type string, test_used string, raw_score double, weighted_score double, drift_rank int, drift_severity string"


def severity_weight(c: str, config: Config = DEFAULT):  # noqa: ANN201
    out = F.lit(0.0)
    for name, w in config.severity_weights:
        out = F.when(F.upper(c) == name, F.lit(w)).otherwise(out)
    return out


def rank_drift(drifted: DataFrame, serve: DataFrame, month: str = "Month", config: Config = DEFAULT) -> DataFrame:
    """Columns of ``RANKED``: raw score times severity weight times the recency factor of ``serve``, largest first; ties by name.

    ``drifted``: (feature, col_type, test_used, raw_score, drift_severity), a row per column. The factor is one scalar for all
    features. A signed score may rank a strong negative shift last, unless ``abs_score`` is set.
    """
    raw = F.abs("raw_score") if config.abs_score else F.col("raw_score")
    weighted = drifted.join(F.broadcast(recency_factor(serve, month, config))).withColumn(
        "w_", F.coalesce(raw, F.lit(0.0)) * severity_weight("drift_severity", config) * F.col("recency_factor")
    )
    place = F.row_number().over(Window.orderBy(F.desc("w_"), "feature"))
    return weighted.select("feature", "col_type", "test_used", "raw_score", F.round("w_", 6).alias("weighted_score"), place.cast("int").alias("drift_rank"), "drift_severity")

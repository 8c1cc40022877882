"""Min-max scaling and the weighted value score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.schema import FEATURES, require_columns


def feature_ranges(df: DataFrame) -> DataFrame:
    """One row with the minimum and maximum of every feature."""
    return df.agg(
        *[
            bound(F.col(name).cast("double")).alias(f"{side}_{name}")
            for name in FEATURES
            for side, bound in (("min", F.min), ("max", F.max))
        ]
    )


def scale_features(df: DataFrame) -> DataFrame:
    """Add the four features scaled to 0..1; a low price scales high.

    A constant feature scales to 0 (so a constant price to 1).
    """
    require_columns(df, FEATURES)
    ranges = feature_ranges(df)
    bounds = ranges.select(F.struct(*ranges.columns)).scalar()
    scaled = {}
    for name in FEATURES:
        low, high = bounds[f"min_{name}"], bounds[f"max_{name}"]
        share = F.coalesce(F.try_divide(F.col(name) - low, high - low), F.lit(0.0))
        scaled[f"{name}_scaled"] = F.lit(1.0) - share if name == "price" else share
    return df.withColumns(scaled)


def check_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """The weights to use; ValueError unless they name the features and sum to 1."""
    weights = weights or V.SCORE_WEIGHTS
    total = sum(weights.values())
    if abs(total - 1.0) > V.WEIGHT_TOLERANCE:
        raise ValueError(f"weights must sum to 1.0, got {total}")
    if set(weights) != set(FEATURES):
        raise ValueError(f"weights must have exactly the keys {FEATURES}")
    return weights


def value_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``value_score`` in 0..100, scaling the features first if needed."""
    weights = check_weights(weights)
    if "price_scaled" not in df.columns:
        df = scale_features(df)
    total = F.lit(0.0)
    for name in FEATURES:
        total = total + F.lit(float(weights[name])) * F.col(f"{name}_scaled")
    return df.withColumn("value_score", total * 100)


def top_by_score(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        df.orderBy(F.desc("value_score"), F.asc("product_id"))
        .limit(n)
        .select("product_id", "product_name", *FEATURES, "value_score")
    )


def score_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("value_score").alias("min_score"),
        F.max("value_score").alias("max_score"),
        F.avg("value_score").alias("mean_score"),
    )

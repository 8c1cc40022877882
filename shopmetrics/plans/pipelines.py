"""The two batch flows: raw rows to the product table, and on to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopmetrics.operators import clean, score, segments
from shopmetrics.operators.normalize import union_sources
from shopmetrics.sources.staging import stage


def build_products(*sources: DataFrame) -> DataFrame:
    """Clean, flagged product table of one raw source or several normalised ones.

    The cleaned rows are written once, so finding the price fences and applying
    them read the narrow cleaned table instead of the raw rows again.
    """
    merged = union_sources(*sources) if len(sources) > 1 else sources[0]
    return clean.flag_price_outliers(stage(clean.clean_unflagged(merged), "unflagged"))


def build_scored(
    products: DataFrame, weights: dict[str, float] | None = None, k: int | None = None
) -> DataFrame:
    """Score, segment and name the products of a written table."""
    scored = score.value_score(score.scale_features(products), weights)
    scored = stage(scored, "scored")
    return segments.with_segment_names(segments.segment_products(scored, k))

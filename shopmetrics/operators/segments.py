"""KMeans segments, their quality and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.operators import kmeans
from shopmetrics.operators.kmeans import Model
from shopmetrics.operators.score import scale_features
from shopmetrics.schema import FEATURES, SCALED_FEATURES, require_columns

K_MIN, K_MAX = 2, 8
RESTARTS = 10
SEED = 42
CENTRE_COLUMNS = ["segment", *SCALED_FEATURES]


# --- quality of a labelling ---------------------------------------------------


def silhouette(df: DataFrame, label: str = "segment") -> DataFrame:
    """One row: mean silhouette of a labelling under squared Euclidean distance.

    The quick form; ``silhouettes.euclidean_silhouette`` has the plain distance.
    The mean squared distance of a point to a segment follows from the
    segment's count, coordinate sums and sum of squared norms, so the cost is
    linear in the rows. Products alone in their segment score 0; a single
    segment has no silhouette.
    """
    points = df.select(label, *SCALED_FEATURES)
    sums = points.groupBy(F.col(label).alias("seg")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(name) for name in SCALED_FEATURES]).alias("s"),
        F.sum(_squared_norm([F.col(name) for name in SCALED_FEATURES])).alias("q"),
    )
    # One entry per segment.
    table = sums.agg(F.collect_list(F.struct("seg", "n", "s", "q"))).scalar()
    x = F.array(*[F.col(name) for name in SCALED_FEATURES])
    norm = _squared_norm([F.col(name) for name in SCALED_FEATURES])

    def mean_distance(entry: Column, count: Column) -> Column:
        dot = F.aggregate(
            F.zip_with(x, entry["s"], lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v
        )
        return (entry["n"] * norm - 2 * dot + entry["q"]) / count

    own = F.get(F.filter(F.col("_table"), lambda e: e["seg"] == F.col(label)), F.lit(0))
    others = F.filter(F.col("_table"), lambda e: e["seg"] != F.col(label))
    nearest_other = F.array_min(
        F.transform(others, lambda e: mean_distance(e, e["n"]))
    )
    inside = mean_distance(F.col("_own"), F.col("_own.n") - 1)
    score = F.when(F.col("_own.n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(
            F.try_divide(
                F.col("_other") - F.col("_inside"),
                F.greatest("_other", "_inside"),
            ),
            F.lit(0.0),
        )
    )
    return (
        points.withColumn("_table", table)
        .withColumn("_own", own)
        .withColumn("_other", nearest_other)
        .withColumn("_inside", F.when(F.col("_own.n") > 1, inside))
        .agg(
            F.count_distinct(label).alias("n_segments"),
            F.avg(F.when(F.col("_other").isNotNull(), score)).alias("silhouette"),
        )
    )


def _squared_norm(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for column in columns:
        total = total + column * column
    return total


def assign_segments(df: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """Label rows with the nearest of the given (id, coordinates) centres."""
    distances = F.array(
        *[
            F.struct(
                _squared_norm(
                    [F.col(n) - F.lit(float(c)) for n, c in zip(SCALED_FEATURES, at)]
                ).alias("distance"),
                F.lit(int(identifier)).alias("id"),
            )
            for identifier, at in centres
        ]
    )
    return df.withColumn("segment", F.array_min(distances)["id"])


# --- fitting ------------------------------------------------------------------


def _centres(model: Model) -> list[tuple[int, list[float]]]:
    return [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]


def _k_rows(
    df: DataFrame, k_min: int, k_max: int, seed: int, restarts: int
) -> tuple[list[tuple], dict[int, Model]]:
    n_rows = df.count()
    k_max = min(k_max, n_rows - 1)
    if k_max < k_min:
        raise ValueError(f"{n_rows} products are too few for k from {k_min}")
    points, models = kmeans.best_models(df, list(range(k_min, k_max + 1)), seed, restarts)
    if not models:
        raise ValueError(f"fewer than {k_min} different products: no k is possible")
    ordered = [models[k] for k in sorted(models)]
    scores = kmeans.silhouettes(points, ordered)
    rows = [(m.k, m.cost, s.silhouette, s.low, s.high) for m, s in zip(ordered, scores)]
    return rows, models


def _best_k(rows: list[tuple]) -> int:
    return max((r for r in rows if r[2] is not None), key=lambda r: (r[2], -r[0]))[0]


def k_table(
    df: DataFrame,
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    seed: int = SEED,
    restarts: int = RESTARTS,
) -> DataFrame:
    """Inertia and silhouette for every feasible k; ``best`` marks the choice.

    A k is feasible below the number of products and up to that of different
    feature rows. The silhouette is the Euclidean one, between the proven limits
    ``low`` and ``high`` (equal on small tables). Of ``restarts`` fits of each k the one of least inertia counts.
    """
    rows, _ = _k_rows(df, k_min, k_max, seed, restarts)
    best = _best_k(rows)
    return df.sparkSession.createDataFrame(
        [(*row, row[0] == best) for row in rows],
        "k int, inertia double, silhouette double, low double, high double, best boolean",
    )


def k_table_from_starts(
    df: DataFrame, starts: list[list[list[float]]], passes: int
) -> DataFrame:
    """Like ``k_table``, of given centres (one list for each model) moved so many times."""
    points, models = kmeans.from_starts(df, starts, passes)
    scores = kmeans.silhouettes(points, models)
    return df.sparkSession.createDataFrame(
        [(m.k, m.cost, s.silhouette) for m, s in zip(models, scores)],
        "k int, inertia double, silhouette double",
    )


def segment_products(
    df: DataFrame,
    k: int | None = None,
    seed: int = SEED,
    restarts: int = RESTARTS,
) -> DataFrame:
    """Add ``segment``: KMeans with the given k, or that of best silhouette.

    Ids are renumbered by mean price, then mean score, so they do not depend on
    the order in which a fit found its centres.
    """
    require_columns(df, ["value_score"], "Score the products first.")
    if SCALED_FEATURES[0] not in df.columns:
        df = scale_features(df)
    if k is None:
        rows, models = _k_rows(df, K_MIN, K_MAX, seed, restarts)
        model = models[_best_k(rows)]
    else:
        _, models = kmeans.best_models(df, [k], seed, restarts)
        if k not in models:
            raise ValueError(f"fewer than {k} different products: k={k} is not possible")
        model = models[k]
    labelled = assign_segments(df, _centres(model))
    means = (
        labelled.groupBy("segment")
        .agg(F.avg("price").alias("p"), F.avg("value_score").alias("s"))
        .orderBy("p", "s", "segment")
        .collect()  # one row per segment
    )
    numbers = {row["segment"]: i for i, row in enumerate(means)}
    renumber = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    return labelled.withColumn("segment", F.element_at(renumber, F.col("segment")))


# --- names --------------------------------------------------------------------
#
# The windows below run over one row per segment.


def segment_means(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_products"),
        *[F.avg(name).alias(f"mean_{name}") for name in FEATURES],
        F.avg("value_score").alias("mean_value_score"),
    )


def segment_price_tier(df: DataFrame) -> DataFrame:
    """Segments with their price tier: cheap, middle or expensive thirds."""
    by_price = Window.orderBy("mean_price", "segment")
    third = F.ntile(3).over(by_price)
    half = F.ntile(2).over(by_price)
    k = F.count(F.lit(1)).over(
        by_price.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    cheap, middle, expensive = (
        F.lit(V.TIER_CHEAP),
        F.lit(V.TIER_MIDDLE),
        F.lit(V.TIER_EXPENSIVE),
    )
    return (
        segment_means(df)
        .withColumns({"_k": k, "_third": third, "_half": half})
        .withColumn(
            "tier",
            F.when(F.col("_k") == 1, middle)
            .when(
                F.col("_k") == 2, F.when(F.col("_half") == 1, cheap).otherwise(expensive)
            )
            .when(F.col("_third") == 1, cheap)
            .when(F.col("_third") == 2, middle)
            .otherwise(expensive),
        )
        .drop("_k", "_third", "_half")
    )


def _by_side(values: dict[tuple[str, bool], str]) -> Column:
    return F.coalesce(
        *[
            F.when(
                (F.col("tier") == tier) & (F.col("good_side") == F.lit(good)),
                F.lit(text),
            )
            for (tier, good), text in values.items()
        ]
    )


def segment_names(df: DataFrame) -> DataFrame:
    """Name and description per segment, before repeated names are told apart."""
    tiers = segment_price_tier(df)
    middle = F.median("mean_rating").over(Window.partitionBy("tier"))
    return tiers.withColumn("good_side", F.col("mean_rating") >= middle).withColumns(
        {
            "segment_name": F.concat(
                "tier", F.lit(V.NAME_SEPARATOR), _by_side(V.SEGMENT_SIDES)
            ),
            "description": _by_side(V.SEGMENT_DESCRIPTIONS),
        }
    )


def dedup_segment_names(df: DataFrame) -> DataFrame:
    """Segment names made unique by a rank of mean score."""
    same = Window.partitionBy("segment_name")
    place = F.row_number().over(same.orderBy(F.desc("mean_value_score"), "segment"))
    repeated = F.count(F.lit(1)).over(same) > 1
    return (
        segment_names(df)
        .withColumns({"_place": place, "_repeated": repeated})
        .withColumn(
            "segment_name",
            F.when(
                F.col("_repeated"),
                F.concat(
                    "segment_name", F.format_string(V.GROUP_SUFFIX, F.col("_place"))
                ),
            ).otherwise(F.col("segment_name")),
        )
        .drop("_place", "_repeated")
    )


def segment_profile(df: DataFrame) -> DataFrame:
    """One row per segment, best mean score first."""
    return (
        dedup_segment_names(df)
        .select(
            "segment",
            "segment_name",
            "n_products",
            "mean_price",
            "mean_rating",
            "mean_units_sold",
            "mean_discount_ratio",
            "mean_value_score",
            "description",
        )
        .orderBy(F.desc("mean_value_score"), "segment")
    )


def with_segment_names(df: DataFrame) -> DataFrame:
    """Products with the unique name of their segment (one row per segment)."""
    names = dedup_segment_names(df).select("segment", "segment_name")
    return df.join(F.broadcast(names), "segment")


def segment_badge(name: Column) -> Column:
    """What follows the first separator of a segment name, else all of it."""
    parts = F.split(name, V.NAME_SEPARATOR)
    return F.coalesce(F.get(parts, F.lit(1)), name)


def segment_map_points(df: DataFrame) -> DataFrame:
    return df.select(
        "product_id", "price", "value_score", "segment_name", "product_name", "rating",
        "discount_ratio",
    )

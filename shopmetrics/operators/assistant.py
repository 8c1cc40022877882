"""Product evaluation and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.functions.mathx import tenth_text, whole_text
from shopmetrics.operators.prefix_topk import Axis, best_per_key, prefix_top_k, skyband
from shopmetrics.operators.ranking import distinct_counts, with_prefix
from shopmetrics.operators.stats import category_means
from shopmetrics.schema import require_columns

ALTERNATIVES = 3
DETAILS = ["product_id", "product_name", "price", "rating", "units_sold",
           "value_score", "url"]
RECOMMENDATION_COLUMNS = ["product_id", "product_name", "category", "price",
                          "rating", "units_sold", "value_score", "segment_name",
                          "url"]
# Scopes of a budget request: one category, or all of them.
ALL_CATEGORIES = "all"
CATEGORY_SCOPE = "category:"


def _require_scored(df: DataFrame) -> None:
    require_columns(
        df,
        [*DETAILS, "category"],
        "Score and segment the products first.",
    )


# --- price percentile ---------------------------------------------------------


def _percentile_per_price(df: DataFrame) -> DataFrame:
    """Percentile and note for every category and price.

    Prices are ranked as distinct values per category, so a large category is
    not sorted in one task.
    """
    ranks = with_prefix(distinct_counts(df, "price", ["category"]), "price", ["category"])
    share = F.col("before") * F.lit(100.0) / F.col("total")
    enough = F.col("total") >= V.MIN_CATEGORY_FOR_PERCENTILE
    return ranks.select(
        "category",
        "price",
        F.when(enough, F.round(share, 1)).alias("price_percentile"),
        F.when(
            enough,
            F.format_string(
                V.NOTE_PERCENTILE,
                F.round(share, 0).cast("bigint"),
                F.col("total"),
                F.col("category"),
            ),
        )
        .otherwise(
            F.format_string(
                V.NOTE_PERCENTILE_TOO_FEW, F.col("category"), F.col("total")
            )
        )
        .alias("percentile_note"),
    )


def price_percentile(df: DataFrame) -> DataFrame:
    """Share of strictly cheaper products in each product's category."""
    return (
        df.select("product_id", "category", "price")
        .join(_percentile_per_price(df), ["category", "price"])
        .select("product_id", "price_percentile", "percentile_note")
    )


# --- cheaper alternatives -----------------------------------------------------


def _rating_places(df: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Position of every rating counted from the best, and bound of what qualifies.

    A rating r qualifies for a product rated x when r >= x - tolerance; counted
    from the best rating that reads "position below bound". Both follow from the
    ranks of the distinct ratings together with their lowered values, which
    weigh nothing.
    """
    lowered = F.col("rating") - F.lit(float(tolerance))
    marks = (
        df.select(
            F.explode(
                F.array(
                    F.struct(F.col("rating").alias("v"), F.lit(1).alias("w")),
                    F.struct(lowered.alias("v"), F.lit(0).alias("w")),
                )
            ).alias("m")
        )
        .groupBy("m.v")
        .agg(F.max("m.w").alias("n"))
    )
    placed = with_prefix(marks, "v")
    rated = placed.filter(F.col("n") == 1)
    positions = rated.select(
        F.col("v").alias("rating"),
        (F.col("total") - 1 - F.col("before")).alias("rating_position"),
        (F.col("total") - 1).alias("rating_top"),
    )
    floors = placed.select(
        F.col("v").alias("_floor"),
        (F.col("total") - F.col("before")).alias("rating_bound"),
        (F.col("total") - 1).alias("rating_top"),
    )
    bounds = (
        df.select("rating")
        .distinct()
        .withColumn("_floor", lowered)
        .join(floors, "_floor")
        .drop("_floor")
    )
    return positions, bounds


def cheaper_alternatives(
    df: DataFrame,
    product_ids: DataFrame | None = None,
    rating_tolerance: float = V.RATING_TOLERANCE,
) -> DataFrame:
    """Up to three cheaper products of the same category for every product.

    Strict: rated at most ``rating_tolerance`` lower. If fewer than three such
    products exist and dropping the rating condition finds more, the relaxed
    list is taken. Rows: product_id, place 1..3, the alternative's columns,
    ``pct_cheaper`` and ``relaxed``.

    The answer depends on category, price and rating only, so it is computed
    once per distinct triple (``cell``) and joined back. ``product_ids`` (one
    column ``product_id``) limits the products that are answered for.
    """
    _require_scored(df)
    wanted = df.select("product_id", "category", "price", "rating")
    if product_ids is not None:
        wanted = wanted.join(
            product_ids.select("product_id").distinct(), "product_id", "left_semi"
        )
    cells = _alternatives_per_cell(df, wanted, rating_tolerance)
    details = df.select(
        F.col("product_id").alias("alt_id"),
        F.col("product_name").alias("alt_name"),
        F.col("price").alias("alt_price"),
        F.col("rating").alias("alt_rating"),
        F.col("units_sold").alias("alt_units_sold"),
        F.col("value_score").alias("alt_score"),
        F.col("url").alias("alt_url"),
    )
    filled = cells.join(details, "alt_id")
    answers = wanted.join(filled, ["category", "price", "rating"])
    return answers.select(
        "product_id",
        "place",
        "alt_id",
        "alt_name",
        "alt_price",
        "alt_rating",
        "alt_units_sold",
        "alt_score",
        ((F.lit(1.0) - F.col("alt_price") / F.col("price")) * 100).alias("pct_cheaper"),
        "alt_url",
        "relaxed",
    )


def _entry() -> Column:
    """What ranks a product among others: high score first, then id."""
    return F.struct((-F.col("value_score")).alias("minus_score"), "product_id")


def _placed(best: DataFrame) -> DataFrame:
    """``best`` arrays as rows with ``place`` and ``alt_id``."""
    kept = [name for name in best.columns if name != "best"]
    return best.select(*kept, F.posexplode("best").alias("_at", "_entry")).select(
        *kept,
        (F.col("_at") + 1).alias("place"),
        F.col("_entry.product_id").alias("alt_id"),
    )


def _alternatives_per_cell(
    df: DataFrame, wanted: DataFrame, tolerance: float
) -> DataFrame:
    """(category, price, rating, place, alt_id, relaxed) for every wanted cell.

    The relaxed list depends on category and price only, so it is found once for
    all ratings.
    """
    price = ["category", "price"]
    cell = [*price, "rating"]
    price_places = with_prefix(
        df.select(*price).distinct().withColumn("n", F.lit(1)), "price", ["category"]
    ).select(
        *price,
        F.col("before").alias("price_position"),
        (F.col("total") - 1).alias("price_top"),
    )
    price_axis = Axis("price_position", "price_position", "price_top")
    rating_axis = Axis("rating_position", "rating_bound", "rating_top")
    rating_positions, rating_bounds = _rating_places(df, tolerance)
    scored = df.select(*cell, _entry().alias("entry"))
    cells = wanted.select(*cell).distinct()

    # At most three products of one cell can be among anybody's best three, and
    # likewise of one price; of those, none that three others outdo in everything.
    offered = (
        best_per_key(scored, cell, [F.asc("entry")], ALTERNATIVES)
        .join(price_places, price)
        .join(rating_positions, "rating")
    )
    strict = prefix_top_k(
        skyband(offered, ["category"], [price_axis, rating_axis], ALTERNATIVES),
        cells.join(price_places, price).join(rating_bounds, "rating"),
        group=["category"],
        axes=[price_axis, rating_axis],
        query_key=cell,
        k=ALTERNATIVES,
    )
    relaxed = prefix_top_k(
        best_per_key(scored, price, [F.asc("entry")], ALTERNATIVES).join(
            price_places, price
        ),
        wanted.select(*price).distinct().join(price_places, price),
        group=["category"],
        axes=[price_axis],
        query_key=price,
        k=ALTERNATIVES,
    )
    # Whoever has a strict list has a relaxed one at least as long.
    n_strict = F.coalesce(F.size("_strict"), F.lit(0))
    lists = (
        cells.join(relaxed.withColumnRenamed("best", "_relaxed"), price)
        .join(strict.withColumnRenamed("best", "_strict"), cell, "left")
        .withColumn("relaxed", F.size("_relaxed") > n_strict)
        .select(
            *cell,
            "relaxed",
            F.when(F.col("relaxed"), F.col("_relaxed"))
            .otherwise(F.col("_strict"))
            .alias("best"),
        )
    )
    return _placed(lists)


def alternative_notes(df: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Note per product telling how its alternatives were found."""
    found = alternatives.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_alternatives"), F.max("relaxed").alias("relaxed")
    )
    few = F.when(
        F.col("n_alternatives") < ALTERNATIVES,
        F.format_string(V.NOTE_FEW, F.col("n_alternatives")),
    ).otherwise(F.lit(""))
    kind = F.when(F.col("relaxed"), F.lit(V.NOTE_RELAXED)).otherwise(
        F.lit(V.NOTE_STRICT)
    )
    return (
        df.select("product_id", "category")
        .join(found, "product_id", "left")
        .select(
            "product_id",
            F.coalesce("n_alternatives", F.lit(0).cast("bigint")).alias(
                "n_alternatives"
            ),
            F.when(
                F.col("n_alternatives").isNull(),
                F.format_string(V.NOTE_NONE, F.col("category")),
            )
            .otherwise(F.concat(kind, few))
            .alias("alternatives_note"),
        )
    )


# --- evaluation ---------------------------------------------------------------


def evaluate_products(df: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """One record per product: percentile, segment, score and alternatives.

    ``product_ids`` (one column ``product_id``) limits the answer to those;
    ids the table lacks are reported by ``unknown_products``.
    """
    _require_scored(df)
    require_columns(df, ["segment", "segment_name"], "Segment the products first.")
    wanted = df
    if product_ids is not None:
        wanted = df.join(
            product_ids.select("product_id").distinct(), "product_id", "left_semi"
        )
    alternatives = cheaper_alternatives(df, product_ids)
    listed = alternatives.groupBy("product_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "place",
                    F.col("alt_id").alias("product_id"),
                    F.col("alt_name").alias("product_name"),
                    F.col("alt_price").alias("price"),
                    F.col("alt_rating").alias("rating"),
                    F.col("alt_units_sold").alias("units_sold"),
                    F.col("alt_score").alias("value_score"),
                    "pct_cheaper",
                    F.col("alt_url").alias("url"),
                )
            )
        ).alias("alternatives"),
        F.max("relaxed").alias("_relaxed"),
    )
    size = F.coalesce(F.size("alternatives"), F.lit(0))
    few = F.when(size < ALTERNATIVES, F.format_string(V.NOTE_FEW, size)).otherwise(
        F.lit("")
    )
    kind = F.when(F.col("_relaxed"), F.lit(V.NOTE_RELAXED)).otherwise(
        F.lit(V.NOTE_STRICT)
    )
    none = F.format_string(V.NOTE_NONE, F.col("category"))
    return (
        wanted.join(_percentile_per_price(df), ["category", "price"])
        .join(listed, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "price",
            "category",
            "price_percentile",
            "percentile_note",
            "segment",
            "segment_name",
            F.round("value_score", 1).alias("value_score"),
            "alternatives",
            F.when(F.col("alternatives").isNull(), none)
            .otherwise(F.concat(kind, few))
            .alias("alternatives_note"),
        )
    )


def unknown_products(df: DataFrame, product_ids: DataFrame) -> DataFrame:
    """Requested ids that are not in the table."""
    return (
        product_ids.select("product_id")
        .distinct()
        .join(df.select("product_id"), "product_id", "left_anti")
    )


def evaluate_product(df: DataFrame, product_id: str) -> DataFrame:
    """Record of one product; ValueError if the id is unknown."""
    one = df.filter(F.col("product_id") == F.lit(str(product_id)))
    if one.isEmpty():
        raise ValueError(f"unknown product {product_id!r}")
    return evaluate_products(df, one.select("product_id"))


# --- budget search ------------------------------------------------------------


def recommend_under_budget(
    df: DataFrame, budget: float, category: str | None = None, n: int = 5
) -> DataFrame:
    """The ``n`` best scored products not above the budget."""
    if budget <= 0:
        raise ValueError("budget must be > 0")
    _require_scored(df)
    affordable = df.filter(F.col("price") <= F.lit(float(budget)))
    if category is not None:
        affordable = affordable.filter(F.col("category") == F.lit(category))
    return (
        affordable.orderBy(F.desc("value_score"), F.asc("product_id"))
        .limit(n)
        .select(*RECOMMENDATION_COLUMNS)
    )


def recommend_batch(df: DataFrame, requests: DataFrame, n: int = 5) -> DataFrame:
    """``recommend_under_budget`` for a table of requests.

    ``requests``: request_id, budget, category (null for all categories). Rows:
    request_id, place 1..n and the recommendation columns. Requests that share
    category and affordable prices are answered once.
    """
    _require_scored(df)
    valid = requests.filter(F.col("budget") > 0).select(
        "request_id",
        F.col("budget").cast("double").alias("budget"),
        F.coalesce(
            F.concat(F.lit(CATEGORY_SCOPE), "category"), F.lit(ALL_CATEGORIES)
        ).alias("scope"),
    )
    both_scopes = F.array(
        F.concat(F.lit(CATEGORY_SCOPE), "category"), F.lit(ALL_CATEGORIES)
    )
    scoped = df.select(
        F.explode(both_scopes).alias("scope"), "price", "value_score", "product_id"
    )
    marks = (
        scoped.select("scope", "price", F.lit(1).alias("w"))
        .unionByName(
            valid.select("scope", F.col("budget").alias("price"), F.lit(0).alias("w"))
        )
        .groupBy("scope", "price")
        .agg(F.max("w").alias("n"))
    )
    # A price counts itself, so that a budget equal to a price affords it.
    places = with_prefix(marks, "price", ["scope"]).select(
        "scope",
        "price",
        F.col("before").alias("position"),
        (F.col("before") + F.col("n")).alias("bound"),
        (F.col("total") - 1).alias("top"),
    )
    # At most n products of one price can be among anybody's best n.
    candidates = best_per_key(
        scoped.select("scope", "price", _entry().alias("entry")),
        ["scope", "price"],
        [F.asc("entry")],
        n,
    ).join(places.drop("bound"), ["scope", "price"])
    asked = valid.withColumnRenamed("budget", "price").join(
        places.drop("position"), ["scope", "price"]
    )
    found = prefix_top_k(
        candidates,
        asked.select("scope", "bound", "top").filter("bound > 0").distinct(),
        group=["scope"],
        axes=[Axis("position", "bound", "top")],
        query_key=["scope", "bound"],
        k=n,
    )
    details = df.select(*RECOMMENDATION_COLUMNS)
    filled = _placed(found).withColumnRenamed("alt_id", "product_id").join(
        details, "product_id"
    )
    return (
        asked.select("request_id", "scope", "bound")
        .join(filled, ["scope", "bound"])
        .select("request_id", "place", *RECOMMENDATION_COLUMNS)
    )


def explain_recommendations(
    recommended: DataFrame, df: DataFrame, budget: float
) -> DataFrame:
    """Add the reason text of each recommendation."""
    means = category_means(df)
    saved = (F.lit(1.0) - F.col("price") / F.lit(float(budget))) * 100
    rating = F.col("rating").cast("string")
    quality = (
        F.when(
            F.col("rating") > F.col("mean_rating"),
            F.format_string(V.REASON_EXCELLENT, rating, tenth_text(F.col("mean_rating"))),
        )
        .when(F.col("rating") >= V.SAFE_RATING, F.format_string(V.REASON_SAFE, rating))
        .otherwise(F.lit(""))
    )
    sales = F.when(
        F.col("units_sold") > F.col("mean_units"),
        F.format_string(V.REASON_BEST_SELLER, F.col("units_sold").cast("string")),
    ).otherwise(F.lit(V.REASON_END))
    return recommended.join(means, "category").select(
        *recommended.columns,
        F.concat(
            F.format_string(V.REASON_BUDGET, whole_text(saved)), quality, sales
        ).alias("reason"),
    )


def sample_products(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        df.orderBy("product_id")
        .limit(n)
        .select(
            "product_id", "product_name", "category", "shop", "price", "units_sold",
            "rating",
        )
    )

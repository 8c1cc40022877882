"""One runnable query per operator, over the star schema.

Queries on the product table read it from a table that is built once per
session and data folder, as a user would build it before asking questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics import fixed_values as V
from shopmetrics.functions import parsing as P
from shopmetrics.operators import (
    assistant,
    clean,
    normalize,
    pages,
    score,
    segments,
    silhouettes,
    stats,
)
from shopmetrics.plans import star_view
from shopmetrics.plans.pipelines import build_products
from shopmetrics.schema import PRODUCT_COLUMNS, SCALED_FEATURES
from shopmetrics.sources import listings, tables
from shopmetrics.sources.staging import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
BUDGET = 2000.0
BUDGET_CATEGORY = "Thời trang nam"
PRICE_LOW, PRICE_HIGH = 1000.0, 3000.0
FILTER_CATEGORIES = ["Thời trang nam", "Sách tiếng Việt", "Ngành 20"]
N_SEGMENTS = 7
FIXED_CENTRES = [
    (0, [0.2, 0.2, 0.2, 0.2]),
    (1, [0.8, 0.8, 0.1, 0.5]),
    (2, [0.9, 0.3, 0.5, 0.2]),
    (3, [0.5, 0.9, 0.9, 0.9]),
]
FIXED_SIZES = (2, 3, 4)
FIXED_MOVES = 5

_built: dict[tuple[str, str, str], DataFrame] = {}


def _once(
    spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]
) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = stage(make(), name)
    return _built[key]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns to a fixed number of places."""
    return df.select(
        [
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- shared inputs -----------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_view.raw_listings(spark, sf_dir)


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_primary(raw(spark, sf_dir))


def marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_marketplace(star_view.marketplace_rows(spark, sf_dir))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written product table."""
    return _once(
        spark, sf_dir, "products", lambda: build_products(raw(spark, sf_dir))
    )


def two_source_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written product table of both sources."""
    return _once(
        spark,
        sf_dir,
        "two-source-products",
        lambda: build_products(normalised(spark, sf_dir), marketplace(spark, sf_dir)),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written product table with scaled features and score."""
    return _once(
        spark,
        sf_dir,
        "scored",
        lambda: score.value_score(score.scale_features(products(spark, sf_dir))),
    )


def labelled(spark: SparkSession, sf_dir: str, k: int = N_SEGMENTS) -> DataFrame:
    """Scored products under a fixed labelling, so that SQL can follow."""
    label = (F.col("product_id").cast("bigint") % k).cast("int")
    return scored(spark, sf_dir).withColumn("segment", label)


def advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assistant works on: scored, labelled and named, written."""
    return _once(
        spark,
        sf_dir,
        "advised",
        lambda: segments.with_segment_names(labelled(spark, sf_dir)),
    )


def budget_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget request per customer; every third asks for all categories."""
    customer = star_view.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return customer.select(
        key.alias("request_id"),
        (F.col("c_acctbal") + 500).alias("budget"),
        F.when(key % 3 == 1, BUDGET_CATEGORY)
        .when(key % 3 == 2, F.concat(F.lit(V.CATEGORY_PREFIX), (key % 50).cast("string")))
        .alias("category"),
    )


# --- sources and sinks -------------------------------------------------------


def s1_read_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the listings as page responses, one per line, and read them back."""
    items = raw(spark, sf_dir)
    fields = [c for c in items.columns if c != "arrival"]
    path = new_path(spark, "listing-pages")
    page = [F.col("arrival.l_orderkey"), F.col("arrival.l_linenumber")]
    responses = items.repartition(*page).groupBy(*page).agg(
        F.collect_list(F.struct(*fields)).alias("data")
    )
    tables.write_json(responses.select("data"), path)
    read = listings.read_listing_pages(spark, path, one_per_line=True, fields=fields)
    return rounded(normalize.normalize_primary(read).select(*PRODUCT_COLUMNS))


def s2_check_source_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.check_source_contract(raw(spark, sf_dir))


def s3_read_raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv_path = new_path(spark, "raw-csv")
    tables.write_raw(raw(spark, sf_dir), csv_path)
    read = listings.read_raw_csv(spark, csv_path)
    return rounded(normalize.normalize_primary(read).select(*PRODUCT_COLUMNS))


def s4_read_marketplace_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_view.marketplace_rows(spark, sf_dir)
    csv_path = new_path(spark, "market-csv")
    tables.write_raw(rows, csv_path)
    read = listings.read_marketplace_csv(spark, csv_path)
    return rounded(normalize.normalize_marketplace(read).select(*PRODUCT_COLUMNS))


def s5_write_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_path = new_path(spark, "raw-json")
    tables.write_raw(raw(spark, sf_dir), new_path(spark, "raw-csv"), json_path)
    rows = raw(spark, sf_dir).drop("arrival")
    return rounded(spark.read.schema(rows.schema).json(json_path))


def s6_write_read_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "product-table")
    tables.write_products(products(spark, sf_dir), path)
    return rounded(tables.read_products(spark, path))


def s6_replace_from_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by a query over itself, beside the version before."""
    path = new_path(spark, "replaced-table")
    tables.write_products(products(spark, sf_dir), path)
    cheap = tables.read_products(spark, path).where("price < 1000")
    tables.write_products(cheap, path)
    versions = [tables.read_products(spark, path, back=b).withColumn("back", F.lit(b)) for b in (0, 1)]
    return (
        versions[0]
        .unionByName(versions[1])
        .groupBy("back")
        .agg(
            F.count(F.lit(1)).alias("n_products"),
            F.round(F.max("price"), 6).alias("max_price"),
            F.sum("units_sold").alias("units_sold"),
        )
    )


def s7_write_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "outliers-csv")
    found = products(spark, sf_dir)
    tables.write_outliers(found, path)
    return rounded(spark.read.schema(found.schema).csv(path, header=True, escape='"'))


def s8_write_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored-csv")
    table = advised(spark, sf_dir)
    tables.write_scored(table, path)
    read = spark.read.schema(table.schema).csv(path, header=True, escape='"')
    return rounded(
        read.select("product_id", *SCALED_FEATURES, "value_score", "segment", "segment_name")
    )


def s9_write_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "quality-csv")
    tables.write_quality_report(products(spark, sf_dir), path)
    return (
        spark.read.schema("section int, metric string, value double")
        .csv(path, header=True, escape='"')
    )


# --- scalar functions and normalisation --------------------------------------


def n1_safe_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_view.marketplace_rows(spark, sf_dir)
    return rounded(
        rows.select(
            "product_id",
            P.safe_double(rows, "price").alias("price"),
            P.safe_double(rows, "original_price").alias("original_price"),
            P.safe_double(rows, "reviews").alias("reviews"),
        )
    )


def n2_units_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two tables, plain numbers and plain texts."""
    items = raw(spark, sf_dir)
    events = star_view.table(spark, sf_dir, "events").select("props", "value", "ts")
    events = events.withColumn("label", F.concat(F.lit("sold "), F.col("value"), F.lit("k")))
    return (
        items.select(F.lit("listing").alias("kind"), P.units_sold(items, "quantity_sold").alias("units"))
        .unionByName(
            events.select(F.lit("object").alias("kind"), P.units_sold(events, "props", "k").alias("units"))
        )
        .unionByName(
            events.select(F.lit("number").alias("kind"), P.units_sold(events, "value").alias("units"))
        )
        .unionByName(
            events.select(F.lit("text").alias("kind"), P.units_sold(events, "label").alias("units"))
        )
        .groupBy("kind", "units")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def n3_map_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        raw(spark, sf_dir)
        .select(
            "primary_category_path",
            P.map_category(F.col("primary_category_path")).alias("category"),
        )
        .groupBy("primary_category_path", "category")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def n4_default_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_view.marketplace_rows(spark, sf_dir)
    return rows.select(
        "product_id", P.shop_name(rows, "seller", V.PRIMARY_PLATFORM).alias("shop")
    )


def n5_price_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of texts: here a currency sign makes a price 0."""
    rows = star_view.marketplace_rows(spark, sf_dir)
    price, list_price = normalize.price_columns(rows)
    return rounded(
        rows.select("product_id", price.alias("price"), list_price.alias("list_price"))
    )


def n6_discount_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated discount and the one the prices imply, per listing."""
    items = raw(spark, sf_dir)
    price, list_price = normalize.price_columns(items)
    bare = items.drop("discount_rate")
    return rounded(
        items.select(
            "id",
            normalize.discount_ratio(items, price, list_price).alias("stated"),
            normalize.discount_ratio(bare, price, list_price).alias("implied"),
        )
    )


def n7_rating_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_view.marketplace_rows(spark, sf_dir)
    return rows.select(
        "product_id",
        P.numeric_or(rows, "rating_average", 0.0).alias("rating"),
        P.numeric_or(rows, "reviews", 0.0).alias("reviews"),
    )


def n8_product_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = raw(spark, sf_dir)
    rows = star_view.marketplace_rows(spark, sf_dir)

    def links(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            F.col(key).alias("id"),
            normalize.product_url(df).alias("url"),
            normalize.platform_name(df).alias("platform"),
        )

    return links(items, "id").unionByName(links(rows, "product_id"))


def n9_normalize_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalised(spark, sf_dir).select(*PRODUCT_COLUMNS))


def n10_normalize_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marketplace(spark, sf_dir))


def n11_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources; the second one without its url column."""
    merged = normalize.union_sources(
        normalised(spark, sf_dir), marketplace(spark, sf_dir).drop("url")
    )
    return rounded(merged.select(*PRODUCT_COLUMNS))


# --- cleaning ----------------------------------------------------------------


def c1_dedup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.dedup_raw(raw(spark, sf_dir))
    return rounded(kept.select("id", "name", "price", "discount_rate", "seller"))


def c1_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_counts(raw(spark, sf_dir))


def c2_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_incomplete(normalised(spark, sf_dir))
    return rounded(kept.select(*PRODUCT_COLUMNS))


def c3_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for columns emptied by a rule on the product number."""
    df = normalised(spark, sf_dir)
    key = F.col("product_id").cast("bigint")
    holes = {
        name: F.when(key % (i + 3) == 0, F.lit(None)).otherwise(F.col(name))
        for i, name in enumerate(
            ["shop", "category", "list_price", "discount_ratio", "units_sold", "rating"]
        )
    }
    return rounded(clean.fill_defaults(df.withColumns(holes)).select(*PRODUCT_COLUMNS))


def c4_dedup_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.dedup_products(clean.drop_incomplete(normalised(spark, sf_dir)))
    return rounded(kept.select(*PRODUCT_COLUMNS))


def c5_clip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalised(spark, sf_dir).withColumn("discount_ratio", F.col("discount_ratio") * 20 - 0.5)
    return rounded(
        clean.clip_ranges(df).select("product_id", "rating", "discount_ratio", "units_sold")
    )


def c6_positive_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        clean.positive_price(normalised(spark, sf_dir)).select("product_id", "price")
    )


def c7_flag_price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looser fences than the default, on the listings themselves."""
    df = clean.positive_price(clean.drop_incomplete(normalised(spark, sf_dir)))
    return rounded(
        clean.flag_price_outliers(df, iqr_multiplier=1.0, z_threshold=2.0).select(
            "product_id", "price", "price_outlier"
        )
    )


def c8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.outliers(products(spark, sf_dir)))


def c9_clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning as one lazy plan from the raw listings."""
    return rounded(clean.clean_products(raw(spark, sf_dir)))


def c9_clean_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_products(normalised(spark, sf_dir), marketplace(spark, sf_dir)))


def c10_cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaning_audit(normalised(spark, sf_dir))


# --- statistics --------------------------------------------------------------


def _on_products(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(products(spark, sf_dir)))


def _two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.choose_two_groups(products(spark, sf_dir))


def a8_choose_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        _two_groups(spark, sf_dir).select("product_id", "price", "grouping", "grp")
    )


def a8_two_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category only, so the two largest shops are compared."""
    one = stats.filter_products(products(spark, sf_dir), [BUDGET_CATEGORY])
    return stats.choose_two_groups(one).select("product_id", "grouping", "grp")


def a8_two_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank test of the price between the two platforms."""
    both = two_source_products(spark, sf_dir)
    return stats.mann_whitney(stats.choose_two_groups(both, "platform"))


def a9_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mann_whitney(_two_groups(spark, sf_dir))


def a9_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices of the low against the high ratings: few values, counted exactly."""
    means = products(spark, sf_dir).groupBy("rating").agg(F.avg("price").alias("price"))
    grp = F.when(F.col("rating") < 3, F.lit("low")).otherwise(F.lit("high"))
    return stats.mann_whitney(means.withColumn("grp", grp))


def a10_group_density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_density_histogram(_two_groups(spark, sf_dir))


def a11_group_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_kde(_two_groups(spark, sf_dir))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.filter_products(
        products(spark, sf_dir), FILTER_CATEGORIES, PRICE_LOW, PRICE_HIGH
    )


def a14_filter_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_filtered(spark, sf_dir))


def a15_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kpis(_filtered(spark, sf_dir), products(spark, sf_dir))


def a15_kpis_without_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kpis(
        _filtered(spark, sf_dir), products(spark, sf_dir).drop("price_outlier")
    )


def a16_price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.price_histogram(_filtered(spark, sf_dir))


# --- scoring and segments ----------------------------------------------------


def m1_scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        score.scale_features(products(spark, sf_dir)).select("product_id", *SCALED_FEATURES)
    )


def m2_value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"price": 0.25, "rating": 0.25, "units_sold": 0.3, "discount_ratio": 0.2}
    table = products(spark, sf_dir)
    custom = score.value_score(table, weights).withColumnRenamed("value_score", "custom_score")
    both = score.value_score(custom)
    return rounded(both.select("product_id", "value_score", "custom_score"))


def m3_top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.top_by_score(scored(spark, sf_dir)))


def m3_score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.score_range(scored(spark, sf_dir)))


def m4_k_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.k_table(scored(spark, sf_dir))


def m4_fixed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit from stated centres and for a stated number of moves."""
    starts = [[at for _, at in FIXED_CENTRES[:k]] for k in FIXED_SIZES]
    return rounded(segments.k_table_from_starts(scored(spark, sf_dir), starts, FIXED_MOVES))


def m5_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.silhouette(labelled(spark, sf_dir)))


def m5_euclidean_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = silhouettes.euclidean_silhouette(labelled(spark, sf_dir))
    return rounded(found.select("n_segments", "silhouette"))


def m6_segment_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        segments.segment_products(scored(spark, sf_dir), k=4).select(
            "product_id", "price", "value_score", "segment"
        )
    )


def m7_assign_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assign_segments(scored(spark, sf_dir), FIXED_CENTRES).select(
        "product_id", "segment"
    )


def _tiers(k: int) -> Query:
    return lambda spark, sf_dir: rounded(
        segments.segment_price_tier(labelled(spark, sf_dir, k)).select(
            "segment", "n_products", "mean_price", "tier"
        )
    )


def m9_segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_names(labelled(spark, sf_dir)).select(
        "segment", "good_side", "segment_name", "description"
    )


def m10_dedup_segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dedup_segment_names(labelled(spark, sf_dir)).select(
        "segment", "segment_name"
    )


def m11_segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.segment_profile(labelled(spark, sf_dir)))


def m12_segment_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advised(spark, sf_dir).select(
        "product_id", segments.segment_badge(F.col("segment_name")).alias("badge")
    )


def m13_segment_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.segment_map_points(advised(spark, sf_dir)))


# --- assistant ---------------------------------------------------------------


def r1_price_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.price_percentile(products(spark, sf_dir))


def r2_cheaper_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assistant.cheaper_alternatives(advised(spark, sf_dir)))


def r2_alternative_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = advised(spark, sf_dir)
    return assistant.alternative_notes(table, assistant.cheaper_alternatives(table))


def r3_evaluate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the alternatives shown as a text of ids."""
    records = assistant.evaluate_products(advised(spark, sf_dir))
    ids = F.transform("alternatives", lambda a: a["product_id"])
    shown = F.coalesce(F.array_join(ids, ","), F.lit(""))
    return rounded(records.withColumn("alternatives", shown))


def r3_unknown_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose listings did not survive cleaning."""
    asked = star_view.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id")
    )
    return assistant.unknown_products(advised(spark, sf_dir), asked)


def r4_recommend_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assistant.recommend_under_budget(advised(spark, sf_dir), BUDGET))


def r4_recommend_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        assistant.recommend_under_budget(
            advised(spark, sf_dir), BUDGET, BUDGET_CATEGORY, 3
        )
    )


def r4_recommend_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        assistant.recommend_batch(advised(spark, sf_dir), budget_requests(spark, sf_dir))
    )


def r5_explain_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = advised(spark, sf_dir)
    found = assistant.recommend_under_budget(table, BUDGET, n=50)
    explained = assistant.explain_recommendations(found, table, BUDGET)
    return explained.select("product_id", "reason")


def r6_page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_previews(star_view.product_pages(spark, sf_dir))


def r6_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_previews(star_view.table(spark, sf_dir, "pages"))


def r7_attach_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assistant.recommend_under_budget(advised(spark, sf_dir), BUDGET, n=200)
    previews = pages.attach_previews(
        found, star_view.product_pages(spark, sf_dir), "page_id"
    )
    return previews.select(
        "product_id", "url", "image", "title", "description", "placeholder"
    )


def r8_sample_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assistant.sample_products(products(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "s1_read_listing_pages": s1_read_listing_pages,
    "s2_check_source_contract": s2_check_source_contract,
    "s3_read_raw_csv": s3_read_raw_csv,
    "s4_read_marketplace_csv": s4_read_marketplace_csv,
    "s5_write_raw": s5_write_raw,
    "s6_write_read_products": s6_write_read_products,
    "s6_replace_from_itself": s6_replace_from_itself,
    "s7_write_outliers": s7_write_outliers,
    "s8_write_scored": s8_write_scored,
    "s9_write_quality_report": s9_write_quality_report,
    "n1_safe_double": n1_safe_double,
    "n2_units_sold": n2_units_sold,
    "n3_map_category": n3_map_category,
    "n4_default_shop": n4_default_shop,
    "n5_price_columns": n5_price_columns,
    "n6_discount_ratio": n6_discount_ratio,
    "n7_rating_or_zero": n7_rating_or_zero,
    "n8_product_url": n8_product_url,
    "n9_normalize_primary": n9_normalize_primary,
    "n10_normalize_marketplace": n10_normalize_marketplace,
    "n11_union_sources": n11_union_sources,
    "c1_dedup_raw": c1_dedup_raw,
    "c1_dedup_counts": c1_dedup_counts,
    "c2_drop_incomplete": c2_drop_incomplete,
    "c3_fill_defaults": c3_fill_defaults,
    "c4_dedup_products": c4_dedup_products,
    "c5_clip_ranges": c5_clip_ranges,
    "c6_positive_price": c6_positive_price,
    "c7_flag_price_outliers": c7_flag_price_outliers,
    "c8_outliers": c8_outliers,
    "c9_clean_products": c9_clean_products,
    "c9_clean_two_sources": c9_clean_two_sources,
    "c10_cleaning_audit": c10_cleaning_audit,
    "a1_quality_summary": _on_products(stats.quality_summary),
    "a2_top_shops": _on_products(stats.top_shops),
    "a3_category_distribution": _on_products(stats.category_distribution),
    "a4_top_category_share": _on_products(stats.top_category_share),
    "a5_price_box_stats": _on_products(stats.price_box_stats),
    "a6_spearman": _on_products(stats.spearman),
    "a6_spearman_price_rating": _on_products(
        lambda df: stats.spearman(df, "price", "rating")
    ),
    "a7_discount_sales_points": _on_products(stats.discount_sales_points),
    "a8_choose_two_groups": a8_choose_two_groups,
    "a8_two_shops": a8_two_shops,
    "a8_two_platforms": a8_two_platforms,
    "a9_mann_whitney": a9_mann_whitney,
    "a9_small_groups": a9_small_groups,
    "a10_group_density_histogram": a10_group_density_histogram,
    "a11_group_kde": a11_group_kde,
    "a12_top_sellers": _on_products(stats.top_sellers),
    "a13_outlier_discount_summary": _on_products(stats.outlier_discount_summary),
    "a14_filter_products": a14_filter_products,
    "a15_kpis": a15_kpis,
    "a15_kpis_without_flag": a15_kpis_without_flag,
    "a16_price_histogram": a16_price_histogram,
    "a17_price_bounds": _on_products(stats.price_bounds),
    "a18_eligible_categories": _on_products(stats.eligible_categories),
    "a19_category_means": _on_products(stats.category_means),
    "m1_scale_features": m1_scale_features,
    "m2_value_score": m2_value_score,
    "m3_top_by_score": m3_top_by_score,
    "m3_score_range": m3_score_range,
    "m4_k_table": m4_k_table,
    "m4_fixed_starts": m4_fixed_starts,
    "m5_silhouette": m5_silhouette,
    "m5_euclidean_silhouette": m5_euclidean_silhouette,
    "m6_segment_products": m6_segment_products,
    "m7_assign_segments": m7_assign_segments,
    "m8_segment_price_tier": _tiers(N_SEGMENTS),
    "m8_one_segment": _tiers(1),
    "m8_two_segments": _tiers(2),
    "m8_three_segments": _tiers(3),
    "m9_segment_names": m9_segment_names,
    "m10_dedup_segment_names": m10_dedup_segment_names,
    "m11_segment_profile": m11_segment_profile,
    "m12_segment_badge": m12_segment_badge,
    "m13_segment_map_points": m13_segment_map_points,
    "r1_price_percentile": r1_price_percentile,
    "r2_cheaper_alternatives": r2_cheaper_alternatives,
    "r2_alternative_notes": r2_alternative_notes,
    "r3_evaluate_products": r3_evaluate_products,
    "r3_unknown_products": r3_unknown_products,
    "r4_recommend_under_budget": r4_recommend_under_budget,
    "r4_recommend_in_category": r4_recommend_in_category,
    "r4_recommend_batch": r4_recommend_batch,
    "r5_explain_recommendations": r5_explain_recommendations,
    "r6_page_previews": r6_page_previews,
    "r6_plain_pages": r6_plain_pages,
    "r7_attach_previews": r7_attach_previews,
    "r8_sample_products": r8_sample_products,
}

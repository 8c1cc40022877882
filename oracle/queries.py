"""SQL for every registered query that SQL can express."""

from __future__ import annotations

from oracle.sql import (
    ARRIVAL,
    CLEAN_COLUMNS,
    DISTRIBUTION,
    MANN_WHITNEY_BODY,
    MARKET,
    PAGE_PREVIEWS,
    PRODUCT_COLUMNS,
    QUALITY,
    R1,
    R2_CTES,
    RECOMMENDED,
    build,
    category_of,
    mann_whitney_ctes,
    number,
    quality_report_sql,
    reason_sql,
    recommend_sql,
    safe_double,
    text,
    top_counts,
    two_groups,
)
from shopmetrics import fixed_values as V
from shopmetrics.plans import catalog as C


def _rounded(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


def _spearman(x: str, y: str) -> str:
    return build(
        "SELECT count(*) AS n_pairs, round(corr(rx, ry), 6) AS spearman FROM ranked",
        "products",
        {
            "ranked": f"""
                SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
                       rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
                FROM products"""
        },
    )


def _normalised_text() -> str:
    return build(f"SELECT {PRODUCT_COLUMNS} FROM norm", "norm")


def _both_sources() -> dict[str, str]:
    """Cleaned union of the two sources, replacing the single-source tables."""
    clipped = (
        "product_id, product_name, price, list_price, "
        "least(greatest(discount_ratio, 0.0), 1.0)::DOUBLE AS discount_ratio, units_sold, "
        "least(greatest(rating, 0.0), 5.0)::DOUBLE AS rating, category, platform, shop, url"
    )
    return {
        **MARKET,
        "merged": f"""SELECT * FROM unflagged UNION ALL
                      SELECT {clipped} FROM market_norm WHERE price > 0""",
        "wide_fences": """
            SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
                   avg(price) AS mean, stddev_samp(price) AS std FROM merged""",
        "merged_products": """
            SELECT m.*, (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)
                         OR abs((price - mean) / (std + 1e-10)) > 3.0) AS price_outlier
            FROM merged m, wide_fences""",
    }


FILTER = (
    "category IN (" + ", ".join(text(c) for c in C.FILTER_CATEGORIES) + ") "
    f"AND price BETWEEN {C.PRICE_LOW} AND {C.PRICE_HIGH}"
)


def _bins(source: str, count: str) -> dict[str, str]:
    return {
        "span": f"SELECT min(price) AS low, max(price) AS high, count(*) AS n FROM {source}",
        "grid": f"SELECT low, (high - low) / ({count}) AS width, {count} AS bins FROM span",
        "binned": f"""
            SELECT s.*, low, width,
                   cast(least(floor((price - low) / width), bins - 1) AS BIGINT) AS bin
            FROM {source} s, grid""",
    }


AUTO_BINS = """
    (SELECT ceil((high - low) / least(greatest(fd, (high - low) / sqrt(n) / 2), st))
     FROM (SELECT *, 2 * (SELECT quantile_cont(price, 0.75) - quantile_cont(price, 0.25)
                          FROM grouped) / cbrt(n::DOUBLE) AS fd,
                  (high - low) / (log2(n::DOUBLE) + 1) AS st FROM span))"""


def _tiers(k: int) -> str:
    return build(
        "SELECT segment, n_products, round(mean_price, 6) AS mean_price, tier FROM tiers",
        "tiers",
        k=k,
    )


def _squared_distance(at: list[float]) -> str:
    names = ["price_scaled", "rating_scaled", "units_sold_scaled", "discount_ratio_scaled"]
    return " + ".join(f"power({n} - {c}, 2)" for n, c in zip(names, at))


def _nearest() -> str:
    entries = ", ".join(
        f"{{'d': {_squared_distance(at)}, 'i': {i}}}" for i, at in C.FIXED_CENTRES
    )
    return f"list_sort([{entries}])[1].i::INTEGER"


# Mean over all products of the silhouette under squared distances, written out
# from its definition over all pairs.
SILHOUETTE = """
    SELECT (SELECT count(DISTINCT segment) FROM labelled) AS n_segments,
           round(avg((b - a) / greatest(a, b)), 6) AS silhouette
    FROM (SELECT product_id,
                 min(CASE WHEN own THEN total / (n - 1) END) AS a,
                 min(CASE WHEN NOT own THEN total / n END) AS b
          FROM (SELECT x.product_id, x.segment = y.segment AS own, y.segment, count(*) AS n,
                       sum(power(x.price_scaled - y.price_scaled, 2)
                           + power(x.rating_scaled - y.rating_scaled, 2)
                           + power(x.units_sold_scaled - y.units_sold_scaled, 2)
                           + power(x.discount_ratio_scaled - y.discount_ratio_scaled, 2)) AS total
                FROM labelled x, labelled y GROUP BY ALL)
          GROUP BY product_id)"""

FEATURES = [f"{n}_scaled" for n in ("price", "rating", "units_sold", "discount_ratio")]


def _between(a: str, b: str) -> str:
    return " + ".join(f"power({a}.{n} - {b}.{n}, 2)" for n in FEATURES)


def fixed_starts() -> str:
    """Centres moved to the means of their points, step by step, and their silhouettes."""
    names = ", ".join(FEATURES)
    values = ", ".join(
        f"({k}, {i}, {', '.join(f'{v}::DOUBLE' for v in at)})"
        for k in C.FIXED_SIZES for i, at in C.FIXED_CENTRES[:k]
    )
    ctes = {"points": f"SELECT row_number() OVER () AS r, {names} FROM scored"}
    ctes["c0"] = f"SELECT * FROM (VALUES {values}) AS t(k, i, {names})"
    for step in range(C.FIXED_MOVES + 1):
        ctes[f"a{step}"] = f"""
            SELECT r, k, {names}, (best).i AS i, (best).d AS d FROM points JOIN (
              SELECT r, c.k, min({{'d': {_between("p", "c")}, 'i': c.i}}) AS best
              FROM points p, c{step} c GROUP BY r, c.k) USING (r)"""
        ctes[f"c{step + 1}"] = f"""
            SELECT c.k, c.i, {", ".join(f"coalesce(avg(a.{n}), any_value(c.{n})) AS {n}" for n in FEATURES)}
            FROM c{step} c LEFT JOIN a{step} a ON a.k = c.k AND a.i = c.i GROUP BY c.k, c.i"""
    last = f"a{C.FIXED_MOVES}"
    ctes["means"] = f"""
        SELECT k, r, min(CASE WHEN own THEN total / (n - 1) END) AS inside,
          min(CASE WHEN NOT own THEN total / n END) AS outside
        FROM (SELECT x.k, x.r, x.i = y.i AS own, y.i, count(*) AS n, sum(sqrt({_between("x", "y")})) AS total
              FROM {last} x JOIN {last} y USING (k) GROUP BY ALL)
        GROUP BY k, r"""
    body = f"""
        SELECT k::INTEGER AS k, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette
        FROM (SELECT k, sum(d) AS inertia FROM {last} GROUP BY k)
        JOIN (SELECT k, avg((outside - inside) / greatest(outside, inside)) AS silhouette
              FROM means GROUP BY k) USING (k)"""
    return build(body, "scored", extra=ctes)


# The exact p: every choice of the ranks that the first group could have.
EXACT_P = """
    SELECT least(1.0, 2.0 * count(*) FILTER (WHERE u <= least(u_a, u_b)) / count(*)) AS exact
    FROM (SELECT u_a, u_b, list_sum(list_transform(list_filter(range(n_a + n_b),
                 lambda i: (mask >> i) & 1 = 1), lambda i: i + 1)) - n_a * (n_a + 1) / 2.0 AS u
          FROM scores, (SELECT unnest(range(65536)) AS mask)
          WHERE mask < (1 << (n_a + n_b)) AND bit_count(mask) = n_a)"""


def small_groups() -> str:
    return build(
        MANN_WHITNEY_BODY.replace(
            "least(1.0, CASE WHEN", "(SELECT exact FROM exact_p) + 0 * least(1.0, CASE WHEN", 1
        ),
        "products",
        extra={
            "grouped": """SELECT CASE WHEN rating < 3 THEN 'low' ELSE 'high' END AS grp,
                                 avg(price) AS price FROM products GROUP BY rating""",
            **mann_whitney_ctes(),
            "exact_p": EXACT_P,
        },
    )


K = C.N_SEGMENTS


def oracle_queries() -> dict[str, str]:
    named = dict(upto="final", k=K)
    grouped = two_groups()
    listing = build(f"SELECT {PRODUCT_COLUMNS} FROM norm", "norm")
    market = build(f"SELECT {PRODUCT_COLUMNS} FROM market_norm", extra=MARKET)
    return {
        "s1_read_listing_pages": listing,
        "s2_check_source_contract": build(
            """SELECT count(*) AS n_rows, count(*) - count(id) AS null_id,
                      count(*) - count(name) AS null_name, count(*) - count(price) AS null_price,
                      '' AS missing, count(*) > 0 AS ok FROM raw""",
            "raw",
        ),
        "s3_read_raw_csv": listing,
        "s4_read_marketplace_csv": market,
        "s5_write_raw": build(
            """SELECT id, name, round(price, 6) AS price,
                      round(original_price, 6) AS original_price,
                      round(discount_rate, 6) AS discount_rate,
                      '{"text":"x","value":' || quantity || '}' AS quantity_sold,
                      rating_average, primary_category_path, seller, url_path FROM raw""",
            "raw",
        ),
        "s6_write_read_products": build(f"SELECT {CLEAN_COLUMNS} FROM products", "products"),
        "s6_replace_from_itself": build(
            """SELECT back::INTEGER AS back, count(*) AS n_products, round(max(price), 6) AS max_price,
                      CAST(sum(units_sold) AS BIGINT) AS units_sold
               FROM products, (VALUES (0), (1)) AS v(back) WHERE back = 1 OR price < 1000 GROUP BY back""",
            "products",
        ),
        "s7_write_outliers": build(
            f"SELECT {CLEAN_COLUMNS} FROM products WHERE price_outlier", "products"
        ),
        "s8_write_scored": build(
            "SELECT product_id, "
            + _rounded(
                "price_scaled rating_scaled units_sold_scaled discount_ratio_scaled value_score"
            )
            + ", segment, segment_name FROM final",
            **named,
        ),
        "s9_write_quality_report": quality_report_sql(),
        "n1_safe_double": build(
            f"""SELECT product_id, round({safe_double('price')}, 6) AS price,
                       round({safe_double('original_price')}, 6) AS original_price,
                       {safe_double('reviews')} AS reviews FROM market""",
            extra=MARKET,
        ),
        "n2_units_sold": build(
            """SELECT kind, units, count(*) AS n_rows FROM (
                 SELECT 'listing' AS kind, quantity AS units FROM raw UNION ALL
                 SELECT 'object', cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) FROM events UNION ALL
                 SELECT 'number', cast(trunc(greatest(value, 0)) AS BIGINT) FROM events UNION ALL
                 SELECT 'text', cast(trunc(abs(value)) AS BIGINT) FROM events)
               GROUP BY kind, units""",
            "raw",
        ),
        "n3_map_category": build(
            f"""SELECT primary_category_path, {category_of('primary_category_path')} AS category,
                       count(*) AS n_rows FROM raw GROUP BY 1, 2""",
            "raw",
        ),
        "n4_default_shop": build(
            """SELECT product_id, CASE WHEN seller IS NULL OR seller IN ('', 'nan')
                      OR lower(seller) = 'none' THEN 'Tiki' ELSE seller END AS shop FROM market""",
            extra=MARKET,
        ),
        "n5_price_columns": build(
            f"""SELECT product_id, round(coalesce({number('price')}, 0), 6) AS price,
                       round(coalesce({number('original_price')}, {number('price')}, 0), 6)
                       AS list_price FROM market""",
            extra=MARKET,
        ),
        "n6_discount_ratio": build(
            """SELECT id, round(coalesce(discount_rate, 0) / 100, 6) AS stated,
                      round(CASE WHEN lp > 0 THEN greatest((lp - price) / lp, 0.0) ELSE 0 END, 6)::DOUBLE
                      AS implied
               FROM (SELECT *, coalesce(original_price, price) AS lp FROM raw)""",
            "raw",
        ),
        "n7_rating_or_zero": build(
            f"""SELECT product_id, coalesce({number('rating_average')}, 0)::DOUBLE AS rating,
                       coalesce({number('reviews')}, 0)::DOUBLE AS reviews FROM market""",
            extra=MARKET,
        ),
        "n8_product_url": build(
            """SELECT id, 'https://tiki.vn/' || url_path AS url, 'Tiki' AS platform FROM raw
               UNION ALL
               SELECT product_id, coalesce(url, ''), 'Tiki' FROM market""",
            "raw",
            MARKET,
        ),
        "n9_normalize_primary": listing,
        "n10_normalize_marketplace": market,
        "n11_union_sources": build(
            f"""SELECT {PRODUCT_COLUMNS} FROM norm UNION ALL
                SELECT * REPLACE (NULL::VARCHAR AS url) FROM
                  (SELECT {PRODUCT_COLUMNS} FROM market_norm)""",
            "norm",
            MARKET,
        ),
        "c1_dedup_raw": build(
            f"""SELECT id, name, round(price, 6) AS price, discount_rate, seller FROM (
                  SELECT *, row_number() OVER (PARTITION BY id ORDER BY {ARRIVAL}) AS copy
                  FROM raw) WHERE copy = 1""",
            "raw",
        ),
        "c1_dedup_counts": build(
            """SELECT count(*) AS rows_before, count(DISTINCT id) AS rows_after,
                      count(*) - count(DISTINCT id) AS duplicates FROM raw""",
            "raw",
        ),
        "c2_drop_incomplete": build(
            f"""SELECT {PRODUCT_COLUMNS} FROM norm WHERE product_id IS NOT NULL
                AND product_name IS NOT NULL AND price IS NOT NULL""",
            "norm",
        ),
        "c3_fill_defaults": build(
            f"""SELECT {PRODUCT_COLUMNS} FROM (SELECT * REPLACE (
                  CASE WHEN key % 3 = 0 THEN 'Tiki' ELSE shop END AS shop,
                  CASE WHEN key % 4 = 0 THEN {text(V.UNKNOWN_CATEGORY)} ELSE category END AS category,
                  CASE WHEN key % 5 = 0 THEN price ELSE list_price END AS list_price,
                  CASE WHEN key % 6 = 0 THEN 0 ELSE discount_ratio END AS discount_ratio,
                  CASE WHEN key % 7 = 0 THEN 0 ELSE units_sold END AS units_sold,
                  CASE WHEN key % 8 = 0 THEN 0 ELSE rating END AS rating)
                FROM (SELECT *, cast(product_id AS BIGINT) AS key FROM norm))""",
            "norm",
        ),
        "c4_dedup_products": build(
            f"SELECT {PRODUCT_COLUMNS} FROM first_copies", "first_copies"
        ),
        "c5_clip_ranges": build(
            """SELECT product_id, least(greatest(rating, 0), 5)::DOUBLE AS rating,
                      round(least(greatest(discount_ratio * 20 - 0.5, 0), 1), 6)::DOUBLE AS discount_ratio,
                      units_sold FROM norm""",
            "norm",
        ),
        "c6_positive_price": build(
            "SELECT product_id, round(price, 6) AS price FROM norm WHERE price > 0", "norm"
        ),
        "c7_flag_price_outliers": build(
            """SELECT product_id, round(price, 6) AS price,
                      (price < q1 - (q3 - q1) OR price > q3 + (q3 - q1)
                       OR abs((price - m) / (s + 1e-10)) > 2.0) AS price_outlier
               FROM listed, (SELECT quantile_cont(price, 0.25) AS q1,
                                    quantile_cont(price, 0.75) AS q3, avg(price) AS m,
                                    stddev_samp(price) AS s FROM listed)""",
            "norm",
            {"listed": "SELECT * FROM norm WHERE product_name IS NOT NULL AND price > 0"},
        ),
        "c8_outliers": build(
            f"SELECT {CLEAN_COLUMNS} FROM products WHERE price_outlier", "products"
        ),
        "c9_clean_products": build(f"SELECT {CLEAN_COLUMNS} FROM products", "products"),
        "c9_clean_two_sources": build(
            f"SELECT {CLEAN_COLUMNS} FROM merged_products", "unflagged", _both_sources()
        ),
        "c10_cleaning_audit": build(
            """SELECT step_no, step, rows_in, rows_out,
                      round(rows_out * 100.0::DOUBLE / rows_in, 6) AS pct_out
               FROM (SELECT 1 AS step_no, 'drop_incomplete' AS step, a AS rows_in, b AS rows_out FROM n
                     UNION ALL SELECT 2, 'dedup_products', b, c FROM n
                     UNION ALL SELECT 3, 'positive_price', c, d FROM n
                     UNION ALL SELECT 4, 'flag_outliers', d, e FROM n)""",
            "products",
            {
                "n": """SELECT (SELECT count(*) FROM norm) AS a,
                               (SELECT count(product_name) FROM norm) AS b,
                               (SELECT count(*) FROM first_copies) AS c,
                               (SELECT count(*) FROM products) AS d,
                               (SELECT count(*) FROM products WHERE price_outlier) AS e"""
            },
        ),
        "a1_quality_summary": build(QUALITY, "products"),
        "a2_top_shops": build(top_counts("shop", 10), "products"),
        "a3_category_distribution": build(DISTRIBUTION, "products"),
        "a4_top_category_share": build(
            """SELECT *, round(n_products * 100.0::DOUBLE / sum(n_products) OVER (), 6) AS pct
               FROM top5""",
            "products",
            {"top5": top_counts("category", 5)},
        ),
        "a5_price_box_stats": build(
            """SELECT category, count(*) AS n_products, round(q1, 6) AS q1,
                      round(median, 6) AS median, round(q3, 6) AS q3,
                      round(least(min(price) FILTER (price >= lo), q1), 6) AS whisker_low,
                      round(greatest(max(price) FILTER (price <= hi), q3), 6) AS whisker_high,
                      count(*) FILTER (price < lo OR price > hi) AS n_outliers
               FROM products JOIN boxes USING (category) GROUP BY category, q1, median, q3""",
            "products",
            {
                "top5": top_counts("category", 5),
                "quartiles": """
                    SELECT category, quantile_cont(price, 0.25) AS q1, median(price) AS median,
                           quantile_cont(price, 0.75) AS q3
                    FROM products JOIN top5 USING (category) GROUP BY category""",
                "boxes": """SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
                            FROM quartiles""",
            },
        ),
        "a6_spearman": _spearman("discount_ratio", "units_sold"),
        "a6_spearman_price_rating": _spearman("price", "rating"),
        "a7_discount_sales_points": build(
            """SELECT product_id, round(discount_ratio * 100, 6) AS discount_pct, units_sold,
                      rating, product_name, shop FROM products""",
            "products",
        ),
        "a8_choose_two_groups": build(
            """SELECT product_id, round(price, 6) AS price, 'category' AS grouping, grp
               FROM grouped""",
            "products",
            grouped,
        ),
        "a8_two_shops": build(
            "SELECT product_id, 'shop' AS grouping, shop AS grp FROM one JOIN top2 USING (shop)",
            "products",
            {
                "one": f"SELECT * FROM products WHERE category = {text(C.BUDGET_CATEGORY)}",
                "top2": """SELECT shop, count(*) AS n FROM one GROUP BY shop
                           ORDER BY n DESC, shop LIMIT 2""",
            },
        ),
        "a8_two_platforms": build(
            MANN_WHITNEY_BODY,
            "unflagged",
            {
                **_both_sources(),
                "grouped": "SELECT *, platform AS grp FROM merged_products",
                **mann_whitney_ctes(),
            },
        ),
        "a9_mann_whitney": build(
            MANN_WHITNEY_BODY, "products", {**grouped, **mann_whitney_ctes()}
        ),
        "a9_small_groups": small_groups(),
        "a10_group_density_histogram": build(
            """SELECT grp, bin, round(low + bin * width, 6) AS bin_start,
                      round(low + (bin + 1) * width, 6) AS bin_end, count(*) AS n_rows,
                      round(count(*) / (sum(count(*)) OVER (PARTITION BY grp) * width), 9) AS density
               FROM binned GROUP BY grp, bin, low, width""",
            "products",
            {**grouped, **_bins("grouped", AUTO_BINS)},
        ),
        "a11_group_kde": build(
            """SELECT grp, point, round(x, 6) AS x,
                      round(sum(exp(-power((x - price) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 9)
                      AS density
               FROM grouped JOIN moments USING (grp),
                    (SELECT cast(i AS INTEGER) AS point, low + i * (high - low) / 199 AS x
                     FROM range(200) t(i), span)
               GROUP BY grp, point, x, n, h""",
            "products",
            {
                **grouped,
                "span": "SELECT min(price) AS low, max(price) AS high FROM grouped",
                "moments": """SELECT grp, count(*) AS n,
                                     stddev_samp(price) * power(count(*), -0.2) AS h
                              FROM grouped GROUP BY grp""",
            },
        ),
        "a12_top_sellers": build(
            """SELECT product_id, product_name, substring(product_name, 1, 30) || '...' AS label,
                      units_sold FROM products ORDER BY units_sold DESC, product_id LIMIT 5""",
            "products",
        ),
        "a13_outlier_discount_summary": build(
            """SELECT true AS has_data, count(*) FILTER (price_outlier) AS n_flagged,
                      count(*) AS n_total,
                      round(count(*) FILTER (price_outlier) * 100.0::DOUBLE / count(*), 1) AS pct_flagged,
                      coalesce(round(avg(discount_ratio) FILTER (price_outlier) * 100, 1), 0) AS mean_discount_flagged,
                      coalesce(round(avg(discount_ratio) FILTER (NOT price_outlier) * 100, 1), 0) AS mean_discount_other
               FROM products""",
            "products",
        ),
        "a14_filter_products": build(
            f"SELECT {CLEAN_COLUMNS} FROM products WHERE {FILTER}", "products"
        ),
        "a15_kpis": build(
            f"""SELECT count(*) AS n_products, round(avg(price), 6) AS mean_price,
                       round(avg(rating), 6) AS mean_rating,
                       (SELECT count(*) FROM products WHERE price_outlier) AS n_outliers,
                       (SELECT round(count(*) FILTER (price_outlier) * 100.0::DOUBLE / count(*), 1)
                        FROM products) AS outlier_pct
                FROM products WHERE {FILTER}""",
            "products",
        ),
        "a15_kpis_without_flag": build(
            f"""SELECT count(*) AS n_products, round(avg(price), 6) AS mean_price,
                       round(avg(rating), 6) AS mean_rating,
                       round(avg(discount_ratio) * 100, 6) AS mean_discount_pct
                FROM products WHERE {FILTER}""",
            "products",
        ),
        "a16_price_histogram": build(
            """SELECT bin, round(low + bin * width, 6) AS bin_start,
                      round(low + (bin + 1) * width, 6) AS bin_end, count(*) AS n_products
               FROM binned GROUP BY bin, low, width""",
            "products",
            {
                "filtered": f"SELECT * FROM products WHERE {FILTER}",
                **_bins("filtered", "30"),
            },
        ),
        "a17_price_bounds": build(
            """SELECT round(min(price), 6) AS min_price, round(max(price), 6) AS max_price
               FROM products""",
            "products",
        ),
        "a18_eligible_categories": build(
            """SELECT category, count(*) AS n_products,
                      category || ' (' || count(*) || ' sản phẩm)' AS label
               FROM products GROUP BY category HAVING count(*) >= 3""",
            "products",
        ),
        "a19_category_means": build(
            """SELECT category, round(avg(rating), 6) AS mean_rating,
                      round(avg(units_sold), 6) AS mean_units FROM products GROUP BY category""",
            "products",
        ),
        "m1_scale_features": build(
            "SELECT product_id, "
            + _rounded("price_scaled rating_scaled units_sold_scaled discount_ratio_scaled")
            + " FROM scaled",
            "scaled",
        ),
        "m2_value_score": build(
            """SELECT product_id, round(value_score, 6) AS value_score,
                      round((0.25 * price_scaled + 0.25 * rating_scaled + 0.3 * units_sold_scaled
                             + 0.2 * discount_ratio_scaled) * 100, 6) AS custom_score
               FROM scored""",
            "scored",
        ),
        "m3_top_by_score": build(
            """SELECT product_id, product_name, round(price, 6) AS price, rating, units_sold,
                      discount_ratio, round(value_score, 6) AS value_score
               FROM scored ORDER BY scored.value_score DESC, product_id LIMIT 5""",
            "scored",
        ),
        "m3_score_range": build(
            """SELECT round(min(value_score), 6) AS min_score, round(max(value_score), 6) AS max_score,
                      round(avg(value_score), 6) AS mean_score FROM scored""",
            "scored",
        ),
        "m4_fixed_starts": fixed_starts(),
        "m5_silhouette": build(SILHOUETTE, "labelled", k=K),
        "m5_euclidean_silhouette": build(
            SILHOUETTE.replace("sum(power(", "sum(sqrt(power(").replace(") AS total", ")) AS total"),
            "labelled",
            k=K,
        ),
        "m7_assign_segments": build(
            f"SELECT product_id, {_nearest()} AS segment FROM scored", "scored"
        ),
        "m8_segment_price_tier": _tiers(K),
        "m8_one_segment": _tiers(1),
        "m8_two_segments": _tiers(2),
        "m8_three_segments": _tiers(3),
        "m9_segment_names": build(
            """SELECT segment, good_side, plain_name AS segment_name, description
               FROM named_once""",
            "named_once",
            k=K,
        ),
        "m10_dedup_segment_names": build(
            "SELECT segment, segment_name FROM named", "named", k=K
        ),
        "m11_segment_profile": build(
            "SELECT segment, segment_name, n_products, "
            + _rounded(
                "mean_price mean_rating mean_units_sold mean_discount_ratio mean_value_score"
            )
            + ", description FROM named",
            "named",
            k=K,
        ),
        "m12_segment_badge": build(
            """SELECT product_id, CASE WHEN contains(segment_name, ' - ')
                      THEN split_part(segment_name, ' - ', 2) ELSE segment_name END AS badge
               FROM final""",
            **named,
        ),
        "m13_segment_map_points": build(
            """SELECT product_id, round(price, 6) AS price, round(value_score, 6) AS value_score,
                      segment_name, product_name, rating, round(discount_ratio, 6) AS discount_ratio
               FROM final""",
            **named,
        ),
        "r1_price_percentile": build(R1, "products"),
        "r2_cheaper_alternatives": build(
            """SELECT product_id, cast(place AS INTEGER) AS place, alt_id, alt_name,
                      round(alt_price, 6) AS alt_price, alt_rating, alt_units_sold,
                      round(alt_score, 6) AS alt_score, round(pct_cheaper, 6) AS pct_cheaper,
                      alt_url, relaxed FROM answers""",
            **named,
            extra=R2_CTES,
        ),
        "r2_alternative_notes": build("SELECT * FROM notes", **named, extra=R2_CTES),
        "r3_evaluate_products": build(
            """SELECT f.product_id, product_name, round(price, 6) AS price, category,
                      price_percentile, percentile_note, segment, segment_name,
                      round(value_score, 1) AS value_score,
                      coalesce(ids, '') AS alternatives, alternatives_note
               FROM final f JOIN percentiles USING (product_id) JOIN notes USING (product_id)
               LEFT JOIN (SELECT product_id, string_agg(alt_id, ',' ORDER BY place) AS ids
                          FROM answers GROUP BY product_id) USING (product_id)""",
            **named,
            extra={**R2_CTES, "percentiles": R1},
        ),
        "r3_unknown_products": build(
            """SELECT cast(p_partkey AS VARCHAR) AS product_id FROM part
               WHERE cast(p_partkey AS VARCHAR) NOT IN (SELECT product_id FROM products)""",
            "products",
        ),
        "r4_recommend_under_budget": build(
            f"SELECT {RECOMMENDED} FROM ({recommend_sql(C.BUDGET, None, 5)})", **named
        ),
        "r4_recommend_in_category": build(
            f"SELECT {RECOMMENDED} FROM ({recommend_sql(C.BUDGET, C.BUDGET_CATEGORY, 3)})",
            **named,
        ),
        "r4_recommend_batch": build(
            f"""SELECT request_id, cast(place AS INTEGER) AS place, {RECOMMENDED} FROM (
                  SELECT f.*, request_id, row_number() OVER (
                           PARTITION BY request_id ORDER BY value_score DESC, product_id) AS place
                  FROM requests r JOIN final f
                    ON f.price <= budget AND (r.category IS NULL OR r.category = f.category))
                WHERE place <= 5""",
            **named,
            extra={
                "requests": f"""
                    SELECT c_custkey AS request_id, c_acctbal + 500 AS budget,
                           CASE c_custkey % 3 WHEN 1 THEN {text(C.BUDGET_CATEGORY)}
                                WHEN 2 THEN 'Ngành ' || (c_custkey % 50) END AS category
                    FROM customer WHERE c_acctbal + 500 > 0"""
            },
        ),
        "r5_explain_recommendations": build(
            f"""SELECT product_id, {reason_sql(C.BUDGET)} AS reason
                FROM ({recommend_sql(C.BUDGET, None, 50)}) r
                JOIN (SELECT category, avg(rating) AS mr, avg(units_sold) AS mu
                      FROM final GROUP BY category) USING (category)""",
            **named,
        ),
        "r6_page_previews": PAGE_PREVIEWS,
        "r6_plain_pages": """
            SELECT page_id, url, true AS has_preview, NULL::VARCHAR AS image,
                   'Không có tiêu đề' AS title, '' AS description FROM pages""",
        "r7_attach_previews": build(
            f"""SELECT product_id, r.url, image, title, description,
                       CASE WHEN image IS NULL THEN 'Không có ảnh' END AS placeholder
                FROM ({recommend_sql(C.BUDGET, None, 200)}) r LEFT JOIN previews p USING (url)""",
            **named,
            extra={"previews": PAGE_PREVIEWS},
        ),
        "r8_sample_products": build(
            """SELECT product_id, product_name, category, shop, round(price, 6) AS price,
                      units_sold, rating FROM products ORDER BY product_id LIMIT 5""",
            "products",
        ),
    }

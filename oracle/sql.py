"""Reference answers of the registered queries, in SQL for DuckDB.

Written from the definitions of the operators, independently of the Spark
code; only fixed texts and maps are shared. Doubles are rounded to 6 places
on both sides.
"""

from __future__ import annotations

from shopmetrics import fixed_values as V


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case_of(expression: str, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items())
    return f"(CASE {expression} {arms} END)"


def category_of(path: str) -> str:
    parts = [f"split_part({path}, '/', {i})" for i in (1, 2, 3)]
    families = ", ".join(case_of(p, V.PARENT_CATEGORIES) for p in parts)
    details = ", ".join(case_of(p, V.DETAIL_CATEGORIES) for p in reversed(parts))
    return f"coalesce({families}, {details}, {text(V.CATEGORY_PREFIX)} || {parts[2]})"


ARRIVAL = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(expression: str) -> str:
    """Number in a text or null."""
    return (
        f"(CASE WHEN regexp_matches({expression}, {text(NUMBER)}) "
        f"THEN try_cast(trim({expression}) AS DOUBLE) END)"
    )


def safe_double(expression: str) -> str:
    return f"coalesce({number(f'translate({expression}, {text('đ,')}, {text('')})')}, 0.0::DOUBLE)"


CTES = {
    "raw": f"""
        SELECT cast(l_partkey AS VARCHAR) AS id,
               CASE WHEN l_orderkey % 101 = 0 THEN NULL
                    ELSE p_name || ' ' || p_brand END AS name,
               CASE WHEN l_orderkey % 97 = 0 THEN 0.0::DOUBLE
                    ELSE floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS price,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL
                    ELSE p_retailprice * 10 END AS original_price,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL
                    ELSE round(l_discount * 100, 0) END AS discount_rate,
               cast(l_quantity AS BIGINT) AS quantity,
               (p_partkey % 12) * 0.5::DOUBLE AS rating_average,
               '99/' || CASE p_type WHEN 'PROMO' THEN '8322' WHEN 'LARGE' THEN '1789'
                                    WHEN 'SMALL' THEN '915' ELSE 'x' END
                     || '/' || p_size AS primary_category_path,
               s_name AS seller,
               'p' || l_partkey AS url_path,
               {ARRIVAL}
        FROM lineitem JOIN part ON l_partkey = p_partkey
                      JOIN supplier ON l_suppkey = s_suppkey""",
    "norm": f"""
        SELECT id AS product_id, name AS product_name, price,
               coalesce(original_price, price) AS list_price,
               coalesce(discount_rate, 0.0::DOUBLE) / 100 AS discount_ratio,
               quantity AS units_sold, rating_average AS rating,
               {category_of('primary_category_path')} AS category,
               'Tiki' AS platform, seller AS shop,
               'https://tiki.vn/' || url_path AS url, {ARRIVAL}
        FROM raw""",
    "first_copies": f"""
        SELECT * EXCLUDE (copy) FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {ARRIVAL}) AS copy
          FROM norm
          WHERE product_id IS NOT NULL AND product_name IS NOT NULL AND price IS NOT NULL)
        WHERE copy = 1""",
    "unflagged": """
        SELECT product_id, product_name, price, list_price,
               least(greatest(discount_ratio, 0.0), 1.0)::DOUBLE AS discount_ratio,
               units_sold, least(greatest(rating, 0.0), 5.0)::DOUBLE AS rating,
               category, platform, shop, url
        FROM first_copies WHERE price > 0""",
    "fences": """
        SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
               avg(price) AS mean, stddev_samp(price) AS std FROM unflagged""",
    "products": """
        SELECT u.*, (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)
                     OR coalesce(abs((price - mean) / (std + 1e-10)) > 3.0, false))
                    AS price_outlier
        FROM unflagged u, fences""",
    "ranges": """
        SELECT min(price) p0, max(price) p1, min(rating) r0, max(rating) r1,
               min(units_sold)::DOUBLE u0, max(units_sold)::DOUBLE u1,
               min(discount_ratio) d0, max(discount_ratio) d1 FROM products""",
    "scaled": """
        SELECT p.*,
               1.0::DOUBLE - CASE WHEN p1 > p0 THEN (price - p0) / (p1 - p0) ELSE 0 END AS price_scaled,
               CASE WHEN r1 > r0 THEN (rating - r0) / (r1 - r0) ELSE 0 END AS rating_scaled,
               CASE WHEN u1 > u0 THEN (units_sold - u0) / (u1 - u0) ELSE 0 END AS units_sold_scaled,
               CASE WHEN d1 > d0 THEN (discount_ratio - d0) / (d1 - d0) ELSE 0 END AS discount_ratio_scaled
        FROM products p, ranges""",
    "scored": """
        SELECT *, (0.4::DOUBLE * price_scaled + 0.3::DOUBLE * rating_scaled
                   + 0.2::DOUBLE * units_sold_scaled
                   + 0.1::DOUBLE * discount_ratio_scaled) * 100 AS value_score
        FROM scaled""",
}


def segment_ctes(k: int) -> dict[str, str]:
    """Names of the fixed labelling ``product_id % k``."""
    side = "CASE tier " + " ".join(
        f"WHEN {text(t)} THEN CASE WHEN good_side THEN {text(V.SEGMENT_SIDES[t, True])} "
        f"ELSE {text(V.SEGMENT_SIDES[t, False])} END"
        for t in (V.TIER_CHEAP, V.TIER_MIDDLE, V.TIER_EXPENSIVE)
    ) + " END"
    description = "CASE tier " + " ".join(
        f"WHEN {text(t)} THEN CASE WHEN good_side THEN "
        f"{text(V.SEGMENT_DESCRIPTIONS[t, True])} "
        f"ELSE {text(V.SEGMENT_DESCRIPTIONS[t, False])} END"
        for t in (V.TIER_CHEAP, V.TIER_MIDDLE, V.TIER_EXPENSIVE)
    ) + " END"
    return {
        "labelled": f"SELECT *, cast(cast(product_id AS BIGINT) % {k} AS INTEGER) AS segment FROM scored",
        "means": """
            SELECT segment, count(*) AS n_products, avg(price) AS mean_price,
                   avg(rating) AS mean_rating, avg(units_sold) AS mean_units_sold,
                   avg(discount_ratio) AS mean_discount_ratio,
                   avg(value_score) AS mean_value_score
            FROM labelled GROUP BY segment""",
        "tiers": f"""
            SELECT * EXCLUDE (place, n), CASE
                     WHEN n = 1 THEN {text(V.TIER_MIDDLE)}
                     WHEN n = 2 THEN CASE place WHEN 1 THEN {text(V.TIER_CHEAP)}
                                                ELSE {text(V.TIER_EXPENSIVE)} END
                     WHEN place <= (n + 2) // 3 THEN {text(V.TIER_CHEAP)}
                     WHEN place <= (n + 2) // 3 + (n + 1) // 3 THEN {text(V.TIER_MIDDLE)}
                     ELSE {text(V.TIER_EXPENSIVE)} END AS tier
            FROM (SELECT *, row_number() OVER (ORDER BY mean_price, segment) AS place,
                         count(*) OVER () AS n FROM means)""",
        "sides": """
            SELECT *, mean_rating >= median(mean_rating) OVER (PARTITION BY tier) AS good_side
            FROM tiers""",
        "named_once": f"""
            SELECT *, tier || {text(V.NAME_SEPARATOR)} || {side} AS plain_name,
                   {description} AS description FROM sides""",
        "named": """
            SELECT * EXCLUDE (plain_name),
                   CASE WHEN count(*) OVER (PARTITION BY plain_name) > 1
                        THEN plain_name || ' (nhóm ' || row_number() OVER (
                               PARTITION BY plain_name
                               ORDER BY mean_value_score DESC, segment) || ')'
                        ELSE plain_name END AS segment_name
            FROM named_once""",
        "final": """
            SELECT l.*, n.segment_name FROM labelled l JOIN named n USING (segment)""",
    }


MARKET = {
    "market": r"""
        SELECT 'k' || p_partkey AS product_id,
               CASE WHEN p_partkey % 29 = 0 THEN '  ' WHEN p_partkey % 31 = 0 THEN NULL
                    ELSE ' ' || p_name END AS title,
               CASE WHEN p_partkey % 11 = 0 THEN '1,' || p_retailprice || ' đ'
                    WHEN p_partkey % 13 = 0 THEN 'abc' WHEN p_partkey % 17 = 0 THEN '12d'
                    WHEN p_partkey % 19 = 0 THEN '1e3'
                    ELSE cast(p_retailprice AS VARCHAR) END AS price,
               CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN '0'
                    ELSE cast(p_retailprice + p_partkey % 7 * 100 - 200 AS VARCHAR)
                    END AS original_price,
               CASE WHEN p_partkey % 4 = 0 THEN 'None' WHEN p_partkey % 6 = 0 THEN 'nan'
                    ELSE ' ' || p_brand || ' ' END AS seller,
               cast((p_partkey % 12) * 0.5::DOUBLE AS VARCHAR) AS rating_average,
               CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size || '.7' END AS reviews,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS category,
               CASE WHEN p_partkey % 2 = 0 THEN 'https://shop.example/' || p_partkey END AS url,
               CASE WHEN p_partkey % 3 <> 0 THEN 's-' || p_partkey END AS slug
        FROM part""",
    "market_prices": f"""
        SELECT *, {safe_double('price')} AS p, {safe_double('original_price')} AS lp
        FROM market""",
    "market_norm": f"""
        SELECT product_id, trim(title) AS product_name, p AS price,
               CASE WHEN lp = 0 THEN p ELSE lp END AS list_price,
               CASE WHEN (CASE WHEN lp = 0 THEN p ELSE lp END) > 0
                         AND p <= (CASE WHEN lp = 0 THEN p ELSE lp END)
                    THEN 1.0 - p / (CASE WHEN lp = 0 THEN p ELSE lp END)
                    ELSE 0.0 END::DOUBLE AS discount_ratio,
               cast(trunc({safe_double('reviews')}) AS BIGINT) AS units_sold,
               {safe_double('rating_average')} AS rating,
               coalesce(category, {text(V.UNKNOWN_CATEGORY)}) AS category,
               'Kaggle' AS platform,
               CASE WHEN lower(trim(seller)) IN ('nan', 'none') THEN 'Kaggle'
                    ELSE trim(seller) END AS shop,
               coalesce(url, 'https://kaggle.com/product/' || slug, '') AS url
        FROM market_prices WHERE title IS NOT NULL AND trim(title) <> ''""",
}

PRODUCT_COLUMNS = (
    "product_id, product_name, round(price, 6) AS price, round(list_price, 6) AS list_price, "
    "round(discount_ratio, 6) AS discount_ratio, units_sold, round(rating, 6) AS rating, "
    "category, platform, shop, url"
)
CLEAN_COLUMNS = PRODUCT_COLUMNS + ", price_outlier"


def build(body: str, upto: str | None = None, extra: dict[str, str] | None = None,
          k: int | None = None) -> str:
    """Query with the CTEs up to one of them, then further ones."""
    chain = dict(CTES)
    if k is not None:
        chain.update(segment_ctes(k))
    used = {}
    if upto is not None:
        for name, sql in chain.items():
            used[name] = sql
            if name == upto:
                break
    used.update(extra or {})
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in used.items()) + "\n" + body


def top_counts(column: str, n: int) -> str:
    return (
        f"SELECT {column}, count(*) AS n_products FROM products GROUP BY {column} "
        f"ORDER BY n_products DESC, {column} LIMIT {n}"
    )


def two_groups(label: str = "category") -> dict[str, str]:
    return {
        "top2": top_counts(label, 2),
        "grouped": f"SELECT p.*, p.{label} AS grp FROM products p JOIN top2 USING ({label})",
    }


def average_ranks(source: str, column: str) -> str:
    """Distinct values with average rank."""
    return (
        f"SELECT {column} AS v, count(*) AS n, "
        f"sum(count(*)) OVER (ORDER BY {column}) - count(*) + (count(*) + 1) / 2.0 AS r "
        f"FROM {source} GROUP BY {column}"
    )


ERFC = (
    "(t * exp(-x*x + -1.26551223 + t*(1.00002368 + t*(0.37409196 + t*(0.09678418 "
    "+ t*(-0.18628806 + t*(0.27886807 + t*(-1.13520398 + t*(1.48851587 "
    "+ t*(-0.82215223 + t*0.17087277))))))))))"
)

MANN_WHITNEY_BODY = f"""
    SELECT a AS group_a, b AS group_b, n_a, n_b, round(u_a, 6) AS u_a, round(u_b, 6) AS u_b,
           round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS significant,
           CASE WHEN p < 0.05 THEN {text(V.SIGNIFICANT_TEXT)}
                ELSE {text(V.NOT_SIGNIFICANT_TEXT)} END AS conclusion,
           (least(n_a, n_b) <= 8 AND ties = 0) AS small_sample
    FROM (SELECT *, least(1.0, CASE WHEN z >= 0 THEN {ERFC} ELSE 2 - {ERFC} END) AS p
          FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.5 * abs(z) / sqrt(2.0)) AS t
                FROM scores))"""


def mann_whitney_ctes() -> dict[str, str]:
    return {
        "names": """SELECT first(grp ORDER BY n DESC, grp) AS a, last(grp ORDER BY n DESC, grp) AS b,
                    max(n) AS n_a, min(n) AS n_b FROM (SELECT grp, count(*) AS n FROM grouped GROUP BY grp)""",
        "ranked": average_ranks("grouped", "price"),
        "summed": """SELECT sum(r) AS ra FROM grouped g JOIN ranked ON g.price = v, names
                     WHERE grp = a""",
        "tied": "SELECT sum(n::DOUBLE * n * n - n) AS ties FROM ranked",
        "scores": """
            SELECT *, (greatest(u_a, u_b) - n_a * n_b / 2.0 - 0.5)
                      / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties
                             / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z
            FROM (SELECT *, n_a::DOUBLE * n_b - u_a AS u_b FROM
                   (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u_a FROM names, summed, tied))""",
    }


QUALITY = """
    SELECT count(*) AS n_products, 12::BIGINT AS n_columns,
           count(DISTINCT category) AS n_categories, count(DISTINCT shop) AS n_shops,
           min(price) AS price_min, max(price) AS price_max,
           round(avg(price), 6) AS price_mean, round(median(price), 6) AS price_median,
           round(stddev_samp(price), 6) AS price_std,
           min(units_sold) AS units_min, max(units_sold) AS units_max,
           round(avg(units_sold), 6) AS units_mean,
           round(median(units_sold), 6) AS units_median,
           round(avg(rating), 6) AS rating_mean, min(rating) AS rating_min,
           max(rating) AS rating_max, count(*) FILTER (price_outlier) AS n_outliers,
           round(count(*) FILTER (price_outlier) * 100.0::DOUBLE / count(*), 6) AS outlier_pct
    FROM products"""

DISTRIBUTION = """
    SELECT category, count(*) AS n_products,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM products), 6) AS pct
    FROM products GROUP BY category"""


def quality_report_sql() -> str:
    sections = [
        (1, ["n_products", "n_columns", "n_categories", "n_shops"]),
        (2, ["price_min", "price_max", "price_mean", "price_median", "price_std"]),
        (3, ["units_min", "units_max", "units_mean", "units_median"]),
        (4, ["rating_mean", "rating_min", "rating_max"]),
        (5, ["n_outliers", "outlier_pct"]),
    ]
    parts = [
        f"SELECT {s} AS section, '{m}' AS metric, {m}::DOUBLE AS value FROM q"
        for s, names in sections
        for m in names
    ]
    parts.append("SELECT 6, shop, n_products::DOUBLE FROM top_shop")
    parts.append("SELECT 7, category, n_products::DOUBLE FROM dist")
    parts.append("SELECT 7, category || ' %', pct FROM dist")
    return build(
        " UNION ALL ".join(parts),
        "products",
        {"q": QUALITY, "top_shop": top_counts("shop", 10), "dist": DISTRIBUTION},
    )


R2_CTES = {
    "pairs": """
        SELECT a.product_id, b.product_id AS alt_id, b.product_name AS alt_name,
               b.price AS alt_price, b.rating AS alt_rating, b.units_sold AS alt_units_sold,
               b.value_score AS alt_score, b.url AS alt_url,
               (1 - b.price / a.price) * 100 AS pct_cheaper,
               b.rating >= a.rating - 0.5 AS strict
        FROM final a JOIN final b ON a.category = b.category AND a.product_id <> b.product_id
             AND b.price < a.price""",
    "strict3": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
                              ORDER BY alt_score DESC, alt_id) AS place
                       FROM pairs WHERE strict) WHERE place <= 3""",
    "relaxed3": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
                              ORDER BY alt_score DESC, alt_id) AS place
                       FROM pairs) WHERE place <= 3""",
    "sizes": """
        SELECT product_id, coalesce(s.n, 0) AS ns, r.n AS nr
        FROM (SELECT product_id, count(*) AS n FROM relaxed3 GROUP BY product_id) r
        LEFT JOIN (SELECT product_id, count(*) AS n FROM strict3 GROUP BY product_id) s
             USING (product_id)""",
    "answers": """
        SELECT s.*, false AS relaxed FROM strict3 s JOIN sizes USING (product_id) WHERE ns >= nr
        UNION ALL
        SELECT r.*, true AS relaxed FROM relaxed3 r JOIN sizes USING (product_id) WHERE ns < nr""",
    "notes": f"""
        SELECT f.product_id, coalesce(n, 0) AS n_alternatives,
               CASE WHEN n IS NULL THEN 'Không tìm thấy sản phẩm nào rẻ hơn trong ngành '''
                                        || f.category || ''' trong tập dữ liệu hiện có.'
                    ELSE (CASE WHEN relaxed THEN {text(V.NOTE_RELAXED)} ELSE {text(V.NOTE_STRICT)} END)
                         || CASE WHEN n < 3 THEN ' Chỉ tìm được ' || n
                                 || '/3 lựa chọn phù hợp trong dữ liệu.' ELSE '' END
                    END AS alternatives_note
        FROM final f LEFT JOIN (SELECT product_id, count(*) AS n, bool_or(relaxed) AS relaxed
                                FROM answers GROUP BY product_id) USING (product_id)""",
}

R1 = """
    SELECT product_id,
           CASE WHEN n >= 5 THEN round(c * 100.0::DOUBLE / n, 1) END AS price_percentile,
           CASE WHEN n >= 5 THEN cast(round(c * 100.0::DOUBLE / n, 0) AS BIGINT)
                || '% trong tổng số ' || n || ' sản phẩm cùng ngành ''' || category || ''' rẻ hơn.'
                ELSE 'Ngành ''' || category || ''' chỉ có ' || n ||
                ' sản phẩm trong dữ liệu - không đủ để tính percentile đáng tin cậy.'
                END AS percentile_note
    FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY price) - 1 AS c,
                 count(*) OVER (PARTITION BY category) AS n FROM products)"""


def recommend_sql(budget: float, category: str | None, n: int) -> str:
    where = f"price <= {budget}"
    if category is not None:
        where += f" AND category = {text(category)}"
    return (
        "SELECT product_id, product_name, category, price, rating, units_sold, "
        f"value_score, segment_name, url FROM final WHERE {where} "
        f"ORDER BY value_score DESC, product_id LIMIT {n}"
    )


RECOMMENDED = (
    "product_id, product_name, category, round(price, 6) AS price, "
    "round(rating, 6) AS rating, units_sold, round(value_score, 6) AS value_score, "
    "segment_name, url"
)


def reason_sql(budget: float) -> str:
    return f"""
        '💡 Rẻ hơn ngân sách ' || cast(round((1 - price / {budget}) * 100, 0) AS BIGINT) || '%'
        || CASE WHEN rating > mr THEN ', đánh giá cao vượt trội (' || rating || ' ⭐ so với TB '
                                      || cast(round(mr, 1) AS DECIMAL(10, 1)) || ')'
                WHEN rating >= 4.0 THEN ', mức đánh giá an toàn (' || rating || ' ⭐)'
                ELSE '' END
        || CASE WHEN units_sold > mu THEN ', và thuộc top bán chạy (' || units_sold || ' lượt).'
                ELSE '.' END"""


PAGE_PREVIEWS = """
    SELECT page_id, 'https://tiki.vn/p' || page_id AS url, page_id % 5 <> 3 AS has_preview,
           CASE WHEN page_id % 5 IN (1, 2)
                THEN 'https://img.example/' || page_id || '.png' END AS image,
           CASE page_id % 5 WHEN 3 THEN NULL WHEN 1 THEN 'Title & ' || page_id
                ELSE 'Không có tiêu đề' END AS title,
           CASE page_id % 5 WHEN 3 THEN NULL WHEN 1 THEN 'About' ELSE '' END AS description
    FROM pages"""

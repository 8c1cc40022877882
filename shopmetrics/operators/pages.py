"""Link previews from stored product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.functions.references import decode_references
from shopmetrics.operators.prefix_topk import best_per_key

_ATTRIBUTES = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""
# One scan finds what an HTML parser does not read as tags, to its end or that of the
# page, and the attributes (group 1) of the meta tags between.
_SCAN = (
    r"(?is)<!--.*?(?:--!?>|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    rf"|<meta(?=[\s/])({_ATTRIBUTES})>"
)


# Name, and value between double, single or no quotes; quoted values are passed over whole.
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""


def _attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute ('' if it has none); null if the tag lacks it. The last one counts."""

    def parts(group: int) -> Column:
        return F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(group))

    def both(one: Column, other: Column) -> Column:
        return F.concat(one, other)

    values = F.zip_with(F.zip_with(parts(2), parts(3), both), parts(4), both)
    pairs = F.zip_with(
        parts(1), values, lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value"))
    )
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(-1))["value"]


def _first_meta(tags: Column, name: str) -> Column:
    """Attributes of the first meta tag with the given property; '' if none."""
    same = F.filter(tags, lambda tag: _attribute(tag, "property") == name)
    return F.coalesce(F.get(same, F.lit(0)), F.lit(""))


def _content(tag: Column) -> Column:
    """Text of the content attribute of a tag's attributes; null if there is none."""
    return decode_references(_attribute(tag, "content"))


def page_previews(pages: DataFrame) -> DataFrame:
    """Image, title and description stated by every page, keeping its columns.

    A page that cannot be read (no html, or a preview tag without content) has
    ``has_preview`` false and no values.
    """
    parts = {"image": "og:image", "title": "og:title", "description": "og:description"}
    defaults = {
        "image": F.lit(None).cast("string"),
        "title": F.lit(V.PREVIEW_DEFAULT_TITLE),
        "description": F.lit(V.PREVIEW_DEFAULT_DESCRIPTION),
    }
    found = F.regexp_extract_all("html", F.lit(_SCAN), F.lit(1))
    tagged = pages.withColumn("_tags", F.filter(found, lambda tag: tag != ""))
    tagged = tagged.withColumns(
        {f"_{part}": _first_meta(F.col("_tags"), name) for part, name in parts.items()}
    ).withColumns({f"_value_{part}": F.when(F.col(f"_{part}") != "", _content(F.col(f"_{part}"))) for part in parts})
    broken = F.col("html").isNull()
    for part in parts:
        broken = broken | ((F.col(f"_{part}") != "") & F.col(f"_value_{part}").isNull())
    values = {
        part: F.when(
            ~F.col("_broken"),
            F.when(F.col(f"_{part}") == "", defaults[part]).otherwise(F.col(f"_value_{part}")),
        )
        for part in parts
    }
    kept = [name for name in pages.columns if name != "html"]
    return tagged.withColumn("_broken", broken).select(
        *kept,
        (~F.col("_broken")).alias("has_preview"),
        *[value.alias(part) for part, value in values.items()],
    )


def attach_previews(
    recommended: DataFrame, pages: DataFrame, page_order: str | None = None
) -> DataFrame:
    """Add to every recommendation the preview of the page at its url.

    Only pages some recommendation points to are parsed; of several pages with
    one url the first by ``page_order`` (else by html) counts.
    """
    urls = recommended.select("url").distinct()
    needed = pages.join(urls, "url", "left_semi")
    order = [F.asc(page_order or "html")]
    one_per_url = best_per_key(needed, ["url"], order, 1).select("url", "html")
    previews = page_previews(one_per_url).select("url", "image", "title", "description")
    return recommended.join(previews, "url", "left").withColumn(
        "placeholder", F.when(F.col("image").isNull(), F.lit(V.PREVIEW_NO_IMAGE))
    )

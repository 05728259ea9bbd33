"""Captured result pages as listing cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill.functions.text import strip


def html_lines(html: Column) -> Column:
    """Trimmed non-empty text lines of a page, scripts and styles removed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*\shref="([^"]*)"'), 1)


def card_links(anchors: Column) -> Column:
    """Listing links by the first selector that finds any."""
    direct = F.filter(anchors, lambda a: a.contains("/maps/place/"))
    broad = F.filter(anchors, lambda a: a.contains("google.com/maps"))
    return F.when(F.size(direct) > 0, direct).otherwise(broad)


def cards_from_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One card per page: text lines, anchors and the links that name a listing."""
    return pages.select(
        key, html_lines(F.col(html)).alias("lines"), html_links(F.col(html)).alias("anchors"),
    ).withColumn("listing_links", card_links(F.col("anchors")))

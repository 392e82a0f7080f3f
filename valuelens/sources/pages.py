"""HTML page -> record extraction (S16), re-aimed at a table of raw pages.

Regular expressions over the ``html`` column (JVM-side, one row per page):
title, language, heading, first link (made absolute from the page URL), the
first number in the article text, the link count, and a labelled-field
lookup ("<label>: value" in the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _extract(c: Column, pattern: str) -> Column:
    s = F.regexp_extract(c, pattern, 1)
    return F.when(s != "", s)


def labelled(html: Column, label: str) -> Column:
    """Value following '<label>:' up to the next tag (the scraper's findFeature)."""
    return _extract(html, rf"(?i){label}\s*:\s*([^<]+)")


def first_number(text: Column) -> Column:
    """First run of digits (commas allowed inside), as DOUBLE."""
    s = F.regexp_extract(text, r"(\d[\d,]*)", 1)
    return F.when(s != "", F.regexp_replace(s, ",", "").cast("double"))


def digits_only(text: Column) -> Column:
    """Strip every non-digit; NULL when nothing is left."""
    s = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(s != "", s)


def page_records(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    h = F.col(html)
    article = F.regexp_extract(h, r"(?s)<article>(.*?)</article>", 1)
    href = _extract(h, r'<a href="([^"]*)"')
    origin = F.regexp_extract(F.col(url), r"^(https?://[^/?#]+)", 1)
    absolute = F.when(href.startswith("/"), F.concat(origin, href)).otherwise(href)
    return pages.select(
        "page_id",
        _extract(h, r"(?s)<title>(.*?)</title>").alias("title"),
        _extract(h, r'<html[^>]*lang="([^"]*)"').alias("lang"),
        _extract(h, r"(?s)<h1>(.*?)</h1>").alias("h1"),
        href.alias("first_href"),
        absolute.alias("first_link"),
        first_number(article).alias("first_number"),
        F.size(F.regexp_extract_all(h, F.lit("<a href"), 0)).alias("n_links"),
    )


def address_parts(address: Column) -> dict[str, Column]:
    """street, district, city of "street, district, city"; NULL where a part is missing or blank."""
    parts = F.split(address, ",")
    return {name: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i, name in enumerate(("street", "district", "city"))}


def tax_year(taxes: Column) -> Column:
    """The year in brackets of "$4,100 (2024)"."""
    return _extract(taxes, r"\((\d{4})\)").cast("int")


def listing_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, street, district, city, floor area (digits), property taxes and tax year of listing pages.

    The address is the text of the heading marked ``itemprop="address"``; other fields follow their label.
    """
    h = F.col(html)
    address = _extract(h, r"""(?s)<h2[^>]*itemprop=["']address["'][^>]*>(.*?)</h2>""")
    taxes = F.trim(labelled(h, "Property Taxes"))
    return pages.select(
        "page_id", *[c.alias(n) for n, c in address_parts(address).items()],
        digits_only(labelled(h, "Floor Area")).cast("double").alias("floor_area_sqft"), taxes.alias("property_taxes"), tax_year(taxes).alias("tax_year"),
    )

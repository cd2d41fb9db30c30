"""Links of pages' html, in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _markup() -> Column:
    """A page's html without comments and scripts, which hold no elements."""
    return F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "")


def _value(tag: Column, name: str) -> Column:
    """An attribute's value within a tag, in any quotes or none, trimmed; empty if there is none."""
    form = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, form, k) for k in (1, 2, 3)]))


def links(pages: DataFrame, attribute: str = "href") -> DataFrame:
    """(page_id, place, link) for each element that has the attribute, in any quotes or none."""
    form = rf"""(?is)<[a-z][^>]*?\s{attribute}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(_markup(), F.lit(form), F.lit(0))).alias("place", "tag"))
    return found.select("page_id", "place", _value(F.col("tag"), attribute).alias("link"))


def images(pages: DataFrame) -> DataFrame:
    """(page_id, place, link) of each img element: its data-src, else its src, in any quotes or none;
    links without http or https go, places are those among all img elements.  Nothing is deduplicated."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(_markup(), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))).alias("place", "tag"))
    link = F.coalesce(*(F.nullif(_value(F.col("tag"), n), F.lit("")) for n in ("data-src", "src")))
    return found.select("page_id", "place", link.alias("link")).where(F.col("link").rlike("(?i)^https?://"))


def page_images(elements: DataFrame, attributes: tuple[str, ...] = ("src", "data_src"), least: int = 400) -> DataFrame:
    """(page_id, number, link) of a rendered page's img elements (page_id, place, width, attributes): the first attribute
    that isn't empty, if it begins with http.  Elements known to be narrower than `least` go; each
    link counts once, where it stands first; numbers go from 0 without gaps."""
    link = F.coalesce(*(F.nullif(F.col(a), F.lit("")) for a in attributes))
    wide = elements.where(F.coalesce(F.col("width") >= least, F.lit(True))).select("page_id", "place", link.alias("link")).where(F.col("link").startswith("http"))
    first = wide.groupBy("page_id", "link").agg(F.min("place").alias("place"))
    return first.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1).alias("number"), "link")


def fetched_images(elements: DataFrame, open_link: Column, least: int = 300) -> DataFrame:
    """(page_id, number, link) of what a worker fetches: names of lazy images first, and links for which open_link (of `link`) doesn't hold
    left out after they were numbered, so that numbers have gaps there."""
    return page_images(elements, ("data_src", "data_original", "data_lazy", "src"), least).where(open_link)


def first_of_each(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """Ordered dedupe: the first row of each value within a key."""
    r = F.row_number().over(Window.partitionBy(key, value).orderBy(place))
    return rows.withColumn("r", r).where("r = 1").drop("r")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or fallback if primary has no rows."""
    some = primary.limit(1).select(F.lit(True).alias("some"))
    return primary.unionByName(fallback.join(some, F.lit(True), "left_anti"))

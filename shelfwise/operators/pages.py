"""Jobs over raw pages: records, codes, links, text, census and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import html as H
from shelfwise.functions import urls as U
from shelfwise.functions.text import cut_at_word
from shelfwise.plans.skew import RANK_WIDTH, compute_once, running_rank


def page_records(pages: DataFrame, sites: str, max_len: int = 700, html: str = "html", url: str = "url") -> DataFrame:
    """One product record per page: JSON-LD first, meta tags as fallback."""
    body = F.col(html)
    sku_list = H.sku_candidates(body)
    read = H.with_jsonld(pages, html, "_ld")
    name = F.coalesce(F.col("_ld.name"), H.decode_entities(H.meta(body, *H.META_TITLE)))
    text = F.coalesce(F.col("_ld.description"), H.decode_entities(H.meta(body, *H.META_DESCRIPTION)), F.lit(""))
    image = F.coalesce(F.col("_ld.image"), H.decode_entities(H.meta(body, *H.META_IMAGE)))
    # one projection per step: what a later step reads more than once is computed once
    read = read.select(
        *[c for c in pages.columns if c != html],
        "_ld",
        H.strip_site_suffix(name, sites).alias("_name"),
        H.to_line(text).alias("_text"),
        image.alias("image"),
        sku_list.alias("all_skus"),
    )
    return read.select(
        *[c for c in pages.columns if c != html],
        U.section(F.col(url)).alias("section"),
        F.coalesce("_name", F.lit("")).alias("name"),
        cut_at_word(F.col("_text"), max_len).alias("description"),
        "image",
        F.coalesce(F.col("_ld.sku"), F.get("all_skus", F.lit(0))).alias("sku"),
        F.col("_ld.gtin").alias("gtin"),
        "all_skus",
    )


def coverage(records: DataFrame, section: str = "section") -> DataFrame:
    """Rows with a name, description, image and code per section."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return records.groupBy(section).agg(
        F.count(F.lit(1)).alias("n"),
        has("name").alias("with_name"),
        has("description").alias("with_description"),
        has("image").alias("with_image"),
        has("sku").alias("with_sku"),
    )


def page_links(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """Distinct same-host links per page; made distinct inside the row, no shuffle.
    Links that carry a fragment are jumps inside a page and are not taken."""
    found = F.transform(H.hrefs(F.col(html)), lambda h: U.resolve(H.decode_entities(h), F.col(url)))
    links = F.array_distinct(F.filter(found, lambda u: u.isNotNull()))
    rows = compute_once(pages, _links=links).select(key, U.host(F.col(url)).alias("host"), F.explode("_links").alias("link"))
    return rows.where(U.host(F.col("link")) == F.col("host")).select(
        key, "host", "link", U.is_paged(F.col("link")).alias("is_paged"), U.product_url_verdict(F.col("link")).alias("verdict")
    )


def url_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", U.host(F.col(url))).withColumn("section", U.section(F.col(url))).withColumn(
        "code", U.trailing_code(F.col(url))
    )


def product_urls(pages: DataFrame, opts: U.ProductUrlOptions = U.ProductUrlOptions(), url: str = "url") -> DataFrame:
    return pages.withColumn("verdict", U.product_url_verdict(F.col(url), opts))


def url_census(pages: DataFrame, opts: U.ProductUrlOptions = U.ProductUrlOptions(), url: str = "url") -> DataFrame:
    return (
        product_urls(pages, opts, url)
        .groupBy(U.host(F.col(url)).alias("host"), "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def host_in(df: DataFrame, hosts: Sequence[str] | DataFrame, url: str = "url") -> DataFrame:
    """Strict allow-list: the whole host must be listed, ``www.`` aside. Hosts are a
    short list of the caller, or a table (host) of any length."""
    if isinstance(hosts, DataFrame):
        listed = hosts.select(F.col("host").alias("_host")).distinct()
        return df.join(listed, U.host(F.col(url)) == F.col("_host"), "left_semi")
    return df.where(U.host(F.col(url)).isin(*hosts))


def page_audit(pages: DataFrame, html: str = "html") -> DataFrame:
    body = F.col(html)
    counts = {"n_h2": "<h2", "n_paragraphs": "<p[ >]", "n_links": "<a "}
    out = pages.withColumn("title", F.coalesce(H.page_title(body), F.lit("<no title>"))).withColumn("size", F.length(body))
    for name, pattern in counts.items():
        out = out.withColumn(name, F.regexp_count(body, F.lit(pattern)))
    for name, flag in H.page_flags(body).items():
        out = out.withColumn(name, flag)
    return out.drop(html)


def rank_urls(df: DataFrame, preferred: Column, key: str, order: str, width: int = RANK_WIDTH) -> DataFrame:
    """URLs of a key: preferred domain first, then the order they were found in."""
    return running_rank(df.withColumn("_second", ~preferred), [key, "_second"], order, [key], width).drop("_second")

"""Pages that can be reached from a shop's listing pages, with their depth and section.

A walk goes in rounds over one staged table of links. A round takes the pages that the
round before found for the first time, follows their links, keeps one row per target with
the first of the sections it was reached from, and leaves out what is known. Targets are
made one by a combining aggregate before any shuffle, so a hub that every page links to
costs each task one row. There is no limit of rounds or pages: a walk ends when a round
finds nothing new.

The result of each round is a folder of its own (its number is the depth) below one path,
so a lost executor costs a re-read, and known pages are read as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.pages import page_links
from shelfwise.plans.skew import is_small, keyed_lookup, stage
from shelfwise.session import run_dir


def bare(url: Column) -> Column:
    """A URL without its fragment, which names a place inside the page."""
    return F.regexp_replace(url, "#.*$", "")


def walk(links: DataFrame, seeds: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """url, section, depth of everything that ``links`` (source, target) lead to from
    ``seeds`` (url, section), which have depth 0. ``only`` (url): targets that count.

    Of several sections the first in order is taken, among those that reach a page at its
    smallest depth. NULL urls lead nowhere.
    """
    spark = seeds.sparkSession
    folder = run_dir(spark, "walk")
    schema = "url string, section string, depth int"
    edges = stage(links.select("source", F.col("target").alias("url")).where("source is not null and url is not null and source != url").distinct(), "edges")
    found = seeds.where("url is not null")
    depth = 0
    while True:
        found = found.groupBy("url").agg(F.min("section").alias("section"))
        if only is not None:
            found = found.join(only.select("url"), "url", "left_semi")
        if depth:
            found = found.join(spark.read.schema(schema).parquet(folder).select("url"), "url", "left_anti")
        found.write.parquet(f"{folder}/depth={depth}")
        front = spark.read.schema(schema).parquet(folder).where(F.col("depth") == depth)
        if not front.limit(1).count():
            return spark.read.schema(schema).parquet(folder)
        sources = front.select(F.col("url").alias("source"), "section")
        sources = F.broadcast(sources) if is_small(sources) else sources
        found = edges.join(sources, "source").select("url", "section")
        depth += 1


def page_reach(pages: DataFrame, seeds: DataFrame, key: str, html: str = "html", url: str = "url", follow: Column | None = None) -> DataFrame:
    """Each row of ``pages`` (key, url, html) with the section and depth at which it is
    reached over links of its own host; both are NULL for a page that is not reached.

    ``seeds``: url, section. ``follow``: a condition on the columns of ``page_links``
    (link, is_paged, verdict) for links that are gone along, such as ``is_paged`` for the
    pages of a listing. Pages of one url are one place. Only given pages are passed
    through, as nothing is known of the links of others.
    """
    found = page_links(pages.select(F.col(url).alias("_url"), F.col(html).alias("_html")), "_url", "_html", "_url")
    found = found if follow is None else found.where(follow)
    links = found.select(bare(F.col("_url")).alias("source"), bare(F.col("link")).alias("target"))
    known = pages.select(bare(F.col(url)).alias("url")).where("url is not null").distinct()
    reached = walk(links, seeds.select(bare(F.col("url")).alias("url"), "section"), stage(known, "known"))
    rows = pages.select(key, F.col(url).alias("url"), bare(F.col(url)).alias("_bare"))
    lookup = reached.select(F.col("url").alias("_bare"), "section", "depth")
    return keyed_lookup(rows, lookup, "_bare", key).select(key, "url", "section", "depth")


def listed_products(pages: DataFrame, seeds: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """url, section, depth of each product link found on the pages of a listing: those that
    paged links lead to from ``seeds``. The first section at the smallest depth counts;
    products need not be among ``pages``."""
    found = stage(
        page_links(pages.select(F.col(url).alias("_url"), F.col(html).alias("_html")), "_url", "_html", "_url").select(
            bare(F.col("_url")).alias("source"), bare(F.col("link")).alias("target"), "is_paged", F.col("verdict").isin("accepted", "long-slug").alias("product")
        ),
        "links",
    )
    listings = walk(found.where("is_paged"), seeds.select(bare(F.col("url")).alias("url"), "section"))
    pairs = found.where("product").select("source", F.col("target").alias("url")).distinct()
    met = pairs.join(listings.select(F.col("url").alias("source"), "section", "depth"), "source")
    first = met.groupBy("url").agg(F.min(F.struct("depth", "section")).alias("first"))
    return first.select("url", F.col("first.section").alias("section"), F.col("first.depth").alias("depth"))

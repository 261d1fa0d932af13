"""URL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; NULL for anything that is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(url), r"^https?://[^/]+", "")
    return F.regexp_replace(bare, r"[?#].*$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))


def section(url: Column, default: str = "diafora") -> Column:
    """First path segment."""
    return F.coalesce(F.get(segments(url), F.lit(0)), F.lit(default))


def trailing_code(url: Column) -> Column:
    """The 8-14 digits that end a page name, as text."""
    code = F.regexp_extract(url, r"-(\d{8,14})\.html(?:[?#]|$)", 1)
    return F.nullif(code, F.lit(""))


def is_paged(url: Column) -> Column:
    return F.lower(url).rlike(r"[?&](?:p|page)=\d+")


# Path words that rule a page out or in.
REJECTED = (
    "category categories search account cart checkout help contact about stores brands home "
    "store-locator customer-service find-a-store register login press privacy cookie terms legal "
    "wp-content wp-json feed blog"
).split()
ACCEPTED = (
    "proionta products product peripoiisi peripoihsh skin-care sun-care προϊοντα"
).split()


@dataclass(frozen=True)
class ProductUrlOptions:
    """Rule lists and the long-slug heuristic, all adjustable."""

    rejected: tuple[str, ...] = tuple(REJECTED)
    accepted: tuple[str, ...] = tuple(ACCEPTED)
    min_slug: int = 15
    min_depth: int = 1


def product_url_verdict(url: Column, opts: ProductUrlOptions = ProductUrlOptions()) -> Column:
    """Why a URL is (not) a product page: the first rule that applies."""
    low = F.lower(url)
    last = last_segment(url)
    return (
        F.when(low.rlike(r"sitemap|robots|\.xml(?:\?|$)"), F.lit("machine"))
        .when(low.rlike(rf"/(?:{'|'.join(opts.rejected)})(?:/|$)"), F.lit("rejected"))
        .when(low.rlike(rf"/(?:{'|'.join(opts.accepted)})/"), F.lit("accepted"))
        .when(F.size(segments(url)) < opts.min_depth, F.lit("shallow"))
        .when((F.length(last) > opts.min_slug) & last.contains("-"), F.lit("long-slug"))
        .otherwise(F.lit("other"))
    )


def is_product_url(url: Column, opts: ProductUrlOptions = ProductUrlOptions()) -> Column:
    return product_url_verdict(url, opts).isin("accepted", "long-slug")


def _without_dots(url: Column) -> Column:
    """Takes ``.`` and ``..`` out of an absolute URL's path; ``..`` stops at the root."""
    origin, rest = (F.regexp_extract(url, r"^(https?://[^/?#]+)([^?#]*)(.*)$", g) for g in (1, 2))
    query = F.regexp_extract(url, r"^(https?://[^/?#]+)([^?#]*)(.*)$", 3)
    parts = F.slice(F.split(F.regexp_replace(rest, r"(/\.{1,2})$", "$1/"), "/"), 2, 1_000_000)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(rest.rlike(r"/\.{1,2}(?:/|$)"), F.concat(origin, F.lit("/"), F.array_join(kept, "/"), query)).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``, without its fragment: a mere
    query keeps the page's path, and ``.`` and ``..`` are worked out."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    scheme = F.regexp_extract(base, r"^(https?):", 1)
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.rlike("^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, href))
    )
    return _without_dots(F.regexp_replace(full, "#.*$", ""))

"""Expressions over raw HTML pages: meta tags, JSON-LD, codes, links, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null, regex, squash
from shelfwise.plans.skew import compute_once

# Named entities; the ampersand is decoded last.
ENTITIES = (
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#34;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
)
TAG = r"<[^>]+>"


def _numeric_entities(col: Column) -> Column:
    """``&#8211;`` and ``&#x2013;`` to characters, without leaving the JVM."""
    runs = F.regexp_extract_all(col, F.lit(r"(&#\d+;|&#[xX][0-9a-fA-F]+;|&|[^&]+)"), F.lit(1))

    def piece(run: Column) -> Column:
        dec = F.regexp_extract(run, r"^&#0*(\d{1,7});$", 1).try_cast("int")
        hexa = F.conv(F.nullif(F.regexp_extract(run, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10).try_cast("int")
        code = F.coalesce(dec, hexa)
        # beyond U+10FFFF, and halves of surrogate pairs, there is no character
        real = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), run)

    return F.when(col.contains("&#"), F.array_join(F.transform(runs, piece), "")).otherwise(col)


def decode_entities(col: Column) -> Column:
    named = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, col)
    return F.replace(_numeric_entities(named), F.lit("&amp;"), F.lit("&"))


def _first(html: Column, pattern: str, groups: int = 1) -> Column:
    """First non-empty capture group of the first match, or NULL."""
    return F.coalesce(
        *[blank_to_null(F.regexp_extract(html, regex(pattern), g)) for g in range(1, groups + 1)]
    )


def meta(html: Column, *names: str) -> Column:
    """Content of the first meta tag present, by property and then by name.

    The value ends at the quote it began with, so it may hold the other one.
    """
    found = [
        blank_to_null(
            F.regexp_extract(
                html, regex(rf"<meta[^>]+{attr}=[\"']{name}[\"'][^>]+content=(\"[^\"]+\"|'[^']+')"), 1
            )
        )
        for name in names
        for attr in ("property", "name")
    ]
    return F.regexp_replace(F.coalesce(*found), "^.|.$", "")


# Tags that hold a page's title, description and picture.
META_TITLE = ("og:title", "twitter:title")
META_DESCRIPTION = ("og:description", "description", "twitter:description")
META_IMAGE = ("og:image", "twitter:image")


def page_title(html: Column) -> Column:
    return _first(html, r"<title>([^<]*)</title>")


def strip_site_suffix(title: Column, sites: str) -> Column:
    """Drop `` | Site`` / `` - Site`` at the end of a title; ``sites`` is a pattern."""
    bare = F.regexp_replace(squash(title), regex(rf"\s*[|–—-]\s*(?:{sites})\s*\.?$"), "")
    return blank_to_null(F.trim(bare))


JSONLD_BLOCK = r"(?s)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_FIELDS = "name string, description string, image string, sku string, mpn string, gtin13 string, gtin12 string, gtin string"
_LEAF = f"struct<`@type`: string, {_FIELDS.replace(' string', ': string')}>"
PRODUCT_TYPE = r'^(?:Product$|\[.*"Product")'
#: A node whose graph is still text, so graphs may be nested to any depth.
_NODES = f"array<{_LEAF[:-1]}, `@graph`: string>>"


def jsonld_nodes(html: Column) -> Column:
    """All JSON-LD nodes: block by block, in each the top level, then its graphs, then the
    graphs within these, however deep. Broken blocks and graphs are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(regex(JSONLD_BLOCK)), F.lit(1))

    def read(text: Column) -> Column:
        return F.coalesce(F.from_json(F.trim(text), _NODES), F.array().cast(_NODES))

    def deeper(found: Column, _: Column) -> Column:
        # parsed nodes are an array of one, so that they are named and read once
        level = F.array(F.flatten(F.transform(found["graphs"], read)))
        step = lambda nodes: F.struct(
            F.concat(found["nodes"], F.transform(nodes, lambda n: n.dropFields("`@graph`"))).alias("nodes"),
            F.array_compact(F.transform(nodes, lambda n: n["@graph"])).alias("graphs"),
        )
        return F.get(F.transform(level, step), F.lit(0))

    def of_block(block: Column) -> Column:
        # no graph is deeper than the word occurs
        depth = F.sequence(F.lit(0), F.size(F.split(block, '"@graph"')) - 1)
        start = F.struct(F.array().cast(f"array<{_LEAF}>").alias("nodes"), F.array(block).alias("graphs"))
        return F.aggregate(depth, start, deeper, lambda found: found["nodes"])

    return F.flatten(F.transform(blocks, of_block))


def with_jsonld(df: DataFrame, html: str, out: str = "ld") -> DataFrame:
    """Adds the struct of the first JSON-LD Product.

    Nested values are read as raw JSON text, so a field may be a string, an array
    or an object. Every step is a projection of its own, so a page is parsed once
    although many fields are read from it.
    """
    is_product = lambda n: n["@type"].rlike(PRODUCT_TYPE)
    product = F.get(F.filter("_nodes", is_product), F.lit(0))
    image = F.col("_product.image")
    first_image = F.when(image.startswith("["), F.get_json_object(image, "$[0]")).otherwise(image)
    url = F.when(F.col("_image").startswith("{"), F.get_json_object("_image", "$.url")).otherwise(F.col("_image"))
    fields = F.struct(
        blank_to_null(F.col("_product.name")).alias("name"),
        blank_to_null(F.col("_product.description")).alias("description"),
        blank_to_null(url).alias("image"),
        F.coalesce(*[blank_to_null(F.col(f"_product.{c}")) for c in ("sku", "mpn")]).alias("sku"),
        F.coalesce(*[blank_to_null(F.col(f"_product.{c}")) for c in ("gtin13", "gtin12", "gtin")]).alias("gtin"),
    )
    parsed = compute_once(df, _nodes=jsonld_nodes(F.col(html)))
    return (
        compute_once(parsed, _product=product)
        .withColumn("_image", first_image)
        .withColumn(out, F.when(F.col("_product").isNotNull(), fields))
        .drop("_nodes", "_product", "_image")
    )


# Places where a page shows its product code, length limits.
SKU_PATTERNS = (
    r'"sku"\s*:\s*"([^"]+)"',
    r"class=[\"']sku[\"']\s*>\s*([^<\s]+)",
    r"(?:Κωδικ[όο]ς|SKU|Product\s+code)\s*[:：]\s*<[^>]*>\s*([A-Za-z0-9\-./]+)",
    r"(?:Κωδικ[όο]ς|SKU|Product\s+code)\s*[:：]\s*([A-Za-z0-9\-./]{4,})",
)
SKU_LENGTH = (3, 40)


def sku_candidates(html: Column) -> Column:
    found = [F.regexp_extract_all(html, F.lit(regex(p)), F.lit(1)) for p in SKU_PATTERNS]
    return F.array_distinct(
        F.filter(F.concat(*found), lambda s: F.length(s).between(*SKU_LENGTH))
    )


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(regex(r"<a[^>]+href=[\"']([^\"'#]+)[\"']")), F.lit(1))


def to_text(html: Column) -> Column:
    """Readable text; ends of paragraphs and blocks stay as line breaks."""
    out = html
    for pattern, new in (
        (r"(?s)<script.*?</script>", ""),
        (r"(?s)<style.*?</style>", ""),
        (r"<br\s*/?>", "\n"),
        (r"</p>", "\n\n"),
        (r"</(?:div|li|h[1-6]|tr|blockquote)>", "\n"),
        (TAG, ""),
    ):
        out = F.regexp_replace(out, regex(pattern), new)
    out = decode_entities(out)
    for pattern, new in ((r"\r", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def to_line(html: Column) -> Column:
    return squash(F.regexp_replace(html, TAG, " "))


# Containers that may hold the long description, in order.
BLOCK_PATTERNS = (
    r"(?s)<div[^>]+class=[\"']product-text[\"'][^>]*>\s*<div[^>]+class=[\"']text[\"'][^>]*>(.*?)</div>\s*</div>",
    r"(?s)<div[^>]+class=[\"']product-text[\"'][^>]*>(.*?)</div>\s*</div>",
    r"(?s)<div[^>]+class=[\"']strong-desc[\"'][^>]*>(.*?)</div>",
    r"(?s)<div[^>]+class=[\"'][^\"']*woocommerce-Tabs-panel--description[^\"']*[\"'][^>]*>(.*?)</div>\s*</div>",
    r"(?s)<div[^>]+id=[\"']tab-description[\"'][^>]*>(.*?)</div>\s*(?=<div|<footer|<section)",
    r"(?s)<div[^>]+class=[\"'][^\"']*woocommerce-product-details__short-description[^\"']*[\"'][^>]*>(.*?)</div>",
    r"(?s)<div[^>]+itemprop=[\"']description[\"'][^>]*>(.*?)</div>\s*(?=<div|<footer|<section)",
    r"(?s)<div[^>]+class=[\"'][^\"']*(?:elementor-widget-woocommerce-product-content|elementor-widget-text-editor)[^\"']*[\"'][^>]*>(.*?)</div>\s*</div>",
    r"(?s)<div[^>]+class=[\"'][^\"']*entry-content[^\"']*[\"'][^>]*>(.*?)</(?:div|article)>\s*</article>",
    r"(?s)<(?:div|section)[^>]+class=[\"'][^\"']*product-description[^\"']*[\"'][^>]*>(.*?)</(?:div|section)>",
    r"(?s)<h[1-6][^>]*>\s*(?:Περιγραφή|ΠΕΡΙΓΡΑΦΗ|Description)\s*</h[1-6]>(.*?)(?=<h[1-6]|</section|</article|<footer)",
)
# Places of a subtitle, in order, and its limits.
SUBTITLE_PATTERNS = (
    r"(?s)<h4[^>]+class=[\"'][^\"']*sub-title[^\"']*[\"'][^>]*>(.*?)</h4>",
    r"(?s)<div[^>]+class=[\"'][^\"']*woocommerce-product-details__short-description[^\"']*[\"'][^>]*>(.*?)</div>",
    r"(?s)<div[^>]+class=[\"'][^\"']*entry-summary[^\"']*[\"'][^>]*>.*?<(?:h2|h3|h4|p|strong|b)[^>]*>(.*?)</(?:h2|h3|h4|p|strong|b)>",
    r"(?s)<(?:div|h2|h3|p)[^>]+class=[\"'][^\"']*(?:product[- ]?subtitle|tagline|subtitle|product[- ]?tagline|product[- ]?intro)[^\"']*[\"'][^>]*>(.*?)</(?:div|h2|h3|p)>",
    r"(?s)<h1[^>]*>.*?</h1>\s*<h2[^>]*>(.*?)</h2>",
    r"(?s)<h1[^>]*>.*?</h1>.*?<(?:p|div)[^>]*>\s*<strong[^>]*>(.*?)</strong>\s*</(?:p|div)>",
    r"(?s)<h2[^>]+class=[\"'][^\"']*elementor-heading-title[^\"']*[\"'][^>]*>(.*?)</h2>",
)
MIN_BLOCK = 120
SUBTITLE_LENGTH = (15, 250)
SUBTITLE_SENTENCES = 3


def with_longest_block(df: DataFrame, html: str, out: str = "block", patterns=BLOCK_PATTERNS, min_len: int = MIN_BLOCK) -> DataFrame:
    """Adds the longest container text of at least ``min_len``; the earlier one
    on a tie, NULL if there is none."""
    texts = F.array(*[to_text(F.regexp_extract(F.col(html), regex(p), 1)) for p in patterns])
    sized = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("rank"), t.alias("text")))
    best = F.array_max("_sized")
    return df.withColumn("_sized", sized).withColumn(out, F.when(best["n"] >= min_len, best["text"])).drop("_sized")


def with_best_description(df: DataFrame, html: str, out: str = "description", min_len: int = MIN_BLOCK) -> DataFrame:
    """Adds the longest container text or, if that is not longer, the description of
    the first JSON-LD Product whose text is long enough; NULL if there is neither."""
    products = F.filter("_nodes", lambda n: n["@type"].rlike(PRODUCT_TYPE) & n["description"].isNotNull())
    texts = F.filter(F.transform(products, lambda n: to_text(n["description"])), lambda t: F.length(t) >= min_len)
    found = with_longest_block(compute_once(df, _nodes=jsonld_nodes(F.col(html))), html, "_block", min_len=min_len)
    found = compute_once(found, _told=F.get(texts, F.lit(0)))
    longer = F.length("_block") > F.coalesce(F.length("_told"), F.lit(0))
    return found.withColumn(out, F.when(longer, F.col("_block")).otherwise(F.col("_told"))).drop("_nodes", "_block", "_told")


def subtitle(html: Column, patterns=SUBTITLE_PATTERNS) -> Column:
    """First subtitle that is neither too short, too long nor too many sentences."""
    texts = F.array(
        *[squash(decode_entities(F.regexp_replace(F.regexp_extract(html, regex(p), 1), TAG, ""))) for p in patterns]
    )
    fits = F.filter(
        texts,
        lambda t: F.length(t).between(*SUBTITLE_LENGTH) & (F.size(F.split(t, r"[.!?]\s+")) <= SUBTITLE_SENTENCES),
    )
    return F.get(fits, F.lit(0))


# Marks of challenge walls, consent layers and region pickers.
CHALLENGE = r"cf-browser-verification|cf_chl_opt|checking your browser before accessing|are you a robot"
NAMED_WALL = r"attention required|just a moment"
CAPTCHA = r"\brecaptcha\b|\bg-recaptcha\b"
DENIED_TITLE = r"\b(?:access denied|blocked|forbidden|403)\b"
CONSENT = r"cookie|consent|gdpr|onetrust|cookiebot"
REGION = r"select.{0,20}(?:region|country|location|language)"
SHORT_PAGE, CONSENT_PAGE, REGION_PAGE = 5000, 80000, 50000


def is_blocked(html: Column) -> Column:
    low, title = F.lower(html), F.lower(page_title(html))
    return (
        low.rlike(CHALLENGE)
        | (low.rlike(NAMED_WALL) & low.contains("cloudflare"))
        | ((F.length(html) < SHORT_PAGE) & low.rlike(regex(CAPTCHA)))
        | F.coalesce(title.rlike(regex(DENIED_TITLE)), F.lit(False))
    )


def page_flags(html: Column) -> dict[str, Column]:
    return {
        "blocked": is_blocked(html),
        "consent": (F.length(html) < CONSENT_PAGE) & html.rlike(regex(CONSENT)),
        "region": (F.length(html) < REGION_PAGE) & html.rlike(regex(REGION)),
        "captcha": html.rlike(r"g-recaptcha|recaptcha/api\.js"),
    }

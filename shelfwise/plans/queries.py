"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import html as H
from shelfwise.functions import text as X
from shelfwise.functions import urls as U
from shelfwise.functions.attributes import attributes, describe
from shelfwise.functions.quality import reasons
from shelfwise.operators import display as D
from shelfwise.operators import layers as L
from shelfwise.operators import match as M
from shelfwise.operators import pages as P
from shelfwise.operators import quality as Q
from shelfwise.operators import reach as W
from shelfwise.operators import rules as R
from shelfwise.operators import search as G
from shelfwise.operators import serve as S
from shelfwise.operators.templates import describe_by_templates
from shelfwise.plans.fixtures import FILLER, TEMPLATE_COLUMNS, read, table, template_rows, with_variants
from shelfwise.plans.skew import compute_once
from shelfwise.session import run_dir
from shelfwise.sources import io
from shelfwise.streaming.ingest import ingest, page_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIELDS = ["name", "description", "image", "section"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ------------------------------------------------------


@query
def scan_catalog(spark, sf):
    schema = T.StructType(
        [
            T.StructField("p_partkey", T.LongType()),
            T.StructField("p_name", T.StringType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("p_retailprice", T.DoubleType()),
        ]
    )
    return io.read_catalog(spark, f"{sf}/part.parquet", schema).select(
        F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )


@query
def map_to_rows(spark, sf):
    objects = read(spark, sf, "events").selectExpr(
        "event_id", """replace(props, '{', '{"_comment": "by hand", ') as props"""
    )
    return io.explode_map(objects, "props", "code", "value")


@query
def export_delimited(spark, sf):
    df = table(spark, sf, "products").withColumn(
        "name", F.when(F.col("ordinal") % 7 == 0, F.concat("name", F.lit(' "new";  x'))).otherwise(F.col("name"))
    )
    return io.export_rows(df, ["name", "price", "barcode", "line"], keep=["ordinal"])


def _verdicts(spark, sf):
    return Q.with_verdict(table(spark, sf, "texts", heavy=True), "body", FILLER)


@query
def quality_report_json(spark, sf):
    verdicts = _verdicts(spark, sf)
    return io.report_rows(Q.totals(verdicts, "body"), Q.audit(verdicts, "body").select("doc_id", "reasons", "length"))


# --- projections, filters ---------------------------------------------------


def _brand_dim(spark, sf):
    used = read(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    unused = spark.createDataFrame([("Brand#99",)], "brand string")
    return used.unionByName(unused).withColumn("brand_label", F.concat(F.lit("The "), F.col("brand")))


def _line_dim(spark, sf):
    """All lines but the first one, so that a default label is needed."""
    lines = read(spark, sf, "part").select(F.col("p_type").alias("line")).distinct()
    return lines.where("line != 'ECONOMY'").withColumn("line_label", F.initcap("line"))


def _layers(spark, sf):
    return [table(spark, sf, "override_layer"), table(spark, sf, "supplemental_layer")]


@query
def display_table(spark, sf):
    products = with_variants(table(spark, sf, "products")).withColumn("name", F.upper("name"))
    dims = {"brand": _brand_dim(spark, sf), "line": _line_dim(spark, sf)}
    fallback = F.concat(F.lit("Product of "), F.col("brand_label"), F.lit(" — "), F.col("name"))
    return D.display_table(products, _layers(spark, sf), dims, "Shelf", fallback)


@query
def search_blob(spark, sf):
    return S.search(table(spark, sf, "products"), ["name", "brand", "line", "barcode"], " RED ").select("ordinal", "name")


@query
def search_review(spark, sf):
    df = L.cascade_fields(table(spark, sf, "products"), _layers(spark, sf), FIELDS)
    poor = F.size(reasons(F.col("layer_description"), FILLER)) > 0
    return S.search(df, ["name", "layer_name", "barcode"], "official", poor).select("ordinal", "layer_name")


@query
def facet_filter(spark, sf):
    return S.facet_filter(table(spark, sf, "products"), "brand", "Brand#11").select("ordinal", "brand", "name")


@query
def validate_rows(spark, sf):
    known = ("brand", [f"Brand#{i}" for i in range(1, 26)])
    checked = R.validate(table(spark, sf, "supplier_sheet"), ["code", "name", "price"], "price", known, "vat")
    return checked.select(
        "ordinal",
        F.coalesce("problem", F.lit("accepted")).alias("status"),
        F.coalesce(F.col("price_value").cast("double"), F.lit(0.0)).alias("price"),
        F.col("vat_value").alias("vat"),
    )


@query
def exclusion_rules(spark, sf):
    return R.exclude(table(spark, sf, "offers"), "name").select(
        "ordinal", "name", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("reason", F.lit("")).alias("reason")
    )


@query
def exclusion_breakdown(spark, sf):
    return R.breakdown(R.exclude(table(spark, sf, "offers"), "name"))


@query
def rule_classify(spark, sf):
    return R.classify(table(spark, sf, "supplements"), "name")


URL_OPTIONS = U.ProductUrlOptions(rejected=(*U.REJECTED, "blog"), accepted=("en", "fr"), min_slug=3, min_depth=2)


@query
def product_url_census(spark, sf):
    return P.url_census(read(spark, sf, "pages", heavy=True), URL_OPTIONS)


@query
def host_allowlist(spark, sf):
    hosts = ["ththin.example.com", "therin.example.net", "cheap-pills.example.com", "spam-farm.example.org"]
    return P.host_in(read(spark, sf, "pages", heavy=True), hosts).select("page_id", U.host(F.col("url")).alias("host"))


@query
def page_audit(spark, sf):
    return P.page_audit(read(spark, sf, "pages", heavy=True)).drop("url")


@query
def variant_conflict(spark, sf):
    return M.drop_conflicts(table(spark, sf, "url_pairs", heavy=True), "name", "url")


# --- joins ------------------------------------------------------------------


@query
def dim_lookup(spark, sf):
    df = L.with_dim(table(spark, sf, "products"), _line_dim(spark, sf), "line", "line_label", F.col("line"))
    return df.select("ordinal", "line", "line_label")


@query
def cascade_fields(spark, sf):
    df = L.cascade_fields(table(spark, sf, "products"), _layers(spark, sf), FIELDS, first_only=["review"])
    return df.select(
        "ordinal", "layer_name", "layer_description", "layer_image", "layer_section",
        F.coalesce("layer_review", F.lit(False)).alias("review"),
    )


@query
def cascade_records(spark, sf):
    df = L.cascade_records(table(spark, sf, "products"), _layers(spark, sf), FIELDS)
    return df.select(
        "ordinal", "layer_name", "layer_description", "layer_section", F.coalesce("layer_no", F.lit(0)).alias("layer_no")
    )


@query
def variant_lookup(spark, sf):
    products = with_variants(table(spark, sf, "products"))
    requests = table(spark, sf, "requests").drop("hint")
    found = L.by_any_code(products, requests, "code", ["order_key", "line_no"], ["name"])
    return found.select(
        "order_key", "line_no", "code", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("name", F.lit("")).alias("name")
    )


@query
def resolve_priority(spark, sf):
    catalogs = {c: with_variants(table(spark, sf, f"catalog_{c}")).withColumnRenamed("barcode", "code") for c in "abc"}
    found = L.resolve(table(spark, sf, "requests"), catalogs, "code", "hint", ["order_key", "line_no"], ["name"])
    return found.select(
        "order_key", "line_no", "code", "hint", F.coalesce("catalog", F.lit("")).alias("catalog"), F.coalesce("name", F.lit("")).alias("name")
    )


@query
def orphans_anti(spark, sf):
    return L.orphans(table(spark, sf, "manifest"), table(spark, sf, "products")).select("barcode", "image")


@query
def used_dims_semi(spark, sf):
    return L.used_dims(_brand_dim(spark, sf), read(spark, sf, "part").select(F.col("p_brand").alias("brand")), "brand")


def _sales(spark, sf):
    sold = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    part = read(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
    )
    return sold.join(part, "l_partkey").withColumnRenamed("l_partkey", "ordinal")


@query
def top10_overall(spark, sf):
    return S.best_sellers(_sales(spark, sf), 10, "quantity", "ordinal")


@query
def top1_per_brand(spark, sf):
    return S.best_per_group(_sales(spark, sf), "brand", "quantity", "ordinal")


@query
def ranked_list_join(spark, sf):
    """The brands' best sellers as one ranked code list with unknown codes in it."""
    best = S.best_sellers(_sales(spark, sf), 10, "quantity", "ordinal").select(
        F.struct(-F.col("quantity"), F.col("ordinal")).alias("place"),
        F.when(F.col("ordinal") % 3 == 0, F.lit("unknown")).otherwise(F.lpad(F.col("ordinal").cast("string"), 13, "0")).alias("code"),
    )
    ranked = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda s: s["code"]).alias("codes"))
    found = S.ranked_join(ranked, table(spark, sf, "products"), "codes", "barcode", "ordinal", ["name"])
    return found.select("rank", "barcode", "ordinal", "name")


@query
def worklist(spark, sf):
    return L.worklist(table(spark, sf, "products").select("ordinal", "barcode"), *_layers(spark, sf), filler=FILLER).select("ordinal", "mode")


@query
def fuzzy_match_size(spark, sf):
    site = table(spark, sf, "site_list", heavy=True)
    best = M.fuzzy_match(table(spark, sf, "supplier_list", heavy=True), site, M.BY_SIZE)
    return M.with_right(best, site, ["name", "url"]).select(
        F.col("lid").alias("ordinal"), F.col("ord").alias("site_ordinal"), "site_name", "site_url", "score",
        M.band(F.col("score"), M.BY_SIZE).alias("band"),
    )


@query
def fuzzy_match_dose(spark, sf):
    best = M.fuzzy_match(table(spark, sf, "supplier_doses", heavy=True), table(spark, sf, "site_doses", heavy=True), M.BY_DOSE)
    return best.select(F.col("lid").alias("ordinal"), F.col("ord").alias("site_ordinal"), "score")


@query
def slug_match(spark, sf):
    best = M.slug_match(table(spark, sf, "products", heavy=True), table(spark, sf, "site_urls", heavy=True), "raw_name", "line")
    return best.select(F.col("lid").alias("ordinal"), F.col("ord").alias("url_ordinal"), "score")


@query
def slug_match_translit(spark, sf):
    best = M.slug_match(
        table(spark, sf, "greek_products", heavy=True), table(spark, sf, "site_urls", heavy=True), "name", "line", transliterate=True, expand=False
    )
    return best.select(F.col("lid").alias("ordinal"), F.col("ord").alias("url_ordinal"), "score")


@query
def two_stage_refine(spark, sf):
    return M.two_stage(
        table(spark, sf, "products").select("ordinal", "barcode", "line"), table(spark, sf, "hits"), table(spark, sf, "site_urls", heavy=True)
    )


# --- aggregations -----------------------------------------------------------


@query
def facet_counts(spark, sf):
    counts = S.facet_counts(table(spark, sf, "products"), "brand")
    dim = _brand_dim(spark, sf).withColumn("position", F.regexp_extract("brand", r"(\d+)", 1).cast("int"))
    return S.in_dim_order(counts, dim, "brand", "position").select("brand", "position", "n")


@query
def facet_by_size(spark, sf):
    return S.by_size(S.facet_counts(table(spark, sf, "products"), "line"))


@query
def facet_tree(spark, sf):
    tree = S.facet_tree(table(spark, sf, "products"), "brand", "line")
    return tree.select(F.coalesce("brand", F.lit("*")).alias("brand"), F.coalesce("line", F.lit("*")).alias("line"), "level", "n").orderBy(
        "level", F.desc("n"), "brand", "line"
    )


@query
def search_counts(spark, sf):
    tree = S.search_counts(table(spark, sf, "products"), ["name", "raw_name", "line", "barcode"], "ring", "brand", "line")
    return tree.select(F.coalesce("brand", F.lit("*")).alias("brand"), F.coalesce("line", F.lit("*")).alias("line"), "level", "n")


@query
def reason_counts(spark, sf):
    return Q.reason_counts(_verdicts(spark, sf))


@query
def quality_totals(spark, sf):
    return Q.totals(_verdicts(spark, sf), "body")


@query
def brand_stats(spark, sf):
    return S.brand_stats(table(spark, sf, "products"), "brand", "line")


@query
def match_bands(spark, sf):
    best = M.fuzzy_match(table(spark, sf, "supplier_list", heavy=True), table(spark, sf, "site_list", heavy=True), M.BY_SIZE, floor=None)
    return S.status_counts(best, M.band(F.col("score"), M.BY_SIZE), "band")


# --- windows, top-k ---------------------------------------------------------


@query
def best_candidate(spark, sf):
    best = M.fuzzy_match(table(spark, sf, "supplier_list", heavy=True), table(spark, sf, "site_list", heavy=True), M.BY_SIZE, floor=None)
    return best.select(F.col("lid").alias("ordinal"), F.col("ord").alias("site_ordinal"), "score")


@query
def top3_candidates(spark, sf):
    best = M.fuzzy_match(table(spark, sf, "supplier_list", heavy=True), table(spark, sf, "site_list", heavy=True), M.BY_SIZE, n=3, floor=None)
    return best.select(F.col("lid").alias("ordinal"), "rank", F.col("ord").alias("site_ordinal"), "score")


@query
def related_items(spark, sf):
    df = table(spark, sf, "products").withColumn("section", F.when(F.col("line") != "SMALL", F.col("line")))
    return S.related(df, ["section"], ["name"])


@query
def related_fill(spark, sf):
    return S.related_fill(table(spark, sf, "products"), "brand", "line", ["name"])


@query
def pick_by_source(spark, sf):
    ranks = [("src3", 0), ("src1", 1), ("src7", 2), ("src12", 3)]
    usable = F.length(F.coalesce("body", F.lit(""))) >= 100
    best = Q.pick_by_source(table(spark, sf, "texts", heavy=True), ranks, "product", "host", "doc_id", usable)
    return best.select("product", "doc_id", "host", "host_rank")


@query
def pick_by_quality(spark, sf):
    return Q.pick_by_quality(table(spark, sf, "texts", heavy=True), "product", "body", "doc_id", FILLER).select(
        "product", "doc_id", F.round("score", 2).alias("score")
    )


@query
def rank_urls(spark, sf):
    pages = read(spark, sf, "pages", heavy=True).select("page_id", U.section(F.col("url")).alias("section"), "url")
    return P.rank_urls(pages, F.col("url").contains(".net"), "section", "page_id")


@query
def sorted_lines(spark, sf):
    df = table(spark, sf, "products").select("brand", "line").distinct()
    return df.orderBy("brand", "line")


@query
def limit_ordered(spark, sf):
    return table(spark, sf, "products").where("barcode != ''").orderBy("ordinal").limit(25).select("ordinal", "barcode", "name")


# --- set operations ---------------------------------------------------------


@query
def catalog_union(spark, sf):
    catalogs = {c: table(spark, sf, f"catalog_{c}").select("ordinal", "barcode", "name") for c in "ab"}
    catalogs["c"] = table(spark, sf, "catalog_c").select("ordinal", "name")
    out = L.catalog_union(catalogs)
    return out.select("catalog", "ordinal", F.coalesce("barcode", F.lit("-")).alias("barcode"), "name")


@query
def dedupe_first(spark, sf):
    df = table(spark, sf, "products").select("ordinal", "name", "brand", "price")
    return L.dedupe_first(df, "name").select("name", "ordinal", "brand", F.col("price").cast("double").alias("price"))


@query
def upsert_last(spark, sf):
    return L.upsert_last(table(spark, sf, "manifest"), table(spark, sf, "manifest_changes"), "barcode").select("barcode", "image", "version")


def _ab(spark, sf):
    return {c: table(spark, sf, f"catalog_{c}") for c in "ab"}


@query
def classify_membership(spark, sf):
    return L.classify_membership(table(spark, sf, "manifest").select("barcode"), _ab(spark, sf), "barcode", "barcode")


@query
def catalog_overlap(spark, sf):
    return L.overlap(_ab(spark, sf), "barcode")


# --- text jobs --------------------------------------------------------------


def _attributes(spark, sf):
    df = table(spark, sf, "titles", heavy=True)
    return df.select("ordinal", "brand", "line", *[c.alias(n) for n, c in attributes(F.col("title")).items()])


@query
def attribute_table(spark, sf):
    df = _attributes(spark, sf)
    lists = [F.array_join(c, "|").alias(c) for c in ("types", "audience", "areas")]
    blanks = [F.coalesce(c, F.lit("")).alias(c) for c in ("spf", "volume")]
    return df.select("ordinal", *blanks, *lists, "is_promo", "is_new")


@query
def attribute_facets(spark, sf):
    df = _attributes(spark, sf)
    df = compute_once(df, labels=F.concat("types", "audience", "areas"))
    return df.select("brand", F.explode("labels").alias("label")).groupBy("brand", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def normalize_names(spark, sf):
    return table(spark, sf, "products").select(
        "ordinal", X.clean_name(F.col("raw_name")).alias("clean_name"), X.decap_name(F.col("raw_name"), "Shelf").alias("brand_name")
    )


@query
def expand_abbrev(spark, sf):
    df = table(spark, sf, "codes", heavy=True)
    return df.select("ordinal", X.prepend_if_absent(F.col("line"), X.expand_name(F.col("raw"))).alias("expanded"))


def _slugs(spark, sf):
    return table(spark, sf, "titles", heavy=True).select("ordinal", X.slug(F.col("title")).alias("slug"))


@query
def slug_keys(spark, sf):
    return _slugs(spark, sf)


@query
def slug_collisions(spark, sf):
    return _slugs(spark, sf).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_seen")).where("n > 1")


NOTES = [("Παιδικό", "Suited for children."), ("Sport", "Resists sweat and water."), ("Anti-Aging", "Acts against ageing.")]


@query
def template_text(spark, sf):
    df = _attributes(spark, sf)
    df = L.with_dim(df, _brand_dim(spark, sf), "brand", "brand_label", F.col("brand"))
    intro = F.concat(F.lit("From "), F.col("brand_label"), F.lit("."))
    text = describe(intro, F.col("spf"), F.col("types"), F.col("volume"), F.col("audience"), NOTES)
    return df.select("ordinal", text.alias("description"))


@query
def line_descriptions(spark, sf):
    """Sun care, cosmetics and seasonal products described by one table of templates."""
    rules = spark.createDataFrame(template_rows(), TEMPLATE_COLUMNS)
    df = table(spark, sf, "described_products", heavy=True)
    facts = attributes(F.col("title"))
    level = F.regexp_extract(facts["spf"], r"^(\d+)", 1).try_cast("double")
    types = F.lower(F.array_join(facts["types"], " / "))
    df = df.select("ordinal", "catalog", "section", "brand", "line", facts["audience"].alias("labels"), level.alias("level"), facts["spf"].alias("spf"), facts["volume"].alias("volume"), types.alias("types"))
    values = {c: c for c in ("brand", "line", "section", "spf", "volume", "types")}
    return describe_by_templates(df, rules, "ordinal", ["catalog", "section", "brand", "line"], "labels", "level", values)


@query
def token_df(spark, sf):
    return M.token_frequencies(table(spark, sf, "supplier_list", heavy=True), "name", M.BY_SIZE.stop_words)


@query
def quality_flags(spark, sf):
    return _verdicts(spark, sf).select("doc_id", "ok", F.array_join("reasons", "|").alias("reasons"))


@query
def quality_audit(spark, sf):
    df = L.cascade_fields(table(spark, sf, "products"), _layers(spark, sf), ["name", "description", "source"])
    flagged = Q.audit(Q.with_verdict(df, "layer_description", FILLER), "layer_description", "too-short")
    return flagged.select(
        "ordinal", F.coalesce("layer_name", "name").alias("name"), F.coalesce("layer_source", F.lit("(none)")).alias("source"),
        F.array_join("reasons", "|").alias("reasons"), "length"
    )


# --- page jobs --------------------------------------------------------------


def product_pages(spark, sf):
    """HTML pages written from the product rows, with every shape a site uses."""
    p = table(spark, sf, "page_products", heavy=True)
    k = F.col("ordinal")
    code = F.lpad(k.cast("string"), 13, "0")
    picture = F.concat(F.lit("https://img.example/"), code, F.lit(".jpg"))
    quoted = F.concat(F.lit('"'), picture, F.lit('"'))
    image = (
        F.when(k % 3 == 0, quoted)
        .when(k % 3 == 1, F.concat(F.lit("["), quoted, F.lit(', "https://img.example/other.jpg"]')))
        .otherwise(F.concat(F.lit('{"@type": "ImageObject", "url": '), quoted, F.lit("}")))
    )
    node = F.concat(
        F.lit('{"@type": '), F.when(k % 2 == 0, F.lit('"Product"')).otherwise(F.lit('["Thing", "Product"]')),
        F.lit(', "name": "'), F.col("name"), F.lit('", "sku": "SKU-'), k.cast("string"),
        F.lit('", "gtin13": "'), code, F.lit('", "image": '), image, F.lit("}"),
    )
    graph = F.when(
        k % 4 == 0, F.concat(F.lit('{"@context": "x", "@graph": [{"@type": "WebPage", "name": "no"}, '), node, F.lit("]}"))
    ).otherwise(node)
    ld = F.when(k % 7 == 0, F.lit('<script type="application/ld+json">{broken</script>')).otherwise(
        F.concat(F.lit('<script type="application/ld+json"> '), graph, F.lit(" </script>"))
    )
    sku = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('<span class="sku">W-'), k.cast("string"), F.lit("</span>")))
    short = F.concat(F.lit('<div class="strong-desc">Short <b>text</b> '), k.cast("string"), F.lit("</div>"))
    sentence = F.concat(F.lit("It&#39;s the "), F.col("p_name"), F.lit(" of the &lt;"), F.col("p_type"), F.lit("&gt; line &amp;amp; more. "))
    long = F.concat(F.lit('<section class="product-description"><p>'), F.repeat(sentence, 4), F.lit("</p><p>End"), k.cast("string"), F.lit("</p></section>"))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("name"), F.lit("</title><meta property=\"og:title\" content='"), F.col("name"),
        F.lit(" | Shelf Site'><meta property=\"og:description\" content=\"The maker's "), F.col("p_name"),
        F.lit(' &amp; more"><meta property="og:image" content="'), picture, F.lit('">'), ld,
        F.lit("</head><body><h1>"), F.col("name"), F.lit("</h1>"), sku, short, F.when(k % 6 != 0, long).otherwise(F.lit("")),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://www.shop.example/"), F.lower("p_type"), F.lit("/p-"), code, F.lit(".html"))
    return p.select("ordinal", url.alias("url"), html.alias("html"))


@query
def page_records(spark, sf):
    records = P.page_records(product_pages(spark, sf), "Shelf Site")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("image", "sku", "gtin")]
    return records.select("ordinal", "section", "name", "description", *blank)


@query
def jsonld_products(spark, sf):
    df = H.with_jsonld(product_pages(spark, sf), "html").where("ld is not null")
    return df.select("ordinal", *[F.col(f"ld.{c}").alias(c) for c in ("name", "image", "sku", "gtin")])


@query
def sku_candidates(spark, sf):
    found = compute_once(product_pages(spark, sf), skus=H.sku_candidates(F.col("html")))
    return found.select("ordinal", F.posexplode("skus").alias("position", "sku"))


@query
def longest_block(spark, sf):
    return H.with_longest_block(product_pages(spark, sf), "html").select("ordinal", F.coalesce("block", F.lit("")).alias("block"))


@query
def best_description(spark, sf):
    """Containers against the description of a second JSON-LD block, which every sixth page has."""
    told = F.concat(
        F.lit('<script type="application/ld+json">{"@graph": [{"@graph": [{"@type": "Product", "description": "'),
        F.repeat(F.concat(F.lit("A <b>told</b> text of "), F.col("name"), F.lit(". ")), 8), F.lit('"}]}]}</script>'),
    )
    names = table(spark, sf, "page_products").select("ordinal", "name")
    pages = product_pages(spark, sf).join(names, "ordinal")
    pages = pages.withColumn("html", F.when(F.col("ordinal") % 6 == 0, F.concat("html", told)).otherwise(F.col("html")))
    return H.with_best_description(pages, "html").select("ordinal", F.coalesce("description", F.lit("")).alias("description"))


SUBTITLE_PAGES = (
    '<h4 class="x sub-title">{}</h4>',
    '<div class="woocommerce-product-details__short-description">{}</div>',
    '<div class="summary entry-summary"><span>no</span><p>{}</p></div>',
    '<p class="product-tagline">{}</p>',
    "<h1>T</h1> <h2>{}</h2>",
    "<h1>T</h1><i>x</i><p> <strong>{}</strong> </p>",
    '<h2 class="elementor-heading-title">{}</h2>',
)


@query
def page_subtitle(spark, sf):
    k = F.col("ordinal")
    text = F.when(k % 5 == 0, F.lit("too short")).otherwise(F.concat(F.lit("The  subtitle of &#112;age "), k.cast("string")))
    shapes = F.array(*(F.lit(s) for s in SUBTITLE_PAGES))
    html = F.replace(F.element_at(shapes, (k % len(SUBTITLE_PAGES) + 1).cast("int")), F.lit("{}"), text)
    pages = table(spark, sf, "page_products").select("ordinal", html.alias("html"))
    return pages.select("ordinal", F.coalesce(H.subtitle(F.col("html")), F.lit("")).alias("subtitle"))


@query
def search_terms(spark, sf):
    documents = read(spark, sf, "documents", heavy=True)
    index = G.write_index(documents, "doc_id", "text", run_dir(spark, "grams"))
    items = read(spark, sf, "benchmark").selectExpr(
        "'item ' || item_id as term_id", "substring(text, 1 + length(text) % 40, 4 + length(text) % 9) as term"
    )
    short = read(spark, sf, "region").selectExpr("'region ' || r_regionkey as term_id", "substring(r_name, 1, 1 + r_regionkey % 2) || ' ' as term")
    none = read(spark, sf, "nation").selectExpr("'nation ' || n_nationkey as term_id", "n_name as term")
    found = G.search_terms(documents, "doc_id", "text", index, items.union(short).union(none))
    return found.select("term_id", "term", F.col("id").alias("doc_id"))


@query
def extraction_coverage(spark, sf):
    return P.coverage(P.page_records(product_pages(spark, sf), "Shelf Site"))


def site_pages(spark, sf):
    """The given pages, whole, with product markup of several kinds put in front of their bodies."""
    k = F.col("page_id").cast("string")
    product = F.concat(F.lit('{"@type": "Product", "name": "Item '), k, F.lit('", "sku": "S-'), k, F.lit('", "gtin13": "'), F.lpad(k, 13, "0"), F.lit('"}'))
    nested = F.concat(F.lit('<script type="application/ld+json">' + '{"@graph": [{"@type": "WebPage", "name": "no"}, ' * 12), product, F.lit("]}" * 12 + "</script>"))
    tags = F.concat(F.lit('<meta property="og:title" content="Item '), k, F.lit(' | Shelf Site"><meta name="description" content="Told of '), k, F.lit(' &amp; more">'))
    code = F.concat(F.lit('<span class="sku">W-'), k, F.lit("</span>"))
    block = F.concat(F.lit('<section class="product-description"><p>'), F.repeat(F.concat(F.lit("About item "), k, F.lit(". ")), 20), F.lit("</p></section>"))
    part = F.col("page_id")
    markup = F.concat(
        F.when(part % 3 == 0, nested).when(part % 3 == 1, tags).otherwise(F.lit("")),
        F.when(part % 2 == 0, code).otherwise(F.lit("")),
        F.when(part % 4 != 0, block).otherwise(F.lit("")),
    )
    return read(spark, sf, "pages", heavy=True).select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), markup)).alias("html"))


@query
def site_records(spark, sf):
    records = P.page_records(site_pages(spark, sf), "Shelf Site")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("section", "sku", "gtin")]
    return records.select("page_id", "name", "description", F.size("all_skus").alias("n_skus"), *blank)


@query
def site_coverage(spark, sf):
    return P.coverage(P.page_records(site_pages(spark, sf), "Shelf Site"))


@query
def site_blocks(spark, sf):
    return H.with_longest_block(site_pages(spark, sf), "html").select("page_id", F.coalesce("block", F.lit("")).alias("block"))


@query
def page_links(spark, sf):
    more = F.concat(F.lit('<a href="?page='), (F.col("page_id") % 3).cast("string"), F.lit('">2</a><a href="../up/./x">up</a><a href="./here/../there">t</a>'))
    pages = read(spark, sf, "pages", heavy=True).withColumn("html", F.concat("html", more))
    return P.page_links(pages, "page_id").select("page_id", "host", "link", "is_paged", "verdict")


def shop_pages(spark, sf):
    """The given pages as pages of one shop: each links to the shop's first page, to two
    pages further on, and has a numbered next page; links to some pages are missing."""
    k = F.col("page_id")

    def url(n):
        return F.concat(F.lit("https://shop.example/"), F.when(n % 4 == 0, F.lit("list?page=")).otherwise(F.lit("products/page-number-")), n.cast("string"))

    def link(n, there):
        return F.when(there, F.concat(F.lit("<a href='"), F.replace(url(n), F.lit("https://shop.example"), F.lit("")), F.lit("'>on</a>"))).otherwise(F.lit(""))

    more = [link(n, n % 11 != 3) for n in (k * 0, k * 2 + 1, k * 2 + 2)]
    return read(spark, sf, "pages", heavy=True).select("page_id", url(k).alias("url"), F.concat("html", *more, link(k + 4, k % 4 == 0)).alias("html"))


def shop_seeds(spark, sf):
    starts = shop_pages(spark, sf).where("page_id = 0 or page_id % 97 = 5")
    return starts.select("url", F.concat(F.lit("section "), F.col("page_id").cast("string")).alias("section"))


@query
def page_reach(spark, sf):
    return W.page_reach(shop_pages(spark, sf), shop_seeds(spark, sf), "page_id").select("page_id", "section", "depth")


@query
def html_text(spark, sf):
    return read(spark, sf, "pages", heavy=True).select("page_id", H.to_text(F.col("html")).alias("text"))


@query
def url_keys(spark, sf):
    keys = P.url_keys(read(spark, sf, "pages", heavy=True))
    return keys.groupBy("host", "section").agg(F.count(F.lit(1)).alias("n"), F.count("code").alias("with_code"))


# --- incremental ------------------------------------------------------------


@query
def incremental_ingest(spark, sf):
    folder = run_dir(spark, "ingest")
    schema = read(spark, sf, "pages").schema

    def extract(batch):
        return batch.select(
            "page_id", U.host(F.col("url")).alias("host"), "url", H.page_title(F.col("html")).alias("title"), F.length("html").alias("size")
        )

    # two runs: the pages of even ids, then all pages, so that half of the second run is known
    pages = read(spark, sf, "pages")
    for run, rows in (("even", pages.where("page_id % 2 = 0")), ("every", pages)):
        rows.write.parquet(f"{folder}/in/{run}")
        stream = page_stream(spark, f"{folder}/in/*", schema)
        ingest(stream, f"{folder}/store", f"{folder}/checkpoint", "url", "page_id", extract)
    return spark.read.parquet(f"{folder}/store").drop("batch_id", "bucket")

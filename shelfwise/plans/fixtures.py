"""Inputs of the registered queries, derived from the given tables.

Every derived table is a list of column expressions that Spark and the check
database read alike, so both sides of a check start from the same rows. All
tables keep every row of their source; a layer that covers only some products
does so by product type or size, as a real layer would.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.io import spread_scan


@dataclass(frozen=True)
class Derived:
    source: str
    columns: dict[str, str]
    where: str | None = None
    join: tuple[str, str] | None = None
    needs: tuple[str, ...] = field(default=())

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {a}" for a, e in self.columns.items())
        join = f" LEFT JOIN {self.join[0]} ON {self.join[1]}" if self.join else ""
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {cols} FROM {self.source}{join}{where}"


#: Phrases that the shop of the fixture puts into its texts.
FILLER = (r"Online\s+Pharmacy", r"free\s+shipping")
KEY = "lpad(cast(p_partkey as string), 13, '0')"
SIZE = "cast(p_size as string)"
GREEK_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
GREEK_TO = "αβγδεφγηιξκλμνοπθρστυβωχψζΑΒΓΔΕΦΓΗΙΞΚΛΜΝΟΠΘΡΣΤΥΒΩΧΨΖ"
#: Latin letters whose Greek twin transliterates back to the same letter.
TWIN_FROM, TWIN_TO = "abgdezklmnoprstfi", "αβγδεζκλμνοπρστφι"

PRODUCT_COLUMNS = {
    "ordinal": "p_partkey",
    "barcode": f"case when p_partkey % 50 = 0 then '' else {KEY} end",
    "alt_code": "lpad(cast(p_partkey + 1000000 as string), 13, '0')",
    "brand": "p_brand",
    "line": "p_type",
    "name": f"p_name || ' ' || {SIZE} || 'ml'",
    "raw_name": f"upper(p_name) || ' ' || {SIZE} || 'ML EN GR'",
    "price": "cast(case when p_partkey % 11 = 0 then 0 else p_retailprice end as decimal(10,2))",
}

FIXTURES: dict[str, Derived] = {
    "products": Derived("part", PRODUCT_COLUMNS),
    "page_products": Derived(
        "part", {**PRODUCT_COLUMNS, "p_name": "p_name", "p_type": "p_type", "p_size": "p_size"}
    ),
    "titles": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "brand": "p_brand",
            "line": "p_type",
            "title": "p_name || case p_partkey % 8 when 0 then ' Gel-Cream SPF50+' "
            "when 1 then ' κρέμα προσώπου SPF 30' when 2 then ' Body Lotion kids' "
            "when 3 then ' spray SPF20 sport' when 4 then ' lip balm stick' when 5 then ' hair oil new' "
            "when 6 then ' promo pack serum' else ' anti-age fluid face/body' end || ' ' || "
            f"{SIZE} || case p_partkey % 3 when 0 then 'ml' when 1 then ' gr' else ' x' end",
        },
    ),
    "described_products": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "catalog": "case p_partkey % 4 when 0 then 'sun' when 1 then 'cosmetics' when 2 then 'seasonal' else 'sun' end",
            "section": "case when p_partkey % 4 = 2 then case p_size % 5 when 0 then 'slimming' when 1 then 'insects' "
            "when 2 then 'rodents' when 3 then 'travel' end end",
            "brand": "p_brand",
            "line": "case when p_partkey % 9 = 0 then '' else p_type end",
            "title": "p_name || case p_partkey % 13 when 0 then ' Gel-Cream SPF50+' when 1 then ' κρέμα SPF 30 sensitive' "
            "when 2 then ' lotion kids' when 3 then ' spray SPF20 sport' when 4 then ' anti-spot fluid SPF 50' "
            "when 5 then ' family milk SPF15' when 6 then ' dry touch gel oil-control SPF 30' when 7 then ' teint cream' "
            "when 8 then ' wet skin mist SPF 6' when 9 then ' anti-age serum' else '' end || ' ' || "
            f"{SIZE} || case p_partkey % 3 when 0 then 'ml' when 1 then ' gr' else ' x' end",
        },
    ),
    "override_layer": Derived(
        "part",
        {
            "barcode": KEY,
            "name": "case when p_partkey % 5 = 0 then '' else 'Official ' || p_name end",
            "description": "text",
            "image": f"case when p_partkey % 4 = 0 then '' else 'img/' || {KEY} || '.jpg' end",
            "section": "case when p_partkey % 7 = 0 then cast(null as string) else p_type end",
            "source": "'site'",
            "review": "p_partkey % 6 = 0",
        },
        where="p_type in ('ECONOMY', 'PROMO', 'LARGE')",
        join=("documents", "doc_id = p_partkey"),
    ),
    "supplemental_layer": Derived(
        "part",
        {
            "barcode": KEY,
            "name": "'Alt ' || p_name",
            "description": "'Alternative text ' || cast(p_partkey as string)",
            "image": f"case when p_partkey % 3 = 0 then '' else 'alt/' || {KEY} || '.jpg' end",
            "section": "p_type",
            "source": "'shop'",
        },
        where="p_size <= 25",
    ),
    "manifest": Derived(
        "part",
        {
            "barcode": "case when p_brand = 'Brand#1' then lpad(cast(p_partkey + 5000000 as string), 13, '0') "
            f"when p_partkey % 40 = 0 then '' else {KEY} end",
            "image": f"'img/' || {KEY} || '.jpg'",
            "version": "1",
        },
    ),
    "manifest_changes": Derived(
        "part",
        {"barcode": KEY, "image": f"'new/' || {KEY} || '.jpg'", "version": "case when p_partkey % 3 = 0 then 0 else 1 end"},
    ),
    "catalog_a": Derived("part", {**PRODUCT_COLUMNS, "name": "'a: ' || p_name"}, "p_type in ('ECONOMY', 'PROMO')"),
    "catalog_b": Derived("part", {**PRODUCT_COLUMNS, "name": "'b: ' || p_name"}, "p_size <= 20"),
    "catalog_c": Derived("part", {**PRODUCT_COLUMNS, "name": "'c: ' || p_name"}),
    "requests": Derived(
        "lineitem",
        {
            "order_key": "l_orderkey",
            "line_no": "l_linenumber",
            "code": "case when l_linenumber % 5 = 4 then 'unknown' else "
            "lpad(cast(l_partkey + case when l_linenumber % 2 = 0 then 1000000 else 0 end as string), 13, '0') end",
            "hint": "case l_returnflag when 'A' then 'a' when 'R' then 'b' else 'none' end",
        },
    ),
    "supplier_sheet": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "brand": "case when p_partkey % 17 = 0 then 'Nope' else ' ' || p_brand end",
            "code": KEY,
            "name": "case when p_partkey % 23 = 0 then ' ' else p_name end",
            "price": "case when p_partkey % 19 = 0 then 'n/a' when p_partkey % 2 = 0 then "
            "replace(cast(cast(p_retailprice as decimal(10,2)) as string), '.', ',') "
            "else cast(cast(p_retailprice as decimal(10,2)) as string) end",
            "vat": "case when p_partkey % 3 = 0 then '13' else cast(null as string) end",
        },
    ),
    "offers": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": "case when p_partkey % 9 = 0 then 'Cream  Booster 5 ml ' when p_partkey % 14 = 0 then 'ΝΕΣΕΣΕΡ ' "
            "when p_partkey % 15 = 0 then 'ΔΩΡΟ ΔΕΙΓΜΑ ' else '' end || p_name || ' ' || p_type",
        },
    ),
    "supplements": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": "p_name || case p_partkey % 16 when 0 then ' Omega 3' when 1 then ' Vitamin C 500' "
            "when 2 then ' zinc' when 3 then ' Garlic' when 4 then ' Maca root' when 5 then ' fish  oil' "
            "when 6 then ' Multi-Guard' when 7 then ' for kids' when 8 then ' B12' when 9 then ' L-carnitine' "
            "when 10 then ' iron' when 11 then ' milk thistle' when 12 then ' skin care' when 13 then ' barley' "
            "when 14 then ' meno-pause' else '' end",
        },
    ),
    "supplier_list": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": f"case when p_partkey % 10 < 6 then p_name || ' ' || p_type || ' ' || {SIZE} || 'ml' "
            "when p_partkey % 10 < 8 then p_name || ' pack' "
            "else 'item' || cast(p_partkey as string) || ' ' || p_type end "
            "|| case when p_partkey % 13 = 0 then ' δώρο' else '' end || case when p_partkey % 8 = 0 then ' Ορός' else '' end",
        },
    ),
    "site_list": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": f"p_name || ' ' || {SIZE} || 'ml' || case when p_partkey % 6 = 0 then ' ορός serum' else '' end",
            "url": "'https://shop.example/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-' "
            f"|| {SIZE} || 'ml.html'",
            "section": "case when p_partkey % 5 = 0 then 'proionta-prosfores' else lower(p_type) end",
        },
    ),
    "supplier_doses": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": f"p_name || ' ' || {SIZE} || ' mg ' || cast(30 + p_partkey % 3 * 30 as string) || 'caps'",
        },
    ),
    "site_doses": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "name": f"p_name || ' ' || p_type || case when p_partkey % 4 = 0 then '' else ' ' || {SIZE} || 'mg' end || "
            "' x' || cast(30 + p_partkey % 2 * 30 as string) || 'caps'",
            "url": "'https://shop.example/product/' || replace(p_name, ' ', '-') || '/'",
            "section": "p_type",
        },
    ),
    "site_urls": Derived(
        "part",
        {
            "url_ordinal": "p_partkey",
            "url": "'https://shop.example/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-' "
            f"|| {SIZE} || 'ml.html?ref=1'",
        },
    ),
    "greek_products": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "barcode": f"case when p_partkey % 50 = 0 then '' else {KEY} end",
            "line": "p_type",
            "name": f"translate(p_name, '{TWIN_FROM}', '{TWIN_TO}') || ' ' || {SIZE} || 'ml'",
        },
    ),
    "hits": Derived(
        "part",
        {
            "barcode": KEY,
            "name": f"case when p_partkey % 3 = 0 then 'unlisted' else translate(p_name, '{TWIN_FROM}', '{TWIN_TO}') end",
            "url": f"'https://pharm.example/p/' || {KEY}",
        },
    ),
    "url_pairs": Derived(
        "lineitem",
        {
            "order_key": "l_orderkey",
            "line_no": "l_linenumber",
            "name": "case l_linenumber % 3 when 0 then 'Cream DAY 50ml' when 1 then 'CREAM night 50ml' "
            "else 'Cream ngt birthday' end",
            "url": "'https://img.example/' || case l_partkey % 4 when 0 then 'creme-de-nuit' when 1 then 'day-cream' "
            "when 2 then 'holiday-night' else 'creme-jour' end || '-' || cast(l_partkey as string) || '.jpg'",
        },
    ),
    "texts": Derived(
        "documents",
        {
            "doc_id": "doc_id",
            "product": "cast(floor(doc_id / 12) as bigint)",
            "host": "source",
            "body": "case when doc_id % 9 = 2 then cast(null as string) "
            "when doc_id % 10 = 0 then squashed || '...' "
            f"when doc_id % 4 = 1 then translate(squashed, '{GREEK_FROM}', '{GREEK_TO}') "
            "when doc_id % 11 = 3 then squashed || ' Online  Pharmacy' else squashed end",
        },
    ),
    "codes": Derived(
        "part",
        {
            "ordinal": "p_partkey",
            "line": "p_type",
            "raw": "case p_partkey % 6 when 0 then 'PT SOOT WAT ' when 1 then 'M.89 SPR ' when 2 then 'CICA cr ' "
            "when 3 then 'EFF M-UP INV ' when 4 then 'anti-tr DEO ' else 'LFT HOM ' || p_type || ' ' end || upper(p_name) "
            f"|| ' F' || {SIZE} || 'ML FR EN gr'",
        },
    ),
}

# documents with white space squashed once, shared by the texts fixture
SQUASH_SPARK = r"trim(regexp_replace(text, '\\s+', ' '))"
SQUASH_CHECK = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def read(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_scan(df) if heavy else df


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    d = FIXTURES[name]
    df = read(spark, sf_dir, d.source, heavy)
    if d.source == "documents":
        df = df.withColumn("squashed", F.expr(SQUASH_SPARK))
    if d.where:
        df = df.where(d.where)
    if d.join:
        df = df.join(read(spark, sf_dir, d.join[0]), F.expr(d.join[1]), "left")
    return df.selectExpr(*[f"{e} AS {a}" for a, e in d.columns.items()])


def with_variants(products: DataFrame) -> DataFrame:
    return products.withColumn("variants", F.array("barcode", "alt_code"))


def ctes(*names: str, **more: str) -> str:
    """WITH clause for the check side: fixtures first, then named subqueries."""
    parts = []
    for name in names:
        sql = FIXTURES[name].sql()
        if FIXTURES[name].source == "documents":
            sql = sql.replace("FROM documents", f"FROM (SELECT *, {SQUASH_CHECK} AS squashed FROM documents) d")
        parts.append(f"{name} AS ({sql})")
    parts += [f"{name} AS ({sql})" for name, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


#: The template table of the queries, kept as data: a header and tab-separated rows, blank for any.
TEMPLATE_FILE = os.path.join(os.path.dirname(__file__), "line_templates.tsv")
TEMPLATE_COLUMNS = "catalog string, section string, brand string, line string, attribute string, least double, place int, sentence string"


def template_rows() -> list[tuple]:
    """The rows of the file, a few dozen."""
    with open(TEMPLATE_FILE, encoding="utf-8") as f:
        rows = [[x or None for x in line.rstrip("\n").split("\t")] for line in f][1:]
    return [(*r[:5], None if r[5] is None else float(r[5]), int(r[6]), r[7]) for r in rows]

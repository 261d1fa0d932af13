"""Check SQL: the same results by plain relational means, one per query."""

from __future__ import annotations

from shelfwise.functions.attributes import AREA_LABELS, AUDIENCE_LABELS, PROMO_NAME, TYPE_LABELS
from shelfwise.functions.html import ENTITIES
from shelfwise.functions.text import ABBREVIATIONS, CONTAINER_CODE, KEPT_CAPITALS, LOCALES, REGION_TOKENS, ROMAN_ONE_TO_ONE
from shelfwise.functions.urls import REJECTED
from shelfwise.operators.match import DOSE_STOP_WORDS, SIZE_STOP_WORDS, UNITS
from shelfwise.operators.rules import EXCLUSION_RULES, SECTION_RULES
from shelfwise.plans.fixtures import ctes, template_rows

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ilike(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit('(?i)' + pattern)})"


def squash(col: str) -> str:
    return rf"trim(regexp_replace({col}, '\s+', ' ', 'g'))"


# --- sources and sinks ------------------------------------------------------

ORACLES["scan_catalog"] = (
    "SELECT p_partkey AS ordinal, p_name AS name, p_brand AS brand, p_retailprice AS price FROM part"
)
ORACLES["map_to_rows"] = """
SELECT event_id, code, json_extract_string(props, '$."' || code || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS code FROM events) t
"""
ORACLES["export_delimited"] = ctes("products") + """
SELECT ordinal, concat_ws(';', CASE WHEN ordinal % 7 = 0 THEN '"' || name || ' ""new""; x"' ELSE name END,
  replace(cast(price AS varchar), '.', ','), barcode, line) AS value
FROM products
"""

# description verdict, shared by several checks
FILLER = r"(Online\s+Pharmacy|free\s+shipping)"


def verdict(source: str, key: str, text: str) -> dict[str, str]:
    s = f"trim(coalesce({text}, ''))"
    return {
        "chars": f"""SELECT *, {s} AS s, length({s}) AS len,
          length(regexp_replace({s}, '[^α-ωΑ-Ωά-ώΆ-Ώ]', '', 'g')) AS greek,
          length(regexp_replace({s}, '[^a-zA-Z]', '', 'g')) AS latin FROM {source}""",
        "verdicts": f"""SELECT *, CASE WHEN s = '' THEN 'missing' ELSE concat_ws('|',
          CASE WHEN len < 120 THEN 'too-short' END,
          CASE WHEN {ilike('s', FILLER)} THEN 'pharmacy-fluff' END,
          CASE WHEN latin > 30 AND greek < latin / 3 THEN 'english-only' END,
          CASE WHEN len < 220 AND regexp_matches(s, '(\\.{{3,}}|…)\\s*$') THEN 'truncated' END) END AS why
          FROM chars""",
    }


TEXTS = ctes("texts", **verdict("texts", "doc_id", "body"))
TOTALS = """SELECT count(*) AS products, count(*) FILTER (s <> '') AS with_text,
  count(*) FILTER (why = '') AS ok, count(*) FILTER (why <> '') AS flagged FROM verdicts"""
ORACLES["quality_report_json"] = TEXTS + f"""
SELECT 'totals' AS kind, cast(to_json(t) AS varchar) AS value FROM ({TOTALS}) t
UNION ALL
SELECT 'flagged', '{{"doc_id":' || doc_id || ',"reasons":["' || replace(why, '|', '","') || '"],"length":'
  || length(coalesce(body, '')) || '}}' FROM verdicts WHERE why <> ''
"""

# --- projections, filters ---------------------------------------------------

LAYERS = """
  SELECT p.*, nullif(o.name, '') AS n1, nullif(s.name, '') AS n2, nullif(o.description, '') AS d1,
    nullif(s.description, '') AS d2, nullif(o.image, '') AS i1, nullif(s.image, '') AS i2,
    nullif(o.section, '') AS s1, nullif(s.section, '') AS s2, o.review,
    o.source AS src1, s.source AS src2,
    o.barcode AS k1, s.barcode AS k2
  FROM products p
  LEFT JOIN override_layer o ON o.barcode = p.barcode AND p.barcode <> ''
  LEFT JOIN supplemental_layer s ON s.barcode = p.barcode AND p.barcode <> ''
"""
LAYERED = ("products", "override_layer", "supplemental_layer")
ORACLES["display_table"] = ctes(*LAYERED, layered=LAYERS) + rf"""
SELECT ordinal,
  'Shelf ' || CASE WHEN coalesce(n1, n2) IS NOT NULL THEN coalesce(n1, n2) ELSE array_to_string(list_transform(
     regexp_extract_all(upper(name), '[A-Z]{{2,}}|[^A-Z]+|[A-Z]'),
     lambda r: CASE WHEN regexp_matches(r, '^[A-Z]{{2,}}$') THEN r[1] || lower(r[2:]) ELSE r END), '') END AS display_name,
  CASE WHEN price > 0 THEN cast(price AS varchar) ELSE '' END AS price,
  coalesce(d1, d2, 'Product of The ' || brand || ' — ' || upper(name)) AS description,
  'The ' || brand AS brand_label,
  CASE WHEN line = 'ECONOMY' THEN line ELSE upper(line[1]) || lower(line[2:]) END AS line_label,
  CASE WHEN alt_code = barcode THEN '' ELSE alt_code END AS variants,
  coalesce(i1, i2, '') AS image
FROM layered
"""
ORACLES["search_blob"] = ctes("products") + """
SELECT ordinal, name FROM products
WHERE lower(name || ' ' || brand || ' ' || line || ' ' || barcode) LIKE '%red%'
"""
REVIEW = ctes(*LAYERED, layered=LAYERS, described="SELECT *, coalesce(d1, d2) AS dd FROM layered", **verdict("described", "ordinal", "dd"))
ORACLES["search_review"] = REVIEW + """
SELECT ordinal, coalesce(n1, n2) AS layer_name FROM verdicts
WHERE why <> '' AND lower(name || ' ' || coalesce(n1, n2, '') || ' ' || barcode) LIKE '%official%'
"""
ORACLES["facet_filter"] = ctes("products") + "SELECT ordinal, brand, name FROM products WHERE brand = 'Brand#11'"
ORACLES["validate_rows"] = ctes("supplier_sheet") + """
SELECT ordinal, CASE WHEN trim(name) = '' THEN 'required'
    WHEN trim(brand) NOT IN (SELECT 'Brand#' || i FROM range(1, 26) r(i)) THEN 'unknown-key'
    WHEN price = 'n/a' THEN 'price' ELSE 'accepted' END AS status,
  coalesce(try_cast(replace(price, ',', '.') AS double), 0) AS price,
  coalesce(try_cast(vat AS integer), 24) AS vat
FROM supplier_sheet
"""


def first_rule(rules, default: str, value: int = 0, col: str = "name") -> str:
    whens = " ".join(f"WHEN {ilike(col, r[1])} THEN {lit(r[value])}" for r in rules)
    return f"CASE {whens} ELSE {lit(default)} END"


ORACLES["exclusion_rules"] = ctes("offers") + (
    f"SELECT ordinal, name, {first_rule(EXCLUSION_RULES, '')} AS rule, {first_rule(EXCLUSION_RULES, '', 2)} AS reason FROM offers"
)
ORACLES["exclusion_breakdown"] = ctes("offers") + (
    f"SELECT {first_rule(EXCLUSION_RULES, 'kept')} AS rule, {first_rule(EXCLUSION_RULES, '', 2)} AS reason, "
    "count(*) AS n FROM offers GROUP BY ALL"
)
ORACLES["rule_classify"] = ctes("supplements") + (
    f"SELECT ordinal, name, {first_rule(SECTION_RULES, 'diafora')} AS section FROM supplements"
)
# URL parts by plain string functions
URL_PARTS = r"""
  SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host,
    list_filter(string_split(regexp_replace(regexp_replace(lower(url), '^https?://[^/]+', ''), '[?#].*$', ''), '/'),
                lambda s: s <> '') AS segs
  FROM pages
"""
ORACLES["product_url_census"] = ctes(parts=URL_PARTS) + rf"""
SELECT host, CASE WHEN regexp_matches(lower(url), 'sitemap|robots|\.xml(\?|$)') THEN 'machine'
  WHEN regexp_matches(lower(url), '/({'|'.join(REJECTED)})(/|$)') THEN 'rejected'
  WHEN regexp_matches(lower(url), '/(en|fr)/') THEN 'accepted'
  WHEN len(segs) < 2 THEN 'shallow'
  WHEN length(segs[-1]) > 3 AND contains(segs[-1], '-') THEN 'long-slug' ELSE 'other' END AS verdict, count(*) AS n
FROM parts GROUP BY ALL
"""
ORACLES["host_allowlist"] = ctes(parts=URL_PARTS) + """
SELECT page_id, host FROM parts
WHERE host IN ('ththin.example.com', 'therin.example.net', 'cheap-pills.example.com', 'spam-farm.example.org')
"""


def occurrences(text: str) -> str:
    return f"cast((length(html) - length(replace(html, {lit(text)}, ''))) / {len(text)} AS integer)"


ORACLES["page_audit"] = rf"""
SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), ''), '<no title>') AS title,
  length(html) AS size, {occurrences('<h2')} AS n_h2, {occurrences('<p>')} + {occurrences('<p ')} AS n_paragraphs,
  {occurrences('<a ')} AS n_links,
  (contains(lower(html), 'cf-browser-verification') OR contains(lower(html), 'cf_chl_opt')
   OR contains(lower(html), 'checking your browser before accessing') OR contains(lower(html), 'are you a robot')
   OR (contains(lower(html), 'cloudflare') AND (contains(lower(html), 'attention required') OR contains(lower(html), 'just a moment')))
   OR (length(html) < 5000 AND regexp_matches(lower(html), '\brecaptcha\b|\bg-recaptcha\b'))
   OR regexp_matches(lower(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)), '\b(access denied|blocked|forbidden|403)\b')) AS blocked,
  (length(html) < 80000 AND regexp_matches(lower(html), 'cookie|consent|gdpr|onetrust|cookiebot')) AS consent,
  (length(html) < 50000 AND regexp_matches(html, '(?i)select.{{0,20}}(region|country|location|language)')) AS region,
  regexp_matches(html, 'g-recaptcha|recaptcha/api\.js') AS captcha
FROM pages
"""
# only the words that occur in the candidate URLs decide
ORACLES["variant_conflict"] = ctes("url_pairs") + r"""
SELECT * FROM (SELECT *, regexp_matches(url, 'nuit|night') AS un,
    regexp_matches(url, '/day-cream|jour') AS ud FROM url_pairs) t
WHERE NOT ((name = 'Cream DAY 50ml' AND un AND NOT ud)
        OR (name IN ('CREAM night 50ml', 'Cream ngt birthday') AND ud AND NOT un))
"""
ORACLES["variant_conflict"] = ORACLES["variant_conflict"].replace("SELECT * FROM (SELECT", "SELECT order_key, line_no, name, url FROM (SELECT")

# --- joins ------------------------------------------------------------------

ORACLES["dim_lookup"] = ctes("products") + """
SELECT ordinal, line, CASE WHEN line = 'ECONOMY' THEN line ELSE upper(line[1]) || lower(line[2:]) END AS line_label FROM products
"""
ORACLES["cascade_fields"] = ctes(*LAYERED, layered=LAYERS) + """
SELECT ordinal, coalesce(n1, n2) AS layer_name, coalesce(d1, d2) AS layer_description, coalesce(i1, i2) AS layer_image,
  coalesce(s1, s2) AS layer_section, coalesce(review, false) AS review FROM layered
"""
ORACLES["cascade_records"] = ctes(*LAYERED) + """
SELECT p.ordinal,
  CASE WHEN o.barcode IS NOT NULL THEN o.name ELSE s.name END AS layer_name,
  CASE WHEN o.barcode IS NOT NULL THEN o.description ELSE s.description END AS layer_description,
  CASE WHEN o.barcode IS NOT NULL THEN o.section ELSE s.section END AS layer_section,
  CASE WHEN o.barcode IS NOT NULL THEN 1 WHEN s.barcode IS NOT NULL THEN 2 ELSE 0 END AS layer_no
FROM products p LEFT JOIN override_layer o ON o.barcode = p.barcode LEFT JOIN supplemental_layer s ON s.barcode = p.barcode
"""
ORACLES["variant_lookup"] = ctes(
    "products",
    "requests",
    codes="SELECT barcode AS code, ordinal, name FROM products WHERE barcode <> '' UNION SELECT alt_code, ordinal, name FROM products",
    firsts="SELECT code, arg_min(ordinal, ordinal) AS ordinal, arg_min(name, ordinal) AS name FROM codes GROUP BY code",
) + """
SELECT r.order_key, r.line_no, r.code, coalesce(f.ordinal, -1) AS ordinal, coalesce(f.name, '') AS name
FROM requests r LEFT JOIN firsts f USING (code)
"""
ORACLES["resolve_priority"] = ctes(
    "catalog_a",
    "catalog_b",
    "catalog_c",
    "requests",
    everything=" UNION ALL ".join(f"SELECT '{c}' AS catalog, {i} AS place, unnest([barcode, alt_code]) AS code, name, ordinal FROM catalog_{c}" for i, c in enumerate("abc")),
    ranked="""SELECT r.code, r.hint, e.catalog, e.name, row_number() OVER (PARTITION BY r.code, r.hint
        ORDER BY CASE WHEN e.catalog = r.hint THEN 0 ELSE 1 END, e.place, e.ordinal) AS rn
      FROM (SELECT DISTINCT code, hint FROM requests) r LEFT JOIN everything e ON e.code = r.code""",
) + """
SELECT r.order_key, r.line_no, r.code, r.hint, coalesce(k.catalog, '') AS catalog, coalesce(k.name, '') AS name
FROM requests r JOIN ranked k USING (code, hint) WHERE rn = 1
"""
ORACLES["orphans_anti"] = ctes("manifest", "products") + """
SELECT barcode, image FROM manifest WHERE barcode = '' OR barcode NOT IN (SELECT barcode FROM products WHERE barcode <> '')
"""
ORACLES["used_dims_semi"] = "SELECT DISTINCT p_brand AS brand, 'The ' || p_brand AS brand_label FROM part"
SALES = """SELECT l_partkey AS ordinal, sum(l_quantity) AS quantity, p_name AS name, p_brand AS brand
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"""
ORACLES["top10_overall"] = ctes(sales=SALES) + "SELECT * FROM sales ORDER BY quantity DESC, ordinal LIMIT 10"
ORACLES["top1_per_brand"] = ctes(sales=SALES) + """
SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY brand ORDER BY quantity DESC, ordinal) = 1
"""
ORACLES["ranked_list_join"] = ctes(
    "products",
    sales=SALES,
    ranked="SELECT ordinal, row_number() OVER (ORDER BY quantity DESC, ordinal) AS rank FROM sales QUALIFY rank <= 10",
) + """
SELECT cast(r.rank AS integer) AS rank, p.barcode, p.ordinal, p.name
FROM ranked r JOIN products p ON p.barcode = lpad(cast(r.ordinal AS varchar), 13, '0') WHERE r.ordinal % 3 <> 0
"""
ORACLES["worklist"] = REVIEW + """
SELECT ordinal, 'missing' AS mode FROM verdicts WHERE i1 IS NULL AND k2 IS NULL
UNION ALL SELECT ordinal, 'force' FROM verdicts WHERE i1 IS NULL
UNION ALL SELECT ordinal, 'flagged' FROM verdicts WHERE why <> ''
UNION ALL SELECT ordinal, 'has-image' FROM verdicts WHERE i1 IS NOT NULL OR i2 IS NOT NULL
"""

# --- matching by comparing every pair ---------------------------------------


def token_list(col: str, stop, min_len: int = 2) -> str:
    words = f"string_split(trim(regexp_replace(replace(strip_accents(lower({col})), 'ς', 'σ'), '[^a-z0-9_α-ω]+', ' ', 'g')), ' ')"
    out = f"list_distinct(list_filter({words}, lambda t: length(t) >= {min_len}))"
    if stop:
        out = f"list_filter({out}, lambda t: NOT list_contains([{', '.join(lit(s.replace('ς', 'σ')) for s in stop)}], t))"
    return out


def number_unit(col: str, pattern: str) -> str:
    return f"regexp_extract(lower({col}), {lit(pattern)}, 1) || regexp_extract(lower({col}), {lit(pattern)}, 2)"


SIZE_RE = rf"\b(\d{{1,4}})\s?({UNITS})\b"
DOSE_RE = r"\b(\d{1,5})\s?(mg|mcg|iu|gr|g|ml|caps|tabs|sachets|billion)\b"
COUNT_RE = r"(?:x\s*)?(\d{2,4})\s*(caps|tabs|tablets|sachets)?\b"


def every_pair(measures: str, promo: str, keep: str) -> dict[str, str]:
    """Scores of all pairs of l and r, then the best per left row."""
    return {
        "pairs": f"""SELECT l.ordinal AS lid, r.ordinal AS ord, 2.0 * len(list_intersect(l.tok, r.tok))
           + 0.5 * len(list_intersect(l.tok, r.utok)) + {measures} + {promo} AS score FROM l, r""",
        "best": f"""SELECT * FROM (SELECT lid, ord, score,
            row_number() OVER (PARTITION BY lid ORDER BY score DESC, ord) AS rank FROM pairs {keep}) t""",
    }


def two_measures(name: str, equal: str, unequal: str) -> str:
    return f"CASE WHEN l.{name} = '' OR r.{name} = '' THEN 0 WHEN l.{name} = r.{name} THEN {equal} ELSE {unequal} END"


BY_SIZE = dict(
    l=f"""SELECT ordinal, {token_list('name', SIZE_STOP_WORDS)} AS tok, {number_unit('name', SIZE_RE)} AS size,
       regexp_matches(lower(name), 'δωρο|δώρο') AS promo FROM supplier_list""",
    r0=f"""SELECT *, {token_list('name', SIZE_STOP_WORDS)} AS tok, {token_list('url', SIZE_STOP_WORDS)} AS utok0 FROM site_list""",
    r=f"""SELECT ordinal, tok, list_filter(utok0, lambda t: NOT list_contains(tok, t)) AS utok, {number_unit('name', SIZE_RE)} AS size,
       section = 'proionta-prosfores' OR contains(url, 'doro') AS promo FROM r0""",
)
SIZE_SCORE = two_measures("size", "3", "-1")
PROMO_SCORE = "CASE WHEN r.promo AND l.promo THEN 2 WHEN r.promo THEN -3 ELSE 0 END"
SIZE_MATCH = ctes("supplier_list", "site_list", **BY_SIZE, **every_pair(SIZE_SCORE, PROMO_SCORE, "WHERE score >= 3"))
ANY_MATCH = ctes("supplier_list", "site_list", **BY_SIZE, **every_pair(SIZE_SCORE, PROMO_SCORE, ""))
BAND = "CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'review' ELSE 'skip' END"
ORACLES["fuzzy_match_size"] = SIZE_MATCH + f"""
SELECT b.lid AS ordinal, b.ord AS site_ordinal, s.name AS site_name, s.url AS site_url, cast(score AS double) AS score, {BAND} AS band
FROM best b JOIN site_list s ON s.ordinal = b.ord WHERE rank = 1
"""
ORACLES["match_bands"] = ANY_MATCH + f"SELECT {BAND} AS band, count(*) AS n FROM best WHERE rank = 1 GROUP BY ALL"
ORACLES["best_candidate"] = ANY_MATCH + (
    "SELECT lid AS ordinal, ord AS site_ordinal, cast(score AS double) AS score FROM best WHERE rank = 1"
)
ORACLES["top3_candidates"] = ANY_MATCH + (
    "SELECT lid AS ordinal, cast(rank AS integer) AS rank, ord AS site_ordinal, cast(score AS double) AS score FROM best WHERE rank <= 3"
)
ORACLES["fuzzy_match_dose"] = ctes(
    "supplier_doses",
    "site_doses",
    l=f"""SELECT ordinal, {token_list('name', DOSE_STOP_WORDS)} AS tok, {number_unit('name', DOSE_RE)} AS dose,
       {number_unit('name', COUNT_RE)} AS cnt FROM supplier_doses""",
    r0=f"SELECT *, {token_list('name', DOSE_STOP_WORDS)} AS tok, {token_list('url', DOSE_STOP_WORDS)} AS utok0 FROM site_doses",
    r=f"""SELECT ordinal, tok, list_filter(utok0, lambda t: NOT list_contains(tok, t)) AS utok, {number_unit('name', DOSE_RE)} AS dose,
       {number_unit('name', COUNT_RE)} AS cnt FROM r0""",
    **every_pair(two_measures("dose", "3", "-1"), two_measures("cnt", "2", "0"), "WHERE score >= 3"),
) + "SELECT lid AS ordinal, ord AS site_ordinal, cast(score AS double) AS score FROM best WHERE rank = 1"


def rewrite(col: str, rules) -> str:
    out = col
    for pattern, new in rules:
        out = f"regexp_replace({out}, {lit('(?i)' + pattern)}, {lit(new)}, 'g')"
    return out


# lookahead does not exist here; the two rules that use it are written without
PLAIN_RULES = [(p.replace("(?!ACT)", "").replace("(?!CH)", ""), n) for p, n in ABBREVIATIONS]


def expanded(col: str) -> str:
    out = rewrite(col, PLAIN_RULES)
    out = rf"regexp_replace({out}, {lit('(?i)' + CONTAINER_CODE)}, '\1\2', 'g')"
    return squash(f"regexp_replace({out}, {lit('(?i)' + REGION_TOKENS)}, '', 'g')")


def plain_words(col: str, kept: str, min_len: int) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace({col}, '[^{kept}]+', ' ', 'g')), ' '), lambda t: length(t) >= {min_len}))"


PATH = r"regexp_replace(regexp_replace(lower(url), '^https?://[^/]+', ''), '[?#].*$', '')"
URL_WORDS = dict(
    r0=f"""SELECT url_ordinal AS ordinal, {plain_words(f"string_split({PATH}, '/')[-1]", 'a-z0-9', 1)} AS tok,
       {plain_words(PATH, 'a-z0-9', 1)} AS utok0 FROM site_urls""",
    r="SELECT ordinal, tok, list_filter(utok0, lambda t: NOT list_contains(tok, t)) AS utok FROM r0",
)
ORACLES["slug_match"] = ctes(
    "products",
    "site_urls",
    l0=f"SELECT ordinal, lower({expanded('raw_name')} || ' ' || line) AS txt FROM products",
    l=f"SELECT ordinal, {plain_words('txt', 'a-z0-9', 3)} AS tok FROM l0",
    **URL_WORDS,
    **every_pair("0", "0", "WHERE score >= 4"),
) + "SELECT lid AS ordinal, ord AS url_ordinal, cast(score AS double) AS score FROM best WHERE rank = 1"


def roman(col: str) -> str:
    one = f"translate({col}, {lit(ROMAN_ONE_TO_ONE[0])}, {lit(ROMAN_ONE_TO_ONE[1])})"
    return f"replace(replace(replace({one}, 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps')"


def greek_tokens(source: str, text: str) -> dict[str, str]:
    return dict(
        l0=f"SELECT ordinal, {plain_words(f'''replace(strip_accents(lower({text})), 'ς', 'σ')''', 'a-z0-9α-ω', 3)} AS g FROM {source}",
        l=f"""SELECT ordinal, list_distinct(list_concat(g, list_filter(list_transform(g, lambda t: {roman('t')}),
            lambda t: length(t) >= 3))) AS tok FROM l0""",
        **URL_WORDS,
        **every_pair("0", "0", "WHERE score >= 4"),
    )


ORACLES["slug_match_translit"] = ctes("greek_products", "site_urls", **greek_tokens("greek_products", "name || ' ' || line")) + (
    "SELECT lid AS ordinal, ord AS url_ordinal, cast(score AS double) AS score FROM best WHERE rank = 1"
)
ORACLES["two_stage_refine"] = ctes(
    "products",
    "hits",
    "site_urls",
    found="SELECT p.ordinal, p.barcode, p.line, h.name AS canonical, h.url AS hit_url FROM products p JOIN hits h ON h.barcode = p.barcode WHERE p.barcode <> ''",
    **greek_tokens("found", "canonical || ' ' || line"),
) + """
SELECT f.ordinal, f.barcode, f.canonical, coalesce(u.url, f.hit_url) AS url,
  CASE WHEN u.url IS NULL THEN 'hit' ELSE 'brand' END AS source, cast(coalesce(b.score, 0) AS double) AS score
FROM found f LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON b.lid = f.ordinal LEFT JOIN site_urls u ON u.url_ordinal = b.ord
"""

# --- aggregations -----------------------------------------------------------

ORACLES["facet_counts"] = ctes("products") + (
    "SELECT brand, cast(replace(brand, 'Brand#', '') AS integer) AS position, count(*) AS n FROM products GROUP BY brand"
)
ORACLES["facet_by_size"] = ctes("products") + "SELECT line, count(*) AS n, min(ordinal) AS first_seen FROM products GROUP BY line"
TREE = """
SELECT brand, '*' AS line, 1 AS level, count(*) AS n FROM found GROUP BY brand
UNION ALL SELECT brand, line, 2, count(*) FROM found GROUP BY brand, line
UNION ALL SELECT '*', '*', 0, count(*) FROM found
"""
ORACLES["facet_tree"] = ctes("products", found="SELECT * FROM products") + TREE
ORACLES["search_counts"] = ctes(
    "products", found="SELECT * FROM products WHERE lower(name || ' ' || raw_name || ' ' || line || ' ' || barcode) LIKE '%ring%'"
) + TREE
ORACLES["search_terms"] = """
WITH terms AS (
  SELECT 'item ' || item_id AS term_id, substring(text, 1 + length(text) % 40, 4 + length(text) % 9) AS term FROM benchmark
  UNION ALL SELECT 'region ' || r_regionkey, substring(r_name, 1, 1 + r_regionkey % 2) || ' ' FROM region
  UNION ALL SELECT 'nation ' || n_nationkey, n_name FROM nation)
SELECT DISTINCT term_id, term, doc_id FROM terms JOIN documents ON contains(lower(coalesce(text, '')), trim(lower(term)))
"""
ORACLES["reason_counts"] = TEXTS + (
    "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(why, '|')) AS reason FROM verdicts WHERE why <> '') t GROUP BY reason"
)
ORACLES["quality_totals"] = TEXTS + TOTALS
ORACLES["brand_stats"] = ctes("products") + "SELECT brand, count(*) AS n, count(DISTINCT line) AS n_lines FROM products GROUP BY brand"

# --- windows, top-k ---------------------------------------------------------

ORACLES["related_items"] = ctes(
    "products",
    grouped="SELECT ordinal, name, CASE WHEN line <> 'SMALL' THEN line END AS section FROM products",
    numbered="SELECT *, row_number() OVER (PARTITION BY section ORDER BY ordinal) AS rn FROM grouped",
) + """
SELECT a.ordinal, cast(row_number() OVER (PARTITION BY a.ordinal ORDER BY b.ordinal) AS integer) AS rank,
  b.ordinal AS related, b.name AS related_name
FROM grouped a JOIN numbered b ON a.section IS NOT DISTINCT FROM b.section AND a.ordinal <> b.ordinal AND b.rn <= 7
QUALIFY rank <= 6
"""
ORACLES["related_fill"] = ctes("products") + """
SELECT a.ordinal, cast(row_number() OVER (PARTITION BY a.ordinal ORDER BY a.line <> b.line, b.ordinal) AS integer) AS rank,
  b.ordinal AS related, b.name AS related_name
FROM products a JOIN products b ON a.brand = b.brand AND a.ordinal <> b.ordinal
QUALIFY rank <= 6
"""
ORACLES["pick_by_source"] = ctes("texts") + """
SELECT product, doc_id, host, host_rank FROM (SELECT product, doc_id, host,
    CASE host WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src7' THEN 2 WHEN 'src12' THEN 3 ELSE 10 END AS host_rank
  FROM texts WHERE length(coalesce(body, '')) >= 100) t
QUALIFY row_number() OVER (PARTITION BY product ORDER BY host_rank, doc_id) = 1
"""
ORACLES["pick_by_quality"] = ctes(
    "texts",
    **verdict("texts", "doc_id", "body"),
    scored="""SELECT product, doc_id, CASE WHEN s = '' THEN 0 ELSE least(len, 500) / 100.0
        - CASE WHEN contains(why, 'pharmacy-fluff') THEN 5 ELSE 0 END
        - CASE WHEN contains(why, 'english-only') THEN 3 ELSE 0 END
        - CASE WHEN contains(why, 'truncated') THEN 1 ELSE 0 END END AS score FROM verdicts""",
) + """
SELECT product, doc_id, cast(round(score, 2) AS double) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY product ORDER BY CASE WHEN score >= 3 THEN doc_id END NULLS LAST, score DESC, doc_id) = 1
"""
ORACLES["rank_urls"] = ctes(parts=URL_PARTS) + """
SELECT page_id, coalesce(segs[1], 'diafora') AS section, url, cast(row_number() OVER (PARTITION BY coalesce(segs[1], 'diafora')
  ORDER BY CASE WHEN contains(url, '.net') THEN 0 ELSE 1 END, page_id) AS integer) AS rank FROM parts
"""
ORACLES["sorted_lines"] = ctes("products") + "SELECT DISTINCT brand, line FROM products"
ORACLES["limit_ordered"] = ctes("products") + "SELECT ordinal, barcode, name FROM products WHERE barcode <> '' ORDER BY ordinal LIMIT 25"

# --- set operations ---------------------------------------------------------

ORACLES["catalog_union"] = ctes("catalog_a", "catalog_b", "catalog_c") + """
SELECT 'a' AS catalog, ordinal, barcode, name FROM catalog_a
UNION ALL SELECT 'b', ordinal, barcode, name FROM catalog_b
UNION ALL SELECT 'c', ordinal, '-', name FROM catalog_c
"""
ORACLES["dedupe_first"] = ctes("products") + """
SELECT name, min(ordinal) AS ordinal, arg_min(brand, ordinal) AS brand, cast(arg_min(price, ordinal) AS double) AS price
FROM products GROUP BY name
"""
ORACLES["upsert_last"] = ctes("manifest", "manifest_changes") + """
SELECT barcode, image, version FROM (SELECT *, 1 AS late FROM manifest_changes UNION ALL SELECT *, 0 AS late FROM manifest) t
QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY version DESC, late DESC, image) = 1
"""
ORACLES["classify_membership"] = ctes("manifest", "catalog_a", "catalog_b") + """
SELECT barcode, CASE WHEN barcode IN (SELECT barcode FROM catalog_a) THEN 'a'
  WHEN barcode IN (SELECT barcode FROM catalog_b) THEN 'b' ELSE 'orphan' END AS owner FROM manifest
"""
ORACLES["catalog_overlap"] = ctes("catalog_a", "catalog_b") + """
SELECT barcode FROM catalog_a WHERE barcode <> '' INTERSECT SELECT barcode FROM catalog_b
"""

# --- text jobs --------------------------------------------------------------


def label_list(rules, col: str = "title") -> str:
    marks = []
    for label, yes, no in rules:
        test = ilike(col, yes) + (f" AND NOT {ilike(col, no)}" if no else "")
        marks.append(f"CASE WHEN {test} THEN {lit(label)} END")
    return f"list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL)"


VOLUME = r"(?i)(\d+(?:[.,]\d+)?)\s*(ml|gr|g)\b"
ATTRIBUTES = f"""SELECT ordinal, brand, line, regexp_extract(title, '(?i)SPF\\s*(\\d+\\+?)', 1) AS spf,
  regexp_extract(title, {lit(VOLUME)}, 1) || lower(regexp_extract(title, {lit(VOLUME)}, 2)) AS volume,
  {label_list(TYPE_LABELS)} AS types, {label_list(AUDIENCE_LABELS)} AS audience, {label_list(AREA_LABELS)} AS areas,
  {ilike('title', PROMO_NAME)} AS is_promo, contains(title, 'ΝΕΟ') OR {ilike('title', r'\bnew\b')} AS is_new FROM titles"""
ORACLES["attribute_table"] = ctes("titles", attrs=ATTRIBUTES) + """
SELECT ordinal, spf, volume, array_to_string(types, '|') AS types, array_to_string(audience, '|') AS audience,
  array_to_string(areas, '|') AS areas, is_promo, is_new FROM attrs
"""
ORACLES["attribute_facets"] = ctes("titles", attrs=ATTRIBUTES) + """
SELECT brand, label, count(*) AS n
FROM (SELECT brand, unnest(list_concat(list_concat(types, audience), areas)) AS label FROM attrs) t GROUP BY ALL
"""
ORACLES["normalize_names"] = ctes(
    "products",
    bare=f"""SELECT ordinal, raw_name, lower(trim(regexp_replace({squash('raw_name')}, {lit('(?i)(\\s+(' + '|'.join(LOCALES) + '))+$')}, ''))) AS b
      FROM products""",
) + f"""
SELECT ordinal, array_to_string(list_transform(regexp_extract_all(b, '[a-z0-9_]+|[^a-z0-9_]+'), lambda w:
    CASE WHEN w IN ({', '.join(lit(k) for k in KEPT_CAPITALS)}) THEN upper(w)
      WHEN regexp_matches(w, '^[a-z]+$') THEN upper(w[1]) || w[2:] ELSE w END), '') AS clean_name,
  'Shelf ' || array_to_string(list_transform(regexp_extract_all(raw_name, '[A-Z]{{2,}}|[^A-Z]+|[A-Z]'), lambda r:
    CASE WHEN regexp_matches(r, '^[A-Z]{{2,}}$') THEN r[1] || lower(r[2:]) ELSE r END), '') AS brand_name
FROM bare
"""
ORACLES["expand_abbrev"] = ctes("codes", e=f"SELECT ordinal, line, {expanded('raw')} AS x FROM codes") + r"""
SELECT ordinal, CASE WHEN regexp_matches(x, '(?i)\b' || line || '\b') THEN x ELSE line || ' ' || x END AS expanded FROM e
"""
SLUG = r"""regexp_replace(left(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(replace(
  regexp_replace(strip_accents(title), '[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]', ' ', 'g'), '+', ''), '[/\\]', '-', 'g'),
  '[^\w\s-]', ' ', 'g')), '[\s-]+', '-', 'g'), '^-|-$', '', 'g'), 90), '-+$', '')"""
SLUGS = f"SELECT ordinal, {SLUG} AS slug FROM titles"
ORACLES["slug_keys"] = ctes("titles") + SLUGS
ORACLES["slug_collisions"] = ctes("titles", slugs=SLUGS) + (
    "SELECT slug, count(*) AS n, min(ordinal) AS first_seen FROM slugs GROUP BY slug HAVING count(*) > 1"
)
ORACLES["template_text"] = ctes("titles", attrs=ATTRIBUTES) + """
SELECT ordinal, concat_ws(' ', 'From The ' || brand || '.',
  CASE WHEN spf = '' THEN NULL WHEN cast(replace(spf, '+', '') AS integer) >= 50
      THEN 'Very high sun protection (SPF ' || spf || ') against UVB and UVA.'
    WHEN cast(replace(spf, '+', '') AS integer) >= 30 THEN 'High sun protection (SPF ' || spf || ').'
    ELSE 'Sun protection SPF ' || spf || '.' END,
  CASE WHEN len(types) > 0 THEN 'Texture ' || lower(array_to_string(types, ' / '))
      || CASE WHEN volume <> '' THEN ', pack of ' || volume ELSE '' END || '.'
    WHEN volume <> '' THEN 'Pack of ' || volume || '.' END,
  CASE WHEN list_contains(audience, 'Παιδικό') THEN 'Suited for children.' END,
  CASE WHEN list_contains(audience, 'Sport') THEN 'Resists sweat and water.' END,
  CASE WHEN list_contains(audience, 'Anti-Aging') THEN 'Acts against ageing.' END) AS description
FROM attrs
"""
TEMPLATES = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else lit(x) for x in r) + ")" for r in template_rows()
) + ") t (catalog, section, brand, line, attribute, least, place, sentence)"
PUT_IN = "sentence"
for _name in ("brand", "line", "section", "spf", "volume", "types"):
    PUT_IN = f"CASE WHEN contains(sentence, '{{{_name}}}') THEN replace({PUT_IN}, '{{{_name}}}', nullif(trim(v_{_name}), '')) ELSE {PUT_IN} END"
ORACLES["line_descriptions"] = ctes(
    "described_products",
    attrs=f"""SELECT ordinal, catalog, section, brand, line, regexp_extract(title, '(?i)SPF\\s*(\\d+\\+?)', 1) AS v_spf,
  regexp_extract(title, {lit(VOLUME)}, 1) || lower(regexp_extract(title, {lit(VOLUME)}, 2)) AS v_volume, brand AS v_brand, line AS v_line, section AS v_section,
  lower(array_to_string({label_list(TYPE_LABELS)}, ' / ')) AS v_types, {label_list(AUDIENCE_LABELS)} AS labels FROM described_products""",
    templates=TEMPLATES,
) + f"""
, fits AS (SELECT a.ordinal, place, {PUT_IN} AS said,
    (t.catalog IS NOT NULL)::int + (t.section IS NOT NULL)::int + (t.brand IS NOT NULL)::int + (t.line IS NOT NULL)::int + (attribute IS NOT NULL)::int AS n_set,
    least, length(sentence) - length(replace(sentence, '{{', '')) AS n_named
  FROM attrs a JOIN templates t ON (t.catalog IS NULL OR t.catalog = a.catalog) AND (t.section IS NULL OR t.section = a.section)
    AND (t.brand IS NULL OR t.brand = a.brand) AND (t.line IS NULL OR t.line = a.line) AND (attribute IS NULL OR list_contains(labels, attribute))
    AND (least IS NULL OR try_cast(replace(v_spf, '+', '') AS double) >= least)),
best AS (SELECT ordinal, place, said, row_number() OVER (PARTITION BY ordinal, place ORDER BY n_set DESC, least DESC NULLS LAST, n_named DESC, said) AS r
  FROM fits WHERE said IS NOT NULL)
SELECT p.ordinal, coalesce(string_agg(said, ' ' ORDER BY place), '') AS description
FROM described_products p LEFT JOIN best b ON b.ordinal = p.ordinal AND r = 1 GROUP BY p.ordinal
"""
ORACLES["token_df"] = ctes("supplier_list") + f"""
SELECT token, count(*) AS df FROM (SELECT unnest({token_list('name', SIZE_STOP_WORDS)}) AS token FROM supplier_list) t GROUP BY token
"""
ORACLES["quality_flags"] = TEXTS + "SELECT doc_id, why = '' AS ok, why AS reasons FROM verdicts"
ORACLES["quality_audit"] = REVIEW + """
SELECT ordinal, coalesce(n1, n2, name) AS name, coalesce(src1, src2, '(none)') AS source, why AS reasons, length(coalesce(dd, '')) AS length
FROM verdicts WHERE contains(why, 'too-short')
"""

# --- page jobs: expected values straight from the product rows --------------

PAGE_ROWS = """SELECT p.ordinal, p.name, p_name, p_type, lower(p_type) AS section, lpad(cast(p.ordinal AS varchar), 13, '0') AS code,
  'https://img.example/' || lpad(cast(p.ordinal AS varchar), 13, '0') || '.jpg' AS image, p.ordinal % 7 <> 0 AS ld
  FROM products p JOIN part ON p_partkey = p.ordinal"""
RECORDS = """SELECT ordinal, section, name, 'The maker''s ' || p_name || ' & more' AS description, image,
  CASE WHEN ld THEN 'SKU-' || ordinal WHEN ordinal % 5 <> 0 THEN 'W-' || ordinal ELSE '' END AS sku,
  CASE WHEN ld THEN code ELSE '' END AS gtin FROM page_rows"""
ORACLES["page_records"] = ctes("products", page_rows=PAGE_ROWS) + RECORDS
ORACLES["jsonld_products"] = ctes("products", page_rows=PAGE_ROWS) + (
    "SELECT ordinal, name, image, 'SKU-' || ordinal AS sku, code AS gtin FROM page_rows WHERE ld"
)
ORACLES["sku_candidates"] = ctes("products", page_rows=PAGE_ROWS) + """
SELECT ordinal, 0 AS position, 'SKU-' || ordinal AS sku FROM page_rows WHERE ld
UNION ALL SELECT ordinal, CASE WHEN ld THEN 1 ELSE 0 END, 'W-' || ordinal FROM page_rows WHERE ordinal % 5 <> 0
"""
ORACLES["longest_block"] = ctes("products", page_rows=PAGE_ROWS) + """
SELECT ordinal, CASE WHEN ordinal % 6 = 0 THEN '' ELSE
  rtrim(repeat('It''s the ' || p_name || ' of the <' || p_type || '> line &amp; more. ', 4)) || chr(10) || chr(10) || 'End' || ordinal END AS block
FROM page_rows
"""
ORACLES["best_description"] = ctes("products", page_rows=PAGE_ROWS) + """
SELECT ordinal, CASE WHEN ordinal % 6 = 0 THEN rtrim(repeat('A told text of ' || name || '. ', 8)) ELSE
  rtrim(repeat('It''s the ' || p_name || ' of the <' || p_type || '> line &amp; more. ', 4)) || chr(10) || chr(10) || 'End' || ordinal END AS description
FROM page_rows
"""
ORACLES["page_subtitle"] = """
SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'The subtitle of page ' || p_partkey END AS subtitle FROM part
"""
ORACLES["extraction_coverage"] = ctes("products", page_rows=PAGE_ROWS, records=RECORDS) + """
SELECT section, count(*) AS n, count(*) AS with_name, count(*) AS with_description, count(*) AS with_image,
  count(*) FILTER (sku <> '') AS with_sku FROM records GROUP BY section
"""

SITE_RECORDS = """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Item ' || page_id ELSE '' END AS name,
  CASE WHEN page_id % 3 = 1 THEN 'Told of ' || page_id || ' & more' ELSE '' END AS description,
  (page_id % 3 = 0)::int + (page_id % 2 = 0)::int AS n_skus, coalesce(segs[1], 'diafora') AS section,
  CASE WHEN page_id % 3 = 0 THEN 'S-' || page_id WHEN page_id % 2 = 0 THEN 'W-' || page_id ELSE '' END AS sku,
  CASE WHEN page_id % 3 = 0 THEN lpad(cast(page_id AS varchar), 13, '0') ELSE '' END AS gtin FROM parts"""
ORACLES["site_records"] = ctes(parts=URL_PARTS) + SITE_RECORDS
ORACLES["site_coverage"] = ctes(parts=URL_PARTS, records=SITE_RECORDS) + """
SELECT section, count(*) AS n, count(*) FILTER (name <> '') AS with_name, count(*) FILTER (description <> '') AS with_description,
  0::bigint AS with_image, count(*) FILTER (sku <> '') AS with_sku FROM records GROUP BY section
"""
ORACLES["site_blocks"] = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE rtrim(repeat('About item ' || page_id || '. ', 20)) END AS block FROM pages"""


def decoded(col: str) -> str:
    for entity, char in ENTITIES:
        col = f"replace({col}, {lit(entity)}, {lit(char)})"
    return f"replace({col}, '&amp;', '&')"


ORACLES["page_links"] = ctes(
    parts=URL_PARTS,
    links=f"""SELECT DISTINCT page_id, host, regexp_extract(url, '^https?://[^/?#]+') || {decoded('href')} AS link
      FROM (SELECT page_id, host, url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#]+)["'']', 1)) AS href FROM parts) t
      UNION SELECT page_id, host, regexp_extract(url, '^https?://[^?#]+') || '?page=' || page_id % 3 FROM parts
      UNION SELECT page_id, host, CASE WHEN regexp_matches(bare, '^https?://[^/]+/[^/]*$') THEN regexp_extract(bare, '^https?://[^/]+/')
        ELSE regexp_replace(bare, '[^/]+/[^/]*$', '') END || 'up/x' FROM (SELECT *, regexp_extract(url, '^https?://[^?#]+') AS bare FROM parts) b
      UNION SELECT page_id, host, regexp_replace(regexp_extract(url, '^https?://[^?#]+'), '[^/]*$', '') || 'there' FROM parts""",
    slugs="SELECT *, list_filter(string_split(regexp_replace(regexp_replace(lower(link), '^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda s: s <> '') AS segs2 FROM links",
) + rf"""
SELECT page_id, host, link, regexp_matches(link, '[?&](p|page)=\d+') AS is_paged, CASE
  WHEN regexp_matches(lower(link), 'sitemap|robots|\.xml(\?|$)') THEN 'machine'
  WHEN regexp_matches(lower(link), '/({'|'.join(REJECTED)})(/|$)') THEN 'rejected'
  WHEN len(segs2) < 1 THEN 'shallow'
  WHEN length(segs2[-1]) > 15 AND contains(segs2[-1], '-') THEN 'long-slug' ELSE 'other' END AS verdict
FROM slugs
"""
STRIPPED = "html"
for _pattern, _new in (
    (r"(?is)<script.*?</script>", "''"),
    (r"(?is)<style.*?</style>", "''"),
    (r"(?i)<br\s*/?>", "chr(10)"),
    (r"(?i)</p>", "chr(10) || chr(10)"),
    (r"(?i)</(div|li|h[1-6]|tr|blockquote)>", "chr(10)"),
    (r"<[^>]+>", "''"),
):
    STRIPPED = f"regexp_replace({STRIPPED}, {lit(_pattern)}, {_new}, 'g')"
ORACLES["html_text"] = rf"""
SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace({decoded(STRIPPED)}, chr(13), ''), chr(10)),
  lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
FROM pages
"""
ORACLES["url_keys"] = ctes(parts=URL_PARTS) + r"""
SELECT host, coalesce(segs[1], 'diafora') AS section, count(*) AS n,
  count(*) FILTER (regexp_matches(url, '-(\d{8,14})\.html([?#]|$)')) AS with_code FROM parts GROUP BY ALL
"""
ORACLES["incremental_ingest"] = ctes(parts=URL_PARTS) + """
SELECT page_id, host, url, nullif(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '') AS title, length(html) AS size
FROM parts QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 2, page_id) = 1
"""

# pages are numbers here: n leads to 0, 2 n + 1 and 2 n + 2, and to n + 4 if 4 divides n; a walk
# of more rounds than there are pages can find nothing new
ORACLES["page_reach"] = """
WITH RECURSIVE links AS (
  SELECT page_id AS source, unnest([0, page_id * 2 + 1, page_id * 2 + 2, CASE WHEN page_id % 4 = 0 THEN page_id + 4 END]) AS target,
    unnest([1, 1, 1, 2]) AS kind FROM pages),
edges AS (SELECT DISTINCT source, target FROM links JOIN pages ON page_id = target WHERE target % 11 <> 3 OR kind = 2),
walk(page_id, section, depth) USING KEY (page_id) AS (
  SELECT page_id, 'section ' || page_id, 0 FROM pages WHERE page_id = 0 OR page_id % 97 = 5
  UNION
  SELECT e.target, min(w.section), min(w.depth) + 1 FROM walk w JOIN edges e ON e.source = w.page_id
    LEFT JOIN recurring.walk k ON k.page_id = e.target WHERE k.page_id IS NULL GROUP BY e.target)
SELECT page_id, section, depth FROM pages LEFT JOIN walk USING (page_id)
"""

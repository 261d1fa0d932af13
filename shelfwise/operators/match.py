"""Matching names to site rows and products to page URLs.

The rows are turned into features here; the join itself is ``score_join``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import urls
from shelfwise.functions.text import (
    expand_name,
    fold,
    regex,
    romanize,
    tokens,
    words,
)
from shelfwise.operators.score_join import HOT_FEATURE_ROWS, Measure, Weights, score_join
from shelfwise.plans.skew import compute_once, keyed_lookup, stage, top_n

# Units, stop words and scores of the two name matchers.
UNITS = "ml|gr|g|kg|l|iu|mg|caps|tabs|tablets|patch|φακελ|x\\d+|shots|τσιπς|amp|amps"
SIZE = Measure("size", rf"\b(\d{{1,4}})\s?({UNITS})\b", 3.0, -1.0)
DOSE = Measure("dose", r"\b(\d{1,5})\s?(mg|mcg|iu|gr|g|ml|caps|tabs|sachets|billion)\b", 3.0, -1.0)
COUNT = Measure("count", r"(?:x\s*)?(\d{2,4})\s*(caps|tabs|tablets|sachets)?\b", 2.0)
SIZE_STOP_WORDS = tuple(
    (
        "cream krema κρεμα cr gel τζελ lotion λοσιον spray foam wash shampoo σαμπουαν sh shower "
        "mask μασκα serum ορος the και of for gia με για 50ml 100ml 150ml 200ml 250ml 300ml 500ml "
        "1000ml ml gr kg mg iu l ρευστο λευκο μαυρο moisturizing moisture rich plus care aid extra "
        "pro active kit set step day night eye face body hand δωρο δειγμα επιπλεον ποσοτητα "
        "νεσεσερ ειδικη συσκευασια σε en fr es pt de it nl pl ro el"
    ).split()
)
DOSE_STOP_WORDS = tuple(
    (
        "tabs tab caps cap capsules sachets χαπια gr mg mcg iu ml kg l και με για σε extra plus "
        "complex advanced pro active en fr es pt de it nl pl ro el"
    ).split()
)


@dataclass(frozen=True)
class MatchConfig:
    weights: Weights
    stop_words: tuple[str, ...] = ()
    left_promo: str | None = None
    right_promo: str | None = None
    url_promo: str | None = None
    promo_sections: tuple[str, ...] = ()
    min_score: float = 3.0
    high_score: float = 6.0
    hot_rows: int = HOT_FEATURE_ROWS


BY_SIZE = MatchConfig(
    Weights(measures=(SIZE,), promo_only_right=-3.0, promo_both=2.0),
    SIZE_STOP_WORDS,
    left_promo="δωρο|δώρο|νεσεσερ|νεσσεσαιρ|επιπλεον|δειγμα",
    right_promo="δωρο|δώρο",
    url_promo="δωρο|doro",
    promo_sections=("proionta-prosfores",),
)
BY_DOSE = MatchConfig(Weights(measures=(DOSE, COUNT)), DOSE_STOP_WORDS)
SLUG_MIN_SCORE = 4.0


def measure(col: Column, m: Measure) -> Column:
    """First number with its unit, ``''`` if there is none."""
    low, pattern = F.lower(F.coalesce(col, F.lit(""))), regex(m.pattern)
    return F.concat(F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2))


def _flag(col: Column, pattern: str | None) -> Column:
    if not pattern:
        return F.lit(False)
    return F.lower(F.coalesce(col, F.lit(""))).rlike(regex(pattern))


def _measures(col: Column, cfg: MatchConfig) -> Column:
    found = [measure(col, m) for m in cfg.weights.measures]
    return F.array(*found) if found else F.array().cast("array<string>")


def left_features(df: DataFrame, id_col: str, name: str, cfg: MatchConfig) -> DataFrame:
    return df.select(
        F.col(id_col).alias("lid"),
        tokens(F.col(name), cfg.stop_words).alias("tokens"),
        _measures(F.col(name), cfg).alias("ms"),
        _flag(F.col(name), cfg.left_promo).alias("promo"),
    )


def right_features(df: DataFrame, ordinal: str, name: str, url: str, section: str | None, cfg: MatchConfig) -> DataFrame:
    promo = _flag(F.col(name), cfg.right_promo) | _flag(F.col(url), cfg.url_promo)
    if section and cfg.promo_sections:
        promo = promo | F.coalesce(F.col(section).isin(*cfg.promo_sections), F.lit(False))
    strong = tokens(F.col(name), cfg.stop_words)
    return df.select(
        F.col(ordinal).alias("ord"),
        strong.alias("strong"),
        F.array_except(tokens(F.col(url), cfg.stop_words), strong).alias("weak"),
        _measures(F.col(name), cfg).alias("ms"),
        promo.alias("promo"),
    )


def fuzzy_match(
    left: DataFrame,
    right: DataFrame,
    cfg: MatchConfig,
    n: int = 1,
    floor: float | None = -1.0,
    left_cols: Sequence[str] = ("ordinal", "name"),
    right_cols: Sequence[str | None] = ("ordinal", "name", "url", "section"),
) -> DataFrame:
    """Supplier rows to site rows by name. ``floor=None`` keeps any best score;
    by default the configured minimum applies."""
    floor = cfg.min_score if floor == -1.0 else floor
    return score_join(
        left_features(left, *left_cols, cfg),
        right_features(right, *right_cols, cfg),
        cfg.weights,
        n,
        floor,
        cfg.hot_rows,
    )


def band(score: Column, cfg: MatchConfig) -> Column:
    """``high``, ``review`` or ``skip``."""
    return (
        F.when(score >= cfg.high_score, F.lit("high"))
        .when(score >= cfg.min_score, F.lit("review"))
        .otherwise(F.lit("skip"))
    )


def with_right(matches: DataFrame, right: DataFrame, fields: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Fields of the matched right row; a much-matched row is spread."""
    looked = right.select(F.col(ordinal).alias("ord"), *[F.col(f).alias(f"site_{f}") for f in fields])
    return keyed_lookup(stage(matches, "matches"), looked, "ord", "lid", "left")


def slug_match(
    products: DataFrame,
    urls_df: DataFrame,
    name: str,
    line: str | None = None,
    transliterate: bool = False,
    expand: bool = True,
    min_score: float = SLUG_MIN_SCORE,
    n: int = 1,
    id_col: str = "ordinal",
    url: str = "url",
    url_order: str = "url_ordinal",
    hot_rows: int = HOT_FEATURE_ROWS,
) -> DataFrame:
    """Products to page URLs: keyword in the last path segment counts 2, elsewhere
    in the path 0.5. With ``transliterate`` Greek words are also tried in Latin."""
    text = F.coalesce(F.col(name), F.lit(""))
    if expand:
        text = expand_name(text)
    if line:
        text = F.concat_ws(" ", text, F.col(line))
    if transliterate:
        plain = words(fold(text), "a-z0-9α-ω", 3)
        keys = F.array_distinct(F.concat(plain, F.filter(F.transform(plain, romanize), lambda t: F.length(t) >= 3)))
        kept = "a-z0-9α-ω"
    else:
        keys = words(F.lower(text), "a-z0-9", 3)
        kept = "a-z0-9"
    none = F.array().cast("array<string>")
    left = products.select(F.col(id_col).alias("lid"), keys.alias("tokens"), none.alias("ms"), F.lit(False).alias("promo"))
    fix = fold if transliterate else F.lower
    strong = words(fix(urls.last_segment(F.col(url))), kept, 1)
    weak = F.array_except(words(fix(urls.path(F.col(url))), kept, 1), strong)
    right = urls_df.select(
        F.col(url_order).alias("ord"), strong.alias("strong"), weak.alias("weak"), none.alias("ms"), F.lit(False).alias("promo")
    )
    return score_join(left, right, Weights(), n, min_score, hot_rows)


def two_stage(
    products: DataFrame,
    hits: DataFrame,
    urls_df: DataFrame,
    key: str = "barcode",
    line: str | None = "line",
    ordinal: str = "ordinal",
) -> DataFrame:
    """Canonical record by code, then the brand page that fits its name; where no
    page reaches the threshold the canonical record itself is kept.

    ``hits``: one row per key with name and url.
    """
    hit = hits.select(key, F.col("name").alias("canonical"), F.col("url").alias("hit_url"))
    found = stage(keyed_lookup(products.where(F.col(key) != ""), hit, key, ordinal, "inner"), "hits")
    pages = with_right(
        slug_match(found, urls_df, "canonical", line, transliterate=True, expand=False, id_col=ordinal),
        urls_df,
        ["url"],
        "url_ordinal",
    ).select(F.col("lid").alias(ordinal), "score", "site_url")
    joined = found.join(pages, ordinal, "left")
    return joined.select(
        ordinal,
        key,
        "canonical",
        F.coalesce("site_url", "hit_url").alias("url"),
        F.when(F.col("site_url").isNotNull(), F.lit("brand")).otherwise(F.lit("hit")).alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def best_per_key(pairs: DataFrame, key: str, score: str = "score", ordinal: str = "ord") -> DataFrame:
    """Best candidate of an explicit pair table; ties go to the earlier row."""
    return top_n(pairs, [key], [F.desc(score), F.col(ordinal)])


def top_n_per_key(pairs: DataFrame, key: str, n: int, score: str = "score", ordinal: str = "ord") -> DataFrame:
    return top_n(pairs, [key], [F.desc(score), F.col(ordinal)], n, "rank")


def token_frequencies(df: DataFrame, name: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Rows per token, counted per task before the shuffle."""
    return (
        compute_once(df, _tokens=tokens(F.col(name), stop_words))
        .select(F.explode("_tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


# Day / night words of names and URLs.
NAME_DAY, NAME_NIGHT = r"\bDAY\b", r"\bNIGHT\b|\bNGT\b"
URL_NIGHT = r"noapte|night|nuit|nacht|noche|notte|nattcr"
URL_DAY = r"(?<![a-z])day(?![a-z])|crema-de-zi|crema-zi|daycream|day-cream|jour"


def conflict(name: Column, url: Column) -> Column:
    """Why a candidate is the wrong variant, NULL if it is not."""
    up, low = F.upper(name), F.lower(url)
    day, night = low.rlike(URL_DAY), low.rlike(URL_NIGHT)
    return F.when(up.rlike(regex(NAME_DAY, False)) & night & ~day, F.lit("day vs night")).when(
        up.rlike(regex(NAME_NIGHT, False)) & day & ~night, F.lit("night vs day")
    )


def drop_conflicts(pairs: DataFrame, name: str, url: str) -> DataFrame:
    return pairs.where(conflict(F.col(name), F.col(url)).isNull())

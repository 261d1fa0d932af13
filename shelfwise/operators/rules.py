"""Rule lists compiled to columns: validation, exclusion, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null, regex
from shelfwise.plans.skew import compute_once

Rule = tuple[str, str]

# Ordered section rules of a supplement catalogue; order matters.
SECTION_RULES: tuple[Rule, ...] = (
    ("wmega", r"\b(omega|fish\s+oil|krill|cod\s+liver|dha|epa|flaxseed|linseed)\b"),
    ("probiotika", r"\b(probio|acidophil|bifido|biome|prebio|lactobacill)\b"),
    (
        "aminoxea",
        r"\b(carnitine|arginine|lysine|glutamine|taurine|tryptophan|htp|5-htp|creatine|bcaa|whey|methionine)\b",
    ),
    ("adynatisma", r"\b(cla|garcinia|chitosan|diet|weight|slim|water\s+shape)\b"),
    ("gynaikeia-frontida", r"\b(meno[- ]?pause|meno-|fertil|folic|pregnan|prenatal|feminex|cystoco)\b"),
    ("andrikh-frontida", r"\b(prosta|men'?s|testo|male)\b"),
    ("paidiki-frontida", r"\b(kids|children|gummies\s+for|junior|multi\s+guard\s+for\s+kids)\b"),
    (
        "ugeia-osteon",
        r"\b(glucosamine|chondroit|joint|bone|arthri|msm|collagen|calcium|magnesium|osteo)\b",
    ),
    (
        "ugeia-kardias",
        r"\b(cardio|heart|coq10|coenzyme|red\s+yeast|policosanol|garlic|hawthorn)\b",
    ),
    ("amyna-organismou", r"\b(immune|elderberry|echinacea|zinc|vitamin\s+c\s+\d)\b"),
    (
        "antigiransi",
        r"\b(retinol|resveratrol|hyalur|astaxanthin|beauty|radiance|skin|nails|hair)\b",
    ),
    ("energia", r"\b(energy|caffeine|guarana|ginseng|maca|rhodiola|siberian)\b"),
    (
        "fisika-symplirwmata",
        r"\b(ashwagand|curcumin|turmer|milk\s+thistle|ginkgo|ginger|garlic|nettle|extract|herbal|silymar|liquorice|tribulus|saw\s+palmet|black\s+cohosh|st\s+john|passifl|valer)\b",
    ),
    (
        "mineralia",
        r"\b(magnesium|calcium|zinc|iron|selenium|potassium|chromium|iodine|molybdenum|copper|manganese|multi\s+mineral)\b",
    ),
    (
        "vitamines",
        r"\b(vitamin|b[-\s]?\d{1,2}|b\s?complex|multi[- ]?guard|multi[- ]?vitamin|a-z|niacin|biotin|folate)\b",
    ),
    (
        "eidiki-diatrofh",
        r"\b(super\s+food|spirulin|chlorella|greens|barley|wheatgrass|maca|cocoa)\b",
    ),
    ("omoiopathitika", r"\b(homeo)\b"),
)
SECTION_DEFAULT = "diafora"
# Rows that are sold only as part of something else.
EXCLUSION_RULES: tuple[tuple[str, str, str], ...] = (
    ("booster-5ml", r"\bcream\s+booster\s+5\s*ml\b", "Sold only as part of a set"),
    ("promo-prefix", r"\bpromo\b", "Promo bundle"),
    ("nesecer", r"νεσεσ[εέ]ρ|νεσσε?σαιρ", "Toilet bag bundle"),
    (
        "gift-sample",
        r"δωρο\s+δειγμα|δωρο\s+extra|δωρο\s+επιπλεον|επιπλεον\s+ποσοτητα",
        "Gift sample or extra quantity",
    ),
)


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Name of the first rule whose pattern matches, else NULL."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(text.rlike(regex(p)), F.lit(name)) for name, p in rules])


def classify(df: DataFrame, text: str, rules: Sequence[Rule] = SECTION_RULES, default: str = SECTION_DEFAULT, out: str = "section") -> DataFrame:
    return df.withColumn(out, F.coalesce(first_match(F.col(text), rules), F.lit(default)))


def exclude(df: DataFrame, text: str, rules=EXCLUSION_RULES) -> DataFrame:
    """Adds ``rule`` and ``reason``; kept rows have NULL in both."""
    rule = first_match(F.col(text), [(name, pattern) for name, pattern, _ in rules])
    reason = F.coalesce(*[F.when(F.col("rule") == name, F.lit(why)) for name, _, why in rules])
    return compute_once(df, rule=rule).withColumn("reason", reason)


def kept(df: DataFrame) -> DataFrame:
    return df.where("rule is null").drop("rule", "reason")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where("rule is not null")


def breakdown(df: DataFrame) -> DataFrame:
    """Rows per exclusion rule; kept rows count under ``kept``."""
    return (
        df.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule"), F.coalesce("reason", F.lit("")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def validate(
    df: DataFrame,
    required: Sequence[str],
    price: str,
    known: tuple[str, Sequence[str]],
    vat: str | None = None,
    default_vat: int = 24,
) -> DataFrame:
    """Typed price and ``problem``: the first failed check, NULL if accepted.

    Checks in order: a required field is blank, the key is not in the known
    list, the price is no number. A decimal comma is accepted.
    """
    column, allowed = known
    typed = F.replace(F.col(price), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")
    blank = F.lit(False)
    for c in required:
        blank = blank | blank_to_null(F.trim(F.col(c))).isNull()
    problem = (
        F.when(blank, F.lit("required"))
        .when(~F.coalesce(F.trim(F.col(column)).isin(*allowed), F.lit(False)), F.lit("unknown-key"))
        .when(typed.isNull(), F.lit("price"))
    )
    out = compute_once(df, problem=problem, price_value=typed)
    if vat:
        out = out.withColumn("vat_value", F.coalesce(F.col(vat).try_cast("int"), F.lit(default_vat)))
    return out

"""Attributes read from a product name, and descriptions built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import regex

# Fixed values: (label, pattern, pattern that must not match) per label family.
TYPE_LABELS = (
    ("Spray", r"spray|σπρ[έεαά]ι|brume|spr\.", None),
    ("Γαλάκτωμα", r"lait|γαλάκτωμα|milk|lotion", None),
    ("Κρέμα-Gel", r"gel-cream|gel/cream|κρέμα-gel|cream-gel|κρεμα-gel", None),
    ("Gel", r"gel", r"gel-cream|gel/cream|κρέμα-gel|cream-gel|κρεμα-gel"),
    ("Fluid", r"fluid|fluide|λεπτόρρευστη", None),
    (
        "Κρέμα",
        r"cream|crème|crem|κρέμα|κρεμα",
        r"gel-cream|gel/cream|κρέμα-gel|cream-gel|κρεμα-gel",
    ),
    ("Mist", r"mist", None),
    ("Λάδι", r"oil|λάδι|λαδι|huile", None),
    ("Mousse", r"mousse", None),
    ("Stick", r"stick", None),
    ("Serum", r"serum", None),
    ("Foundation", r"foundation", None),
    ("Lip Balm", r"lipbalm|lip balm", None),
    ("Compact", r"compact|bb compact", None),
    ("Drops", r"drops", None),
)
AUDIENCE_LABELS = (
    ("Παιδικό", r"kids|kid|παιδικ|enfant|baby|bebé|bebe|pediatr|infant", None),
    ("Ευαίσθητο δέρμα", r"sensitive|sensib|ευαίσθητ|ευαισθητ", None),
    ("Anti-Aging", r"anti-?age|antiage|αντιγηραντικ|κατά ρυτίδων|ρυτίδ", None),
    ("Κατά πανάδων", r"spot|πανάδ|πανάδες|melas|κηλίδ|anti-?tâche", None),
    ("Λιπαρό/Μικτό", r"oil[- ]?control|oily|λιπαρ|μικτ|matte|mat\b", None),
    ("Με χρώμα", r"teint|tint|με χρώμα|color|nude touch|color cream", None),
    ("Dry Touch", r"dry touch|dry-?touch", None),
    ("Οικογενειακό", r"family|φαμιλι", None),
    ("Βρεγμένο δέρμα", r"wet skin|wetskin", None),
    ("Sport", r"sport|sportx", None),
)
AREA_LABELS = (
    (
        "Πρόσωπο",
        r"πρόσωπο|προσώπου|face",
        r"πρόσωπο & σώμα|προσώπου & σώματος|f/b|face/body",
    ),
    ("Σώμα", r"σώμα|σώματος|body", r"πρόσωπο & σώμα|προσώπου & σώματος|f/b|face/body"),
    ("Πρόσωπο & Σώμα", r"πρόσωπο & σώμα|προσώπου & σώματος|f/b|face/body", None),
    ("Μαλλιά", r"μαλλιά|hair", None),
    ("Μάτια", r"eye|μάτι|ματιών", None),
    ("Χείλη", r"lip|χείλη", None),
)
PROMO_NAME = r"promo|προσφορά|δώρο|\+δ|set\b|pack|kit"


def labels(name: Column, rules) -> Column:
    """All labels whose pattern matches, in rule order."""
    marks = []
    for label, yes, no in rules:
        hit = name.rlike(regex(yes))
        if no:
            hit = hit & ~name.rlike(regex(no))
        marks.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*marks))


def spf(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, regex(r"SPF\s*(\d+\+?)"), 1), F.lit(""))


def volume(name: Column) -> Column:
    pattern = regex(r"(\d+(?:[.,]\d+)?)\s*(ml|gr|g)\b")
    text = F.concat(
        F.regexp_extract(name, pattern, 1), F.lower(F.regexp_extract(name, pattern, 2))
    )
    return F.nullif(text, F.lit(""))


def attributes(name: Column) -> dict[str, Column]:
    return {
        "spf": spf(name),
        "volume": volume(name),
        "types": labels(name, TYPE_LABELS),
        "audience": labels(name, AUDIENCE_LABELS),
        "areas": labels(name, AREA_LABELS),
        "is_promo": name.rlike(regex(PROMO_NAME)),
        "is_new": name.contains("ΝΕΟ") | name.rlike(regex(r"\bnew\b")),
    }


def describe(intro: Column, spf_col: Column, types: Column, vol: Column, audience: Column, notes) -> Column:
    """Sentences joined by blanks; a sentence without its input is left out.

    ``notes`` is a list of (audience label, sentence).
    """
    level = F.regexp_extract(spf_col, r"^(\d+)", 1).try_cast("int")
    protection = (
        F.when(level >= 50, F.format_string("Very high sun protection (SPF %s) against UVB and UVA.", spf_col))
        .when(level >= 30, F.format_string("High sun protection (SPF %s).", spf_col))
        .when(level.isNotNull(), F.format_string("Sun protection SPF %s.", spf_col))
    )
    pack = F.when(vol.isNotNull(), F.concat(F.lit(", pack of "), vol)).otherwise(F.lit(""))
    texture = F.when(
        F.size(types) > 0,
        F.concat(F.lit("Texture "), F.lower(F.array_join(types, " / ")), pack, F.lit(".")),
    ).when(vol.isNotNull(), F.concat(F.lit("Pack of "), vol, F.lit(".")))
    extra = [F.when(F.array_contains(audience, label), F.lit(s)) for label, s in notes]
    return F.concat_ws(" ", intro, protection, texture, *extra)

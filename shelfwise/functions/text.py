"""Text expressions: folding, tokens, names, abbreviations, slugs.

Rules are plain Python data compiled to column expressions, so every text job
stays inside whole-stage code generation and needs no Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
#: ASCII word boundary; Java's own ``\b`` also sees Greek and accented letters.
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def regex(pattern: str, ignore_case: bool = True) -> str:
    r"""Java form of a rule pattern: ASCII ``\b`` and Unicode-aware case folding."""
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", BOUNDARY)


def _accent_pairs() -> tuple[str, str]:
    """Accented letters and their bases, derived from canonical decomposition."""
    src, dst = [], []
    for low, high in ((0xC0, 0x17F), (0x386, 0x3CE), (0x1F00, 0x1FFF)):
        for cp in range(low, high + 1):
            parts = unicodedata.normalize("NFD", chr(cp))
            base = "".join(p for p in parts if not unicodedata.combining(p))
            if len(parts) > 1 and len(base) == 1:
                src.append(chr(cp))
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_pairs()


def strip_accents(col: Column) -> Column:
    return F.translate(F.regexp_replace(col, "[̀-ͯ]", ""), ACCENTED, PLAIN)


def fold(col: Column) -> Column:
    """Lower case, no accents, one form of sigma: the form used for comparing."""
    return F.translate(strip_accents(F.lower(col)), "ς", "σ")


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def words(col: Column, kept: str, min_len: int, stop: Iterable[str] = ()) -> Column:
    """Distinct runs of the characters in ``kept`` that are long enough."""
    parts = F.split(F.trim(F.regexp_replace(col, f"[^{kept}]+", " ")), " ")
    out = F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_len))
    stop = sorted(set(stop))
    return F.array_except(out, F.array(*[fold(F.lit(s)) for s in stop])) if stop else out


def tokens(col: Column, stop: Iterable[str] = (), min_len: int = 2) -> Column:
    return words(fold(F.coalesce(col, F.lit(""))), "a-z0-9_α-ω", min_len, stop)


# Greek letter -> Latin transliteration.
ROMAN_ONE_TO_ONE = ("αβγδεζηικλμνξοπρστυφω", "avgdeziiklmnxoprstifo")
ROMAN_DIGRAPHS = (("θ", "th"), ("χ", "ch"), ("ψ", "ps"))


def romanize(col: Column) -> Column:
    one = F.translate(fold(col), *ROMAN_ONE_TO_ONE)
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ROMAN_DIGRAPHS, one)


# Words that stay in capitals, trailing locale tokens.
KEPT_CAPITALS = (
    "spf uv uva uvb bb cc hd 3d led ph ml gr ha fr gb en el es ru pt du scan nl g ds ds24"
).split()
LOCALES = "GR EN FR SCAN GB EL ES RU PT NL DA DU ITA DE".split()


def title_case(col: Column, keep: Sequence[str] = tuple(KEPT_CAPITALS)) -> Column:
    def piece(w: Column) -> Column:
        return (
            F.when(w.isin(*keep), F.upper(w))
            .when(w.rlike("^[a-z]+$"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
            .otherwise(w)
        )

    runs = F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9_]+|[^a-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(runs, piece), "")


def clean_name(col: Column, locales: Sequence[str] = tuple(LOCALES)) -> Column:
    """Drop trailing locale tokens (an explicit list), squash blanks, title case."""
    bare = F.regexp_replace(squash(col), regex(rf"(?:\s+(?:{'|'.join(locales)}))+$"), "")
    return title_case(F.trim(bare))


def decap_name(col: Column, brand: str) -> Column:
    """Runs of capitals become Capitalised; the brand is prefixed once."""
    runs = F.regexp_extract_all(
        F.coalesce(col, F.lit("")), F.lit("([A-Z]{2,}|[^A-Z]+|[A-Z])"), F.lit(1)
    )
    soft = F.transform(
        runs,
        lambda r: F.when(
            r.rlike("^[A-Z]{2,}$"), F.concat(F.substring(r, 1, 1), F.lower(F.substr(r, F.lit(2))))
        ).otherwise(r),
    )
    out = squash(F.array_join(soft, ""))
    return (
        F.when(out == "", F.lit(""))
        .when(out.rlike(regex(rf"^{brand}\b")), out)
        .otherwise(F.concat(F.lit(f"{brand} "), out))
    )


def replace_all(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules one after the other; order matters."""
    return reduce(lambda c, r: F.regexp_replace(c, regex(r[0]), r[1]), rules, col)


# Ordered abbreviation dictionary of supplier short names.
ABBREVIATIONS = (
    (r"\bPT\b", "Purete Thermale"),
    (r"\bM\.?89\b", "Mineral 89"),
    (r"\bMIN\.?\s?89\b", "Mineral 89"),
    (r"\bLFT\b", "Liftactiv"),
    (r"\bLIFT\b(?!ACT)", "Liftactiv"),
    (r"\bNEO\b", "Neovadiol"),
    (r"\bDB\b", "Dermablend"),
    (r"\bDEM\b", "Dermablend"),
    (r"\bCRV\b", "CeraVe"),
    (r"\bEFF\b", "Effaclar"),
    (r"\bTOL\b", "Toleriane"),
    (r"\bCICA\b", "Cicaplast"),
    (r"\bLIP\b", "Lipikar"),
    (r"\bHOM\b", "Homme"),
    (r"\bWAT\b", "Water"),
    (r"\bMIC\b", "Micellar"),
    (r"\bSENS\b", "Sensitive"),
    (r"\bCRM?\b", "Cream"),
    (r"\bLOT\b", "Lotion"),
    (r"\bSPR\b", "Spray"),
    (r"\bSH\b", "Shampoo"),
    (r"\bM-?UP\b", "Make-up"),
    (r"\bREM\b", "Remover"),
    (r"\bSOOT\b", "Soothing"),
    (r"\bPERFEC\b", "Perfecting"),
    (r"\bMOUS\b", "Mousse"),
    (r"\bINV\b", "Invisible"),
    (r"\bHYDRA\b", "Hydra"),
    (r"\bMAT\b(?!CH)", "Mat"),
    (r"\bANTI[- ]?TR\b", "Anti-Transpirant"),
    (r"\bDEO\b", "Deodorant"),
)
CONTAINER_CODE = r"\b[FJTBSP](\d+(?:\.\d+)?)\s*(ml|gr|kg|g)\b"
REGION_TOKENS = (
    r"\b(?:GR|EN|FR|ES|PT|RU|EL|PL|DE|IT|NL|DU|DA|SCAN|GB|CH|CZ|HU|SK|RO|HR|BG|TR)\b"
)


def expand_name(col: Column, rules: Iterable[tuple[str, str]] = ABBREVIATIONS) -> Column:
    """Expand abbreviations, then strip container codes and region tokens."""
    out = replace_all(col, rules)
    out = F.regexp_replace(out, regex(CONTAINER_CODE), "$1$2")
    return squash(F.regexp_replace(out, regex(REGION_TOKENS), ""))


def prepend_if_absent(head: Column, text: Column) -> Column:
    """``head text`` unless the text already has ``head`` as whole words."""
    pattern = F.concat(
        F.lit(rf"(?iu)(?<!{WORD})\Q"), F.replace(head, F.lit("\\E"), F.lit("")), F.lit(rf"\E(?!{WORD})")
    )
    missing = (F.coalesce(head, F.lit("")) != "") & ~F.coalesce(F.regexp_like(text, pattern), F.lit(False))
    return squash(F.when(missing, F.concat(head, F.lit(" "), text)).otherwise(text))


def slug(col: Column, max_len: int = 90) -> Column:
    """ASCII key: accents off, Greek dropped, everything else joined by dashes."""
    out = strip_accents(col)
    out = F.regexp_replace(out, "[Ͱ-Ͽἀ-῿]", " ")
    out = F.regexp_replace(F.replace(out, F.lit("+"), F.lit("")), "[^A-Za-z0-9_\\s/\\\\-]", " ")
    out = F.lower(F.regexp_replace(F.regexp_replace(out, r"[/\\]", "-"), r"[\s-]+", "-"))
    cut = F.left(F.regexp_replace(out, "^-|-$", ""), F.lit(max_len))
    return F.regexp_replace(cut, "-+$", "")


def cut_at_word(col: Column, max_len: int) -> Column:
    """At most ``max_len`` characters, cut before the last partial word."""
    cut = F.concat(F.regexp_replace(F.left(col, F.lit(max_len - 3)), r"\s+\S*$", ""), F.lit("..."))
    return F.when(F.length(col) > max_len, cut).otherwise(col)


def count_chars(col: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{char_class}]+", ""))

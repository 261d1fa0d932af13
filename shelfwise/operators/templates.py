"""Descriptions assembled from a table of templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.skew import is_small

#: Columns of a template table besides the keys, which the caller names.
RULE = ("attribute", "least", "place", "sentence")


def _patterns(templates: DataFrame, keys: Sequence[str]) -> list[tuple[bool, ...]]:
    """Which of the keys are set, for each way in which rows of the table leave some out: at
    most two to the power of their number."""
    marks = [F.col(k).isNotNull().alias(k) for k in keys]
    return sorted(tuple(r) for r in templates.select(*marks).distinct().collect())


def _key(pattern: tuple[bool, ...], columns: Sequence[Column]) -> Column:
    """One value of all set keys. Lengths keep neighbouring values apart; null if any is missing."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c, is_set in zip(columns, pattern) if is_set]
    return F.concat(F.lit("".join("x" if s else "-" for s in pattern)), *parts)


def describe_by_templates(
    products: DataFrame,
    templates: DataFrame,
    row_id: str,
    keys: Sequence[str],
    labels: str,
    level: str,
    values: Mapping[str, str],
) -> DataFrame:
    """``row_id`` and description of each product: for every place the most specific sentence
    that fits, in order of place, joined by blanks.

    A row of ``templates`` (the keys, attribute, least, place, sentence) fits a product if each
    key and the attribute are null or equal (the attribute: to one of the array ``labels``),
    ``level`` reaches its bound ``least`` where there is one, and no value that the sentence
    names in braces is missing (null or blank). ``values`` maps names to columns. More specific
    is a row with more keys and an attribute set, then with a higher bound, then with more
    values; sentences in code-point order break ties. A product without any fitting row has an
    empty description. Values are put in as they are; braces in them are not read again
    unless a later name stands there.

    Each product asks once per way of leaving keys out and label, by equality, so the table of
    templates may be long: it is broadcast only if a count finds it small. What reaches the
    aggregate is bounded by the rules of one product, and combined before the shuffle.
    """
    all_keys = [*keys, "attribute"]
    patterns = _patterns(templates, all_keys)
    rules = templates.select(
        F.coalesce(*[F.when(_is(p, all_keys), _key(p, [F.col(k) for k in all_keys])) for p in patterns] or [F.lit(None).cast("string")]).alias("_ask"),
        sum((F.col(k).isNotNull().cast("int") for k in all_keys), F.lit(0)).alias("_set"),
        F.col("least").alias("_least"),
        F.col("place").alias("_place"),
        F.col("sentence").alias("_sentence"),
    )
    asked = products.select(
        F.col(row_id),
        F.col(level).alias("_level"),
        F.struct(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(n) for n, c in values.items()]).alias("_values"),
        _asks(patterns, keys, labels).alias("_asks"),
    )
    asked = asked.select(row_id, "_level", "_values", F.explode("_asks").alias("_ask"))
    fits = asked.join(F.broadcast(rules) if is_small(rules) else rules, "_ask").where("_least is null or _level >= _least")
    text, named = F.col("_sentence"), F.lit(0)
    for name in values:
        mark = F.lit("{" + name + "}")
        uses = F.col("_sentence").contains(mark)
        # a missing value makes the sentence null
        text = F.when(uses, F.replace(text, mark, F.col(f"_values.{name}"))).otherwise(text)
        named = named + uses.cast("int")
    # the least struct of a place is its most specific row
    best = F.struct(F.col("_place").alias("place"), (-F.col("_set")).alias("set"), F.coalesce(-F.col("_least"), F.lit(float("inf"))).alias("least"), (-named).alias("named"), text.alias("text"))
    found = fits.select(row_id, best.alias("_row")).where("_row.text is not null").groupBy(row_id).agg(F.collect_set("_row").alias("_rows"))
    ordered = F.array_sort("_rows")
    first = F.filter(ordered, lambda r, i: (i == 0) | (r["place"] != F.get(ordered, i - 1)["place"]))
    described = found.select(row_id, F.array_join(F.transform(first, lambda r: r["text"]), " ").alias("description"))
    return products.select(row_id).join(described, row_id, "left").select(row_id, F.coalesce("description", F.lit("")).alias("description"))


def _is(pattern: tuple[bool, ...], keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, is_set in zip(keys, pattern):
        out = out & (F.col(k).isNotNull() if is_set else F.col(k).isNull())
    return out


def _asks(patterns: list[tuple[bool, ...]], keys: Sequence[str], labels: str) -> Column:
    """The keys of all rules that a product may fit, by equality."""
    own = [F.col(k) for k in keys]
    with_label, without = [p for p in patterns if p[-1]], [p for p in patterns if not p[-1]]
    none = F.array().cast("array<string>")
    plain = F.array(*[_key(p, [*own, F.lit(None)]) for p in without]) if without else none
    per_label = [_per_label(p, own, labels, none) for p in with_label]
    return F.array_distinct(F.array_compact(F.concat(plain, *per_label)))


def _per_label(pattern: tuple[bool, ...], own: list[Column], labels: str, none: Column) -> Column:
    return F.transform(F.coalesce(F.col(labels), none), lambda label: _key(pattern, [*own, label]))

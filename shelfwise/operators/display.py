"""The flat table that is shown and exported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import decap_name
from shelfwise.operators.layers import cascade_fields, with_dim

LAYER_FIELDS = ("name", "description", "image", "section")


def blank_zero(amount: Column) -> Column:
    """0 means unknown and is shown blank."""
    return F.when(amount > 0, amount.cast("string")).otherwise(F.lit(""))


def display_table(
    products: DataFrame,
    layers: Sequence[DataFrame],
    dims: Mapping[str, DataFrame],
    brand: str | None = None,
    fallback: Column | None = None,
    fields: Sequence[str] = LAYER_FIELDS,
    key: str = "barcode",
    ordinal: str = "ordinal",
) -> DataFrame:
    """One text row per product: layered name and description, dimension labels,
    other codes, blank for what is unknown.

    ``dims`` maps a key column to a table with that key and ``<key>_label``; an
    unknown key is its own label. ``brand`` is prefixed to the names.
    ``fallback`` describes a product that no layer describes.
    """
    df = cascade_fields(products, layers, fields, key, ordinal)
    for column, dim in dims.items():
        df = with_dim(df, dim, column, f"{column}_label", F.col(column), ordinal)
    name = F.coalesce("layer_name", "name", key)
    others = F.array_join(F.filter("variants", lambda v: v != F.coalesce(F.col(key), F.lit(""))), ", ")
    return df.select(
        ordinal,
        (decap_name(name, brand) if brand else name).alias("display_name"),
        blank_zero(F.col("price")).alias("price"),
        F.coalesce("layer_description", fallback if fallback is not None else F.lit("")).alias("description"),
        *[f"{column}_label" for column in dims],
        F.coalesce(others, F.lit("")).alias("variants"),
        F.coalesce("layer_image", F.lit("")).alias("image"),
    )

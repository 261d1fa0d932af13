"""Keyed layers, lookups, set membership and keyed merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.quality import reasons
from shelfwise.functions.text import blank_to_null
from shelfwise.plans.skew import compute_once, keyed_lookup, small_lookup, top_n


def _stack(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers in one table, ``_layer`` = 1 for the first."""
    out = None
    for i, layer in enumerate(layers, start=1):
        part = layer.withColumn("_layer", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def lookup_key(base: DataFrame, merged: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on the key, which stays as it is; blank keys mean missing, never
    match and are spread evenly."""
    named = merged.withColumnRenamed(key, "_key")
    return keyed_lookup(base.withColumn("_key", blank_to_null(F.col(key))), named, "_key", spread).drop("_key")


def cascade_fields(
    base: DataFrame,
    layers: Sequence[DataFrame],
    fields: Sequence[str],
    key: str = "barcode",
    spread: str = "ordinal",
    prefix: str = "layer_",
    first_only: Sequence[str] = (),
) -> DataFrame:
    """Each field from the first layer that has it; ``''`` counts as missing.

    The layers are merged per key first, so the large base is joined once, no
    matter how many layers there are. A layer holds one row per key.
    Fields in ``first_only`` come from layer 1 or stay NULL.
    """
    picks = []
    for f in fields:
        value = blank_to_null(F.col(f))
        picks.append(F.min_by(value, F.when(value.isNotNull(), F.col("_layer"))).alias(prefix + f))
    for f in first_only:
        picks.append(F.max(F.when(F.col("_layer") == 1, F.col(f))).alias(prefix + f))
    merged = _stack(layers).groupBy(key).agg(*picks)
    return lookup_key(base, merged, key, spread)


def cascade_records(
    base: DataFrame,
    layers: Sequence[DataFrame],
    fields: Sequence[str],
    key: str = "barcode",
    spread: str = "ordinal",
    prefix: str = "layer_",
) -> DataFrame:
    """The whole record of the first layer that has the key, gaps included."""
    record = F.struct(*[F.col(f).alias(prefix + f) for f in fields], F.col("_layer").alias(prefix + "no"))
    merged = _stack(layers).groupBy(key).agg(F.min_by(record, F.col("_layer")).alias("_record"))
    return lookup_key(base, merged, key, spread).select(
        *base.columns, *[F.col("_record")[prefix + f].alias(prefix + f) for f in (*fields, "no")]
    )


def with_dim(
    df: DataFrame, dim: DataFrame, key: str, label: str, default: Column, spread: str = "ordinal"
) -> DataFrame:
    """Label of a dimension row, or the default. Only key and label are joined."""
    return small_lookup(df, dim.select(key, label), key, spread).withColumn(label, F.coalesce(F.col(label), default))


def used_dims(dim: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Dimension rows that occur; the keys are made distinct before the join."""
    return dim.join(df.select(key).distinct(), key, "left_semi")


def by_any_code(
    products: DataFrame,
    requests: DataFrame,
    code: str,
    spread: Sequence[str],
    fields: Sequence[str],
    key: str = "barcode",
    variants: str = "variants",
    ordinal: str = "ordinal",
) -> DataFrame:
    """Find products by main key or by a variant; the first row in order wins."""
    codes = products.select(
        F.explode(F.array_union(F.array(key), F.coalesce(variants, F.array().cast("array<string>")))).alias(code),
        F.col(ordinal),
        *fields,
    ).where(blank_to_null(F.col(code)).isNotNull())
    return keyed_lookup(requests, top_n(codes, [code], [F.col(ordinal)]), code, spread)


def resolve(
    requests: DataFrame,
    catalogs: Mapping[str, DataFrame],
    code: str,
    hint: str,
    spread: Sequence[str],
    fields: Sequence[str],
    ordinal: str = "ordinal",
    variants: str = "variants",
) -> DataFrame:
    """The hinted catalogue first, then the fixed order of ``catalogs``; a catalogue
    with a ``variants`` column is searched by these codes as well.

    One row per code with the first hit of every catalogue is built by a
    combining aggregate, so each request meets exactly one lookup row.
    """
    stacked = None
    for name, df in catalogs.items():
        codes = F.array(code)
        if variants in df.columns:
            codes = F.array_union(codes, F.coalesce(variants, F.array().cast("array<string>")))
        part = df.select(F.explode(codes).alias(code), F.lit(name).alias("_catalog"), F.struct(F.col(ordinal), *fields).alias("_row"))
        stacked = part if stacked is None else stacked.unionByName(part)
    firsts = (
        stacked.where(blank_to_null(F.col(code)).isNotNull())
        .groupBy(code)
        .agg(
            *[
                F.min(F.when(F.col("_catalog") == name, F.struct("_row", F.col("_catalog").alias("catalog")))).alias(name)
                for name in catalogs
            ]
        )
    )
    joined = keyed_lookup(requests, firsts, code, spread)
    hinted = F.coalesce(*[F.when(F.col(hint) == name, F.col(name)) for name in catalogs])
    hit = F.coalesce(hinted, *[F.col(name) for name in catalogs])
    return joined.select(
        *requests.columns,
        hit["catalog"].alias("catalog"),
        *[hit["_row"][f].alias(f) for f in (ordinal, *fields)],
    )


def orphans(keyed: DataFrame, products: DataFrame, key: str = "barcode") -> DataFrame:
    """Rows whose key no product has. Blank and NULL keys have none; they do not take part in the join."""
    known = F.coalesce(blank_to_null(F.col(key)).isNotNull(), F.lit(False))
    absent = keyed.where(known).join(products.where(known).select(key).distinct(), key, "left_anti")
    return absent.select(*keyed.columns).unionByName(keyed.where(~known))


def worklist(
    base: DataFrame,
    override: DataFrame,
    supplemental: DataFrame,
    filler: Sequence[str],
    key: str = "barcode",
    spread: str = "ordinal",
) -> DataFrame:
    """Which rows still need work, one row per (product, mode).

    ``missing``: no image in layer 1 and nothing in layer 2; ``force``: no image
    in layer 1; ``flagged``: the description in use is poor; ``has-image``: an
    image to download is known.
    """
    layers = [
        override.select(key, "description", "image"),
        supplemental.select(key, "description", "image"),
    ]
    first_image = F.max(F.when(F.col("_layer") == 1, blank_to_null(F.col("image"))))
    text = blank_to_null(F.col("description"))
    merged = (
        _stack(layers)
        .groupBy(key)
        .agg(
            first_image.isNotNull().alias("_image1"),
            F.max(F.col("_layer") == 2).alias("_has2"),
            F.max(blank_to_null(F.col("image"))).isNotNull().alias("_image"),
            F.min_by(text, F.when(text.isNotNull(), F.col("_layer"))).alias("_text"),
        )
    )
    joined = lookup_key(base, merged, key, spread)
    no_image = ~F.coalesce("_image1", F.lit(False))
    modes = F.array_compact(
        F.array(
            F.when(no_image & ~F.coalesce("_has2", F.lit(False)), F.lit("missing")),
            F.when(no_image, F.lit("force")),
            F.when(F.size(reasons(F.col("_text"), filler)) > 0, F.lit("flagged")),
            F.when(F.coalesce("_image", F.lit(False)), F.lit("has-image")),
        )
    )
    return compute_once(joined, _modes=modes).select(*base.columns, F.explode("_modes").alias("mode"))


def catalog_union(catalogs: Mapping[str, DataFrame], tag: str = "catalog") -> DataFrame:
    out = None
    for name, df in catalogs.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return top_n(df, [key], [F.col(ordinal)])


def upsert_last(current: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Keyed merge, the highest version wins; of equal versions the change does, and
    of several equal ones the first by all their columns, so a retry picks the same."""
    both = current.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in both.columns if c not in (key, version, "_late")]
    return top_n(both, [key], [F.col(version).desc(), F.col("_late").desc(), *rest]).drop("_late")


def memberships(catalogs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a boolean per catalogue, combined before the shuffle."""
    return (
        catalog_union({n: df.select(key) for n, df in catalogs.items()}, "_catalog")
        .groupBy(key)
        .agg(*[F.max(F.col("_catalog") == n).alias(n) for n in catalogs])
    )


def classify_membership(
    keyed: DataFrame, catalogs: Mapping[str, DataFrame], key: str, spread: str, other: str = "orphan"
) -> DataFrame:
    """The first catalogue, in order, that has the key."""
    joined = keyed_lookup(keyed, memberships(catalogs, key), key, spread)
    owner = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in catalogs], F.lit(other))
    return joined.select(*keyed.columns, owner.alias("owner"))


def overlap(catalogs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys present in every catalogue."""
    every = " and ".join(f"`{n}`" for n in catalogs)
    return memberships(catalogs, key).where(f"`{key}` is not null and `{key}` != '' and {every}").select(key)

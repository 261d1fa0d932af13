"""Facets, search, top lists and related items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.skew import hot_keys, is_small, keyed_lookup, top_n


def blob(cols: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def hits(cols: Sequence[str], term: str) -> Column:
    """Case-insensitive substring test; a blank term matches every row."""
    needle = term.strip().lower()
    return F.lit(True) if not needle else blob(cols).contains(needle)


def search(df: DataFrame, cols: Sequence[str], term: str, only: Column | None = None) -> DataFrame:
    found = df.where(hits(cols, term))
    return found if only is None else found.where(only)


def search_summary(df: DataFrame, cols: Sequence[str], term: str) -> DataFrame:
    return df.agg(
        F.count_if(hits(cols, term)).alias("hits"), F.count(F.lit(1)).alias("total")
    )


def facet_filter(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def facet_counts(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows and first position per key; groups without rows do not appear."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))


def in_dim_order(counts: DataFrame, dim: DataFrame, key: str, position: str) -> DataFrame:
    return counts.join(dim.select(key, position), key).orderBy(position)


def by_size(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "first_seen")


def facet_tree(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """Counts per group and per leaf in one pass; ``level`` 0 = total, 1, 2."""
    return (
        df.groupBy(k1, k2)
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup(k1, k2)
        .agg(
            F.sum("n").alias("n"),
            (2 - F.grouping(k1) - F.grouping(k2)).cast("int").alias("level"),
        )
    )


def search_counts(df: DataFrame, cols: Sequence[str], term: str, k1: str, k2: str) -> DataFrame:
    return facet_tree(df.where(hits(cols, term)), k1, k2)


def status_counts(df: DataFrame, status: Column, name: str = "status") -> DataFrame:
    """Rows per outcome of a run or check."""
    return df.groupBy(status.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def brand_stats(df: DataFrame, brand: str, line: str) -> DataFrame:
    """Rows and distinct lines; counted per (brand, line) first, so the brand
    level only sees one row per line."""
    return (
        df.groupBy(brand, line)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(brand)
        .agg(F.sum("n").alias("n"), F.count(line).alias("n_lines"))
    )


def best_sellers(totals: DataFrame, n: int, amount: str, ordinal: str) -> DataFrame:
    """Top ``n`` overall; each task keeps its own top ``n``."""
    return totals.orderBy(F.desc(amount), ordinal).limit(n)


def best_per_group(totals: DataFrame, group: str, amount: str, ordinal: str) -> DataFrame:
    return top_n(totals, [group], [F.desc(amount), F.col(ordinal)])


def ranked_join(ranked: DataFrame, products: DataFrame, codes: str, key: str, ordinal: str, fields: Sequence[str]) -> DataFrame:
    """Products of a ranked code list; unknown codes leave a gap in the ranks."""
    positions = ranked.select(F.posexplode(codes).alias("_pos", key)).withColumn("rank", F.col("_pos") + 1).drop("_pos")
    wanted = positions.select(key).distinct()
    if is_small(wanted):
        wanted = F.broadcast(wanted)
    firsts = top_n(products.join(wanted, key, "left_semi"), [key], [F.col(ordinal)])
    return positions.join(firsts.select(key, ordinal, *fields), key)


def _null_safe(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Key columns under which NULL equals NULL."""
    keys = []
    for i, c in enumerate(cols):
        df = df.withColumn(f"_k{i}", F.coalesce(F.col(c).cast("string"), F.lit(""))).withColumn(
            f"_n{i}", F.col(c).isNull()
        )
        keys += [f"_k{i}", f"_n{i}"]
    return df, keys


def _leaders(df: DataFrame, keys: Sequence[str], fields: Sequence[str], ordinal: str, n: int, out: str) -> DataFrame:
    """One row per group with its first ``n`` members, never more."""
    item = F.struct(F.col(ordinal), *fields)
    return (
        top_n(df, keys, [F.col(ordinal)], n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias(out))
    )


def _emit(df: DataFrame, items: Column, ordinal: str, fields: Sequence[str]) -> DataFrame:
    out = df.select(ordinal, F.posexplode(items).alias("_pos", "_item"))
    return out.select(
        F.col(ordinal),
        (F.col("_pos") + 1).alias("rank"),
        F.col("_item")[ordinal].alias("related"),
        *[F.col("_item")[f].alias(f"related_{f}") for f in fields],
    )


def related(df: DataFrame, group: Sequence[str], fields: Sequence[str], n: int = 6, ordinal: str = "ordinal") -> DataFrame:
    """First ``n`` other rows of the same group; NULL groups count as equal.

    A group's first n + 1 rows serve all its members, so the work is linear in
    the rows and no group is ever collected.
    """
    keyed, keys = _null_safe(df, group)
    leaders = _leaders(keyed, keys, fields, ordinal, n + 1, "_leaders")
    joined = keyed_lookup(keyed.select(ordinal, *keys), leaders, keys, ordinal)
    others = F.slice(F.filter("_leaders", lambda r: r[ordinal] != F.col(ordinal)), 1, n)
    return _emit(joined, others, ordinal, fields)


def related_fill(df: DataFrame, brand: str, line: str, fields: Sequence[str], n: int = 6, ordinal: str = "ordinal") -> DataFrame:
    """Same brand and line first, filled up from other lines of the brand.

    At most ``n`` of the first ``2 n`` brand rows that lead their line belong to
    one line, so these 2 n rows always hold the first n of all other lines.
    """
    keyed, keys = _null_safe(df, [brand, line])
    brand_keys, line_keys = keys[:2], keys[2:]
    own = _leaders(keyed, keys, fields, ordinal, n + 1, "_own")
    others = _leaders(
        top_n(keyed, keys, [F.col(ordinal)], n), brand_keys, [*fields, *line_keys], ordinal, 2 * n, "_others"
    )
    joined = keyed_lookup(keyed.select(ordinal, *keys), own, keys, ordinal)
    joined = keyed_lookup(joined, others, brand_keys, ordinal, hot=hot_keys(keyed, brand_keys))
    same = F.slice(F.filter("_own", lambda r: r[ordinal] != F.col(ordinal)), 1, n)
    plain = F.transform(
        F.filter(
            "_others",
            lambda r: (r[line_keys[0]] != F.col(line_keys[0])) | (r[line_keys[1]] != F.col(line_keys[1])),
        ),
        lambda r: F.struct(r[ordinal].alias(ordinal), *[r[f].alias(f) for f in fields]),
    )
    return _emit(joined, F.slice(F.concat(same, plain), 1, n), ordinal, fields)


def display_price(price: Column) -> Column:
    """Two digits with a decimal comma; 0 means unknown and shows a dash."""
    text = F.replace(price.cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(","))
    return F.when(price > 0, F.concat(text, F.lit(" €"))).otherwise(F.lit("—"))

"""Plan shapes that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfwise.session import run_dir

#: A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000
#: Sub-keys for rows whose key is NULL and can never match.
NULL_SALTS = 4_096


def work_partitions(spark: SparkSession) -> int:
    """Partitions for a join that costs far more than its input suggests; a few
    per core, so that uneven keys even out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and explodes can read without working
    them out again. Below a plain projection the optimizer would repeat their
    expressions in every filter it pushes down; it cannot push into a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counted check, at most ``max_rows + 1`` rows are read to answer it."""
    return df.limit(max_rows + 1).count() <= max_rows


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than ``hot_rows`` rows and into how many parts to cut them.
    The count is combined before it is shuffled."""
    return (
        df.where(" and ".join(f"`{k}` is not null" for k in keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    )


def keyed_lookup(
    base: DataFrame,
    lookup: DataFrame,
    keys: str | Sequence[str],
    spread: str | Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    multiplies: bool = False,
) -> DataFrame:
    """Join ``base`` to a ``lookup`` that has one row, or a bounded few, per key.

    Hot keys are left to adaptive execution, which splits their partitions when it
    sees them. Rows with a NULL key match nothing and would all meet in one task; a
    hash of the ``spread`` columns (a row id, so a retried task salts the same way)
    spreads them. A caller that knows its hot keys from counts it has anyway passes
    them as ``hot`` (keys, _parts): they are cut into parts, and their lookup rows
    repeated once per part; the list may have any length. A join that ``multiplies``
    rows keeps its full number of partitions: adaptive execution would size them by
    the small input and not by the work.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spread = [spread] if isinstance(spread, str) else list(spread)
    row_hash = F.xxhash64(*[F.col(c) for c in spread])
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if hot is None:
        salted, copies = base.withColumn("_parts", F.lit(1)), lookup.withColumn("_parts", F.lit(1))
    else:
        listed = F.broadcast(hot) if is_small(hot) else hot
        salted, copies = base.join(listed, keys, "left"), lookup.join(listed, keys, "left")
    salted = salted.withColumn(
        "_salt",
        F.when(any_null, F.pmod(row_hash, F.lit(NULL_SALTS))).otherwise(F.pmod(row_hash, F.coalesce("_parts", F.lit(1)))).cast("int"),
    ).drop("_parts")
    if hot is None:
        copies = copies.withColumn("_salt", F.lit(0)).drop("_parts")
    else:
        copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    if multiplies:
        parts = work_partitions(base.sparkSession)
        salted = salted.repartition(parts, *keys, "_salt")
        copies = copies.repartition(parts, *keys, "_salt")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several later steps need the same derived rows: the work is done
    once, and a lost executor costs a re-read instead of the whole lineage.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_both(first: tuple[DataFrame, str], second: tuple[DataFrame, str]) -> list[DataFrame]:
    """Two independent tables, written at the same time."""
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(lambda job: stage(*job), (first, second)))


def small_lookup(base: DataFrame, dim: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """Broadcast join if the dimension was counted as small, salted join if not."""
    if is_small(dim):
        return base.join(F.broadcast(dim), key, how)
    return keyed_lookup(base, dim, key, spread, how)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends at most ``n`` rows per map task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


#: Width of the order ranges inside which rows are ranked by one task.
RANK_WIDTH = 1_000_000


def running_rank(df: DataFrame, groups: Sequence[str], order: str, restart: Sequence[str], width: int = RANK_WIDTH) -> DataFrame:
    """Rank of every row within ``restart``, by the remaining ``groups`` columns
    and then the integer ``order`` column, which is unique within a group.

    A large group is cut into ranges of ``order``; rows are ranked within their
    range and the range's offset is a running sum over range counts, so no task
    ever holds a whole group.
    """
    first = [g for g in groups if g not in restart]
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    keys = [*groups, "_range"]
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*restart).orderBy(*first, "_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn("rank", (F.col("_before") + F.col("_inside")).cast("int"))
        .drop("_inside", "_before", "_range")
    )

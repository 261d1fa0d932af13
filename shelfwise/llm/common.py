"""Shared plan pieces of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import run_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the work is done
    once, and losing an executor costs a re-read instead of the lineage."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """With the id, tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to dicts of columns."""
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in each(batch):
                arrays = [columns[f.name] for f in arrow]
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def small(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether a table, staged before, has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The table, marked for broadcast if a count says that it is small; else
    the join shuffles and adaptive execution splits its hot keys."""
    return F.broadcast(df) if small(df, rows) else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per
    node of an edge, the component being its smallest node.

    Alternates large-star and small-star steps, which end after a number of rounds
    that grows with the logarithm of a component's size. Every step sends a node's
    neighbours to their smallest one by a combining aggregate and a join, so no
    neighbourhood is gathered. Each round is written to the shared folder.
    """

    def stars(e: DataFrame, both: bool) -> DataFrame:
        # (a, b) with a > b; ``both``: large star, else small star
        around = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e
        least = around.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("least"))
        least = least.withColumn("least", F.least("c", "least"))
        moved = around.join(least, around.a == least.c)
        if both:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
                least.select(F.col("c").alias("a"), F.col("least").alias("b"))
            )
        return moved.where("a > b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = stage(stars(stars(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return (
        now.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("component"))
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )

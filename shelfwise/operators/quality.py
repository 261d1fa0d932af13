"""Description audits and picks by source or quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.quality import reasons, richness
from shelfwise.functions.text import blank_to_null
from shelfwise.plans.skew import compute_once, keyed_lookup, top_n


def with_verdict(df: DataFrame, text: str, filler: Sequence[str]) -> DataFrame:
    """Adds ``reasons`` (array) and ``ok``."""
    return compute_once(df, reasons=reasons(F.col(text), filler)).withColumn("ok", F.size("reasons") == 0)


def reason_counts(flagged: DataFrame) -> DataFrame:
    return (
        flagged.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def totals(verdicts: DataFrame, text: str) -> DataFrame:
    return verdicts.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(blank_to_null(F.trim(F.col(text))).isNotNull()).alias("with_text"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("flagged"),
    )


def audit(verdicts: DataFrame, text: str, reason: str | None = None) -> DataFrame:
    """Flagged rows with the length of their text; optionally one reason only."""
    flagged = verdicts.where(~F.col("ok"))
    if reason:
        flagged = flagged.where(F.array_contains("reasons", reason))
    return flagged.withColumn("length", F.length(F.coalesce(F.col(text), F.lit(""))))


def pick_by_source(cands: DataFrame, ranks: Sequence[tuple[str, int]] | DataFrame, key: str, host: str, ordinal: str, usable, other: int = 10) -> DataFrame:
    """First usable candidate, preferred hosts first. Ranks are a short list of the
    caller, or a table (host, rank) of any length, one row per host."""
    usable = cands.where(usable)
    if isinstance(ranks, DataFrame):
        listed = ranks.select(F.col("host").alias(host), F.col("rank").alias("_rank_of_host"))
        ranked = keyed_lookup(usable, listed, host, [key, ordinal])
        ranked = ranked.withColumn("host_rank", F.coalesce("_rank_of_host", F.lit(other))).drop("_rank_of_host")
    else:
        table = F.create_map(*[F.lit(v) for pair in ranks for v in pair])
        ranked = usable.withColumn("host_rank", F.coalesce(table[F.col(host)], F.lit(other)))
    return top_n(ranked, [key], [F.col("host_rank"), F.col(ordinal)])


def pick_by_quality(cands: DataFrame, key: str, text: str, ordinal: str, filler: Sequence[str], good: float = 3.0) -> DataFrame:
    """Of all candidates of a key: the first good one, else the best."""
    head = cands.withColumn("score", richness(F.col(text), filler))
    good_first = F.when(F.col("score") >= good, F.col(ordinal))
    return top_n(head, [key], [good_first.asc_nulls_last(), F.desc("score"), F.col(ordinal)])

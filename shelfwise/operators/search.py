"""Substring search of many terms at once, over a table of three-character grams.

The postings say which rows hold which gram; they are written once, in buckets of the
gram's hash. Rows are numbered within blocks of up to 64, and a posting is a gram, a block
and one bit for each of its rows, so a gram that many rows hold takes few postings.
A term is looked up by its rarest grams: their bits are intersected and only
what is left is compared with the text. Terms too short for a gram of that length are
found by one scan of the texts: few by comparison, many by equality with the short grams of each row.

Searching is exact: a gram only rules rows out. Upper and lower case are equal, blanks
around a term do not count, and a blank term is found in every row, as in ``serve.hits``.
Rows without an id can't be found, a NULL text is an empty one. Rows of one id are found
each by its own text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.plans.skew import is_small, stage, top_n, work_partitions

GRAM = 3
#: Folders of the postings.
BUCKETS = 64
#: Files that a folder has at most: postings of a common gram are dealt to these by block.
PARTS = 16
#: Rows of a block at most (bits of a long), and how many are aimed at.
PLACES, FILL = 64, 48
#: Rows whose grams one task collects, roughly.
TASK_ROWS = 20_000
#: Characters of a text that start a gram in one piece of it.
PIECE = 32
#: Up to so many short terms are compared with every text.
COMPARED = 256
#: Grams of a term that are intersected, the rarest first; the rest is left to the comparison.
RAREST = 3


@dataclass(frozen=True)
class GramIndex:
    """``postings``: bucket, gram, block, bits (which places hold it); ``members``: block, place, id;
    ``counts``: gram, n (its rows)."""

    postings: DataFrame
    members: DataFrame
    counts: DataFrame


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct runs of ``n`` characters of a folded text, in time linear in its length. None begins within a character."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1)))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def placed(rows: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """Adds ``home`` (a hash below ``blocks``), ``turn`` and ``place`` (its row's place in the block of home and
    turn) to rows of id, mark and others. Rows that tie have one id, so the ids of places are the same each time."""
    homed = rows.withColumn("home", F.pmod("mark", F.lit(blocks))).repartition(tasks, "home")
    number = F.row_number().over(W.partitionBy("home").orderBy("mark", "id")) - 1
    numbered = homed.withColumn("number", number)
    return numbered.withColumn("turn", F.floor(F.col("number") / PLACES)).withColumn("place", F.pmod("number", F.lit(PLACES))).drop("number", "mark")


def write_index(rows: DataFrame, key: str, text: str, folder: str) -> GramIndex:
    """Writes the postings of ``rows`` below ``folder``: one row per gram and block of rows.

    The rows of a block meet in one task, which collects the bits of its grams. Postings of a
    gram are next to each other within a file. A gram that every block has is dealt to
    ``PARTS`` keys of the shuffle, so no task of a large index writes a whole list; adaptive
    execution puts small ones together.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(key, text).alias("mark"), F.col(text).alias("text"))
    n = known.count()
    blocks, tasks = max(1, -(-n // FILL)), max(work_partitions(spark), -(-n // TASK_ROWS))
    block = (F.col("home") + F.col("turn") * blocks).alias("block")
    placed(known.drop("text"), blocks, tasks).select(block, "place", "id").write.parquet(f"{folder}/members")
    bit = F.expr("shiftleft(1L, place)").alias("bit")
    pieces = placed(known, blocks, tasks).select("home", "turn", bit, F.explode(_pieces(folded(F.col("text")))).alias("piece"))
    starts = F.array(*[F.substring("piece", k + 1, GRAM) for k in range(PIECE)])
    found = pieces.select("home", "turn", "bit", F.explode(starts).alias("gram")).where(F.length("gram") == GRAM)
    # dealt by home already: no shuffle before the bits are together
    found = found.groupBy("home", "turn", "gram").agg(F.bit_or("bit").alias("bits")).select("gram", block, "bits")
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    dealt = found.repartition(bucket_of(F.col("gram")), part).sortWithinPartitions(F.xxhash64("gram"))
    dealt.withColumn("bucket", bucket_of(F.col("gram"))).write.partitionBy("bucket").parquet(f"{folder}/postings")
    _postings(spark, folder).groupBy("gram").agg(F.sum(F.bit_count("bits")).alias("n")).write.parquet(f"{folder}/counts")
    return read_index(spark, folder, rows.schema[key].dataType.simpleString())


def _pieces(text: Column) -> Column:
    """Pieces of a folded text in which each gram starts once, among the first ``PIECE`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM},{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram string, block long, bits long, bucket int").parquet(f"{folder}/postings")


def read_index(spark: SparkSession, folder: str, id_type: str = "long") -> GramIndex:
    members = spark.read.schema(f"block long, place int, id {id_type}").parquet(f"{folder}/members")
    return GramIndex(_postings(spark, folder), members, spark.read.schema("gram string, n long").parquet(f"{folder}/counts"))


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def rarest_grams(index: GramIndex, needles: DataFrame) -> DataFrame:
    """needle, gram, bucket, wanted (grams of the needle in this table): the rarest grams of
    each needle. Needles with a gram that no row holds have none: nothing can contain them."""
    asked = needles.select("needle", F.explode(grams(F.col("needle"))).alias("gram"))
    counted = asked.join(index.counts, "gram", "left")
    lost = counted.where("n is null").select("needle").distinct()
    rare = top_n(counted.join(lost, "needle", "left_anti"), ["needle"], [F.col("n"), F.col("gram")], RAREST)
    wanted = rare.groupBy("needle").agg(F.count(F.lit(1)).alias("wanted"))
    return rare.join(wanted, "needle").select("needle", "gram", bucket_of(F.col("gram")).alias("bucket"), "wanted")


def candidates(index: GramIndex, wanted: DataFrame) -> DataFrame:
    """needle, id of the rows that hold all grams of ``wanted`` (staged); only the folders
    that it names are read. The list of folders has at most ``BUCKETS`` entries."""
    folders = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    lists = index.postings.where(F.col("bucket").isin(folders)).drop("bucket")
    met = lists.join(_broadcast_if_small(wanted.drop("bucket")), "gram")
    held = met.groupBy("needle", "block").agg(F.count(F.lit(1)).alias("held"), F.first("wanted").alias("wanted"), F.bit_and("bits").alias("bits"))
    places = F.expr(f"filter(sequence(0, {PLACES - 1}), k -> getbit(bits, k) = 1)")
    held = held.where("held = wanted and bits <> 0").select("needle", "block", F.explode(places).alias("place"))
    return held.join(index.members, ["block", "place"]).select("needle", "id").distinct()


def search_terms(rows: DataFrame, key: str, text: str, index: GramIndex, terms: DataFrame, term: str = "term") -> DataFrame:
    """Every row of ``terms`` with every id of ``rows`` whose text contains it, as ``id``.

    Terms that fold to one needle are looked up once. The texts are joined with candidates
    only, or read once for all short terms.
    """
    asked = terms.withColumn("needle", F.trim(folded(F.col(term))))
    needles = stage(asked.select("needle").distinct(), "needles")
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), folded(F.col(text)).alias("_text"))
    wanted = stage(rarest_grams(index, needles.where(F.length("needle") >= GRAM)), "wanted-grams")
    met = stage(candidates(index, wanted), "candidates")
    long = texts.join(_broadcast_if_small(met), "id").where(F.contains("_text", "needle")).select("needle", "id")
    few = needles.where(F.length("needle") < GRAM)
    listed = [r.needle for r in few.limit(COMPARED + 1).collect()]
    if len(listed) <= COMPARED:
        asks = F.array(*[F.lit(x) for x in listed]).cast("array<string>")
        short = texts.select("id", F.explode(F.filter(asks, lambda x: F.contains(F.col("_text"), x))).alias("needle")).select("needle", "id")
    else:
        held = F.concat(F.array(F.lit("")), *[grams(F.col("_text"), n) for n in range(1, GRAM)])
        held = texts.select("id", F.explode(held).alias("needle"))
        short = held.join(_broadcast_if_small(few), "needle").select("needle", "id")
    found = long.union(short).distinct() if listed else long.distinct()
    return asked.join(found, "needle").drop("needle")

"""SpotSigs fingerprints in DataFrame functions only.

A spot is a common word (an anchor); its signature is the hash of the anchor and the next
``CHAIN`` content words behind it, where content words are all words that are no anchors.
The start of a text is an anchor of its own, so every text with a content word has a
signature, and a chain may end with the text. The set of a text's signatures, sorted, is
its fingerprint: frames, numbers and punctuation between prose hardly add to it.

Two fingerprints are compared by Jaccard similarity, pruned by their sizes: sets whose
sizes alone rule out ``least`` are never intersected. ``length_partition`` numbers sizes so
that sets of at least ``NEAR`` similarity lie in one partition or in two neighbours.

Words are runs of characters beyond ASCII, ASCII letters and digits, in lower case. Null
texts are empty; a text without content words has the empty fingerprint, and two empty ones
are alike (1.0). Rows may repeat; ids may be null or repeat: the order by descending id is
then carried on by text, null ids last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Content words of a signature.
CHAIN = 3
#: Similarity from which the contract of this library calls texts near; sets the length partitions.
NEAR = 0.8
#: Common words of English, French, Spanish and German.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "there they this to was we were which will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour que "
    "qui sa se ses son sont sur un une vous "
    "al como con del el ella era es esta este fue ha hay las lo los más no o para pero por sin su sus también y ya "
    "als am auch auf aus bei bis das dass dem den der die ein eine einem einen einer er es hat ich ihr im ist mit nach "
    "nicht noch nur oder sich sie sind so über um und von vor war wie wir wird zu zum zur"
).split()
#: Rows of one range of ids, and most ranges (the cut points are literals of the plan).
ROWS, MOST_RANGES = 500, 50_000


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, the sorted distinct signatures of column ``text``."""
    words, at = f"{name}_words", f"{name}_at"
    no_content = sorted({*ANCHORS, ""})
    # the blank in front makes the first word an empty one: the anchor of the text's start
    split = F.split(F.lower(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = rows.withColumn(words, split)
    rows = rows.withColumn(at, F.array_compact(F.transform(words, lambda w, i: F.when(~w.isin(no_content), i))))

    def spots(p: Column, m: Column) -> Column:
        before = F.coalesce(F.when(m > 0, F.get(at, m - 1)), F.lit(-1))
        chain = [F.get(words, p), *(F.get(words, F.get(at, m + k)) for k in range(1, CHAIN))]
        return F.transform(F.slice(words, before + 2, p - before - 1), lambda anchor: F.xxhash64(anchor, *chain))

    return rows.withColumn(name, F.array_sort(F.array_distinct(F.flatten(F.transform(at, spots))))).drop(words, at)


def fingerprint(signatures: str) -> Column:
    """The signatures as text: 16 hexadecimal digits each, comma-joined."""
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; 0 if their sizes rule out ``least``."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((x == 0) & (y == 0), 1.0).when((F.least(x, y) == 0) | (F.least(x, y) < least * F.greatest(x, y)), 0.0).otherwise(both / (x + y - both))


def length_partition(signatures: str, near: float = NEAR) -> Column:
    """Number of the size's partition: sizes of one partition are within a factor of ``near``."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / math.log(1 / near)).cast("long")


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cut points up to an id, by binary search; -1 for null."""
    if not cuts:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    points = F.lit(cuts).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(points, low + step - 1) <= doc_id, low + step).otherwise(low))
    return F.when(doc_id.isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, compute) -> DataFrame:
    """``docs`` (doc_id, text) with next_text and the columns of ``compute`` for the row and, named
    ``next_...``, for its next one in descending order of doc_id; after the last comes the first.

    Rows are dealt by ranges of ids, and the first row of a range is also sent, as a guest,
    to the range before it, so each text is shuffled once and no window spans the table.
    """
    ids = docs.select("doc_id")
    rows = ids.count()
    ranges = min(MOST_RANGES, math.ceil(rows / ROWS))
    cuts: list[int] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []))
    part = _range_of(F.col("doc_id"), cuts)
    # one row per range, MOST_RANGES + 1 at most
    firsts = ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("first"))
    up = W.orderBy("part")
    lowest = F.min("part").over(W.partitionBy())
    guests = firsts.select("part", "first", F.coalesce(F.lead("part").over(up), lowest).alias("host"))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"))
    guest = F.broadcast(guests.withColumnRenamed("part", "own"))
    placed = placed.join(guest, (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    home, away = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    placed = placed.withColumn("place", F.explode(F.when(F.col("host").isNull(), F.array(home)).otherwise(F.array(home, away))))
    dealt = placed.select("doc_id", "text", F.col("place.part").alias("part"), F.col("place.guest").alias("guest")).repartition("part")
    known = compute(dealt)
    added = [c for c in known.columns if c not in dealt.columns]
    order = W.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    row = F.lead(F.struct("text", *added)).over(order)
    return (
        known.withColumn("next", row)
        .where("not guest")
        .select("doc_id", "text", *added, F.col("next.text").alias("next_text"), *(F.col(f"next.{c}").alias(f"next_{c}") for c in added))
    )


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last third replaced by as much of the beginning of another one."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - k), F.substring(F.col(other), F.lit(1), k))


def op13_spot_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"), lambda dealt: with_signatures(dealt, "text", "spots"))
    rows = with_signatures(rows.withColumn("edited", edited()), "edited", "edited_spots")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("spots").alias("fingerprint"),
        fingerprint("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"),
        F.size("spots").cast("long").alias("n_spots"),
        length_partition("spots").alias("length_partition"),
    )

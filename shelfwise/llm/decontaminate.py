"""Benchmark decontamination by winnowing.

Of each six consecutive five-word hashes the smallest is a fingerprint. A span of
ten words holds six such hashes, so a window of ten words that a text shares with
a benchmark item yields the same fingerprint in both. Fingerprints of texts and
items are joined; around each hit every ten-word window is compared with the
items' windows word by word, which extends hits to the whole shared span and drops
chance hits. Items of fewer than ten words are one window; their whole hash is
looked for at every place, as winnowing promises nothing for short spans.

Null texts have no words. Rows that repeat id and text get the same result each;
items without words match nothing; null item ids count in hits but not as items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_map, maybe_broadcast, small, stage, text_key
from .words import shingles, signed, texts

#: Words of a window, of a fingerprint, and fingerprints of a window.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Keys of texts with a shared fingerprint are broadcast up to this number.
KEY_ROWS = 1_000_000


def winnow(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that are the last smallest of any window."""
    at, h = shingles(row, word, GRAM)
    if len(at) < SPAN:
        return at[:0], h[:0]
    views = np.lib.stride_tricks.sliding_window_view(h, SPAN)
    whole = np.flatnonzero(row[at[: len(views)]] == row[at[SPAN - 1 :]])
    best = np.unique(whole + SPAN - 1 - np.argmin(views[whole, ::-1], axis=1))
    return at[best], h[best]


def _windows(text, start, end, first, size) -> list[str]:
    """The words of each window of ``size`` words that starts at word ``first``, a space between two."""
    out = []
    for f in first.tolist():
        out.append(" ".join(text.string(s, e) for s, e in zip(start[f : f + size].tolist(), end[f : f + size].tolist())))
    return out


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, the words of a window, their number, and the hash and gram size of its fingerprint."""

    def each(batch: pa.RecordBatch):
        for text in texts(batch.column(1)):
            row, start, end = text.words()
            word = text.hashes(start, end)
            count = np.bincount(row, minlength=text.rows)
            base = np.concatenate(([0], np.cumsum(count)))
            items = batch.column(0).slice(text.first, text.rows).to_pylist()
            out = {k: [] for k in ("item_id", "words", "size", "gram", "hash")}
            at, h = shingles(row, word, GRAM)
            place = dict(zip(at.tolist(), range(len(at))))
            for r in range(text.rows):
                size = min(int(count[r]), WINDOW)
                if not size:
                    continue
                first = np.arange(base[r], base[r + 1] - size + 1)
                if size < WINDOW:
                    gram, marks = size, shingles(row[base[r] : base[r + 1]], word[base[r] : base[r + 1]], size)[1]
                else:
                    gram = GRAM
                    marks = np.array([min(h[place[f] : place[f] + SPAN]) for f in first.tolist()], np.uint64)
                out["item_id"] += [items[r]] * len(first)
                out["words"] += _windows(text, start, end, first, size)
                out["size"] += [size] * len(first)
                out["gram"] += [gram] * len(first)
                out["hash"] += signed(marks).tolist()
            yield out

    return arrow_map(
        benchmark.select("item_id", "text"), each, "item_id long, words string, size int, gram int, hash long"
    )


def fingerprints(docs: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, key, gram, at, hash) of whole texts: winnowed five-word hashes, and
    every hash of each size in ``short``. ``docs``: doc_id, key, text."""

    def each(batch: pa.RecordBatch):
        for text in texts(batch.column(2)):
            row, start, end = text.words()
            word = text.hashes(start, end)
            for gram in (0, *short):
                at, h = shingles(row, word, gram) if gram else winnow(row, word)
                owner = pa.array(row[at] + text.first)
                yield {
                    "doc_id": batch.column(0).take(owner),
                    "key": batch.column(1).take(owner),
                    "gram": np.full(len(at), gram or GRAM, np.int32),
                    "at": (at - np.searchsorted(row, row[at])).astype(np.int32),
                    "hash": signed(h),
                }

    return arrow_map(docs, each, "doc_id long, key long, gram int, at int, hash long")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words) of whole texts. ``docs``: doc_id, key, text."""

    def each(batch: pa.RecordBatch):
        for text in texts(batch.column(2)):
            yield {
                "doc_id": batch.column(0).slice(text.first, text.rows),
                "key": batch.column(1).slice(text.first, text.rows),
                "n_words": np.bincount(text.words()[0], minlength=text.rows),
            }

    return arrow_map(docs, each, "doc_id long, key long, n_words long")


def _around(docs: DataFrame) -> DataFrame:
    """All windows that hold a hit, as words. ``docs``: doc_id, key, text, hits."""

    def each(batch: pa.RecordBatch):
        for text in texts(batch.column(2)):
            row, start, end = text.words()
            base = np.searchsorted(row, np.arange(text.rows + 1))
            for r in range(text.rows):
                first: dict[int, set[int]] = {}
                n = int(base[r + 1] - base[r])
                for hit in batch.column(3)[text.first + r].as_py():
                    size, at = WINDOW if hit["long"] else hit["gram"], hit["at"]
                    span = range(max(0, at + GRAM - WINDOW), min(at, n - WINDOW) + 1) if hit["long"] else (at,)
                    first.setdefault(size, set()).update(span)
                for size, found in first.items():
                    places = np.array(sorted(found), np.int64)
                    yield {
                        "doc_id": batch.column(0).slice(text.first + r, 1).take(pa.array([0] * len(places), pa.int64())),
                        "key": batch.column(1).slice(text.first + r, 1).take(pa.array([0] * len(places), pa.int64())),
                        "at": places.astype(np.int32),
                        "size": np.full(len(places), size, np.int32),
                        "words": _windows(text, start, end, places + base[r], size),
                    }

    return arrow_map(docs, each, "doc_id long, key long, at int, size int, words string")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (tells texts of one id apart), n_words, n_hit (words inside an occurrence of a
    window), items (sorted ids of items with an occurring window), contaminated.

    Needs doc_id and text; other columns are ignored. Fingerprints of texts are shuffled,
    or none if those of the benchmark are few enough to broadcast; of whole texts only those that
    share a fingerprint are shuffled, or all if these are more than ``KEY_ROWS``.
    """
    docs = docs.select("doc_id", "text").withColumn("key", text_key())
    windows = stage(benchmark_windows(benchmark), "windows")
    marks = stage(
        windows.select("gram", "hash", (F.col("size") == WINDOW).alias("long")).distinct(), "marks"
    )
    short = sorted(r[0] for r in marks.where("not long").select("gram").distinct().collect())  # below ten
    hits = stage(
        fingerprints(docs.select("doc_id", "key", "text"), short)
        .join(maybe_broadcast(marks), ["gram", "hash"])
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("gram", "at", "long")).alias("hits")),  # bounded by the length of one text
        "hits",
    )
    hit_keys = hits.select("key").distinct()
    if small(hit_keys, KEY_ROWS):
        hit = docs.join(F.broadcast(hit_keys), "key", "left_semi").select("doc_id", "text", "key")
    else:
        hit = docs
    d, h = hit.alias("d"), hits.alias("h")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key"))
    near = _around(d.join(h, same).select("d.doc_id", "d.key", "d.text", "h.hits")).distinct()
    found = stage(
        near.join(maybe_broadcast(windows.select("item_id", "words", "size").distinct()), ["words", "size"]).select(
            "doc_id", "key", "at", "size", "item_id"
        ),
        "found",
    )
    by_place = W.Window.partitionBy("doc_id", "key").orderBy("at", "size")
    until = F.max(F.col("at") + F.col("size")).over(by_place.rowsBetween(W.Window.unboundedPreceding, -1))
    covered = (
        found.select("doc_id", "key", "at", "size")
        .distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce(until, F.lit(0)))))
        .groupBy("doc_id", "key")
        .agg(F.sum("new").alias("n_hit"))
    )
    items = (
        found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    both = covered.join(items, (covered.key == items.key) & covered.doc_id.eqNullSafe(items.doc_id)).select(
        covered.doc_id, covered.key, "n_hit", "items"
    )
    rows = word_counts(docs.select("doc_id", "key", "text"))
    r, b = rows.alias("r"), both.alias("b")
    return r.join(b, (F.col("r.key") == F.col("b.key")) & F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select(
        "r.doc_id",
        "r.key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )

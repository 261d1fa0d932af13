"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a linear
model on hashed words and word beginnings; the document's score is their noisy-or,
1 - prod(1 - p). Only document labels are known: the noisy-or likelihood tells the
model which sentences must carry a toxic label, so it can also point at them.

The model is fitted on the rows of at most ``SAMPLE_ROWS`` labelled ids (those with the smallest
hash, so the choice is the same on every run; an id that repeats brings all its rows); every document is scored
whole. Null and empty texts have no sentence and get the model's prior for an empty
bag. Only features that are ``LIFT`` times as frequent in toxic documents are looked at.
Labels that are null, or of ids without a document, are ignored; of repeated
labels the largest counts. Without any label of both kinds every score is the prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stage, table
from .words import texts

#: Bound of the labelled sample, size of the hashed feature space, documents that a feature needs.
SAMPLE_ROWS, BITS, LEAST_DOCS = 6_000, 20, 3
PREFIXES = (4, 5, 6)
#: How much more frequent a feature must be in toxic documents than in others to be looked at.
LIFT = 1.5
STEPS, WARM, RATE, SPARSE = 120, 12, 0.1, 1e-4
THRESHOLD = 0.3

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weight: np.ndarray  # by feature
    bias: float  # of a sentence
    prior: float  # score of a text without sentences


def features(text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: row of each sentence, its first and last byte, and pairs (sentence, feature) as two arrays in one."""
    row, start, end = text.words()
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((2, 0), np.int64)
    stop = np.cumsum(_ENDS[text.data])
    mark = stop[start] + row  # a new row or an end mark begins a new sentence
    first = np.flatnonzero(np.concatenate(([True], (np.diff(mark) > 0) | (np.diff(row) > 0))))
    sentence = np.zeros(len(row), np.int64)
    sentence[first[1:]] = 1
    sentence = np.cumsum(sentence)
    last = np.append(first[1:], len(row)) - 1
    low = np.uint64((1 << BITS) - 1)
    ids = [text.hashes(start, end) & low]
    for n in PREFIXES:
        cut = np.flatnonzero(end - start >= n)
        h = text.hashes(start[cut], start[cut] + n) * np.uint64(2 * n + 1)
        ids.append((h >> np.uint64(20)) & low)
        sentence = np.concatenate((sentence, sentence[: len(row)][cut]))
    pairs = np.stack((sentence, np.concatenate(ids).astype(np.int64)))
    return row[first], start[first], end[last], pairs


def fit(labels: np.ndarray, sentence_doc: np.ndarray, pairs: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the noisy-or likelihood of document labels.

    Weights stay at or above 0: a long sentence of plain words must not outvote an
    insult in it. Features that are at 0 after ``WARM`` steps are left out from then on.
    ``sentence_doc``: document of each sentence, in order; ``pairs``: (sentence, feature).
    """
    share = float(labels.mean()) if len(labels) else 0.0
    weight = np.zeros(1 << BITS, np.float32)
    if not 0 < share < 1:
        return Model(weight, -30.0, share)
    coded = np.unique(pairs[0] << BITS | pairs[1])
    used, feature = np.unique(coded & ((1 << BITS) - 1), return_inverse=True)
    sentence, n = coded >> BITS, len(sentence_doc)
    docs = len(labels)
    y = labels.astype(bool)
    w, bias = np.zeros(len(used)), float(np.log(share / (1 - share)) - np.log(max(1.0, n / docs)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(sentence, w[feature], n) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        miss = np.exp(np.bincount(sentence_doc, np.log1p(-p), docs))  # no sentence is toxic
        pull = np.where(y, miss / np.maximum(1 - miss, 1e-9), -1.0)[sentence_doc] * p
        g = np.append(np.bincount(feature, pull[sentence], len(used)) / docs - SPARSE, pull.sum() / docs)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w + move[:-1], 0), bias + move[-1]
        if step == WARM:
            alive = w > 0
            kept = alive[feature]
            sentence, feature = sentence[kept], (np.cumsum(alive) - 1)[feature[kept]]
            used, w = used[alive], w[alive]
            m, v = m[np.append(alive, True)], v[np.append(alive, True)]
    weight[used] = w
    return Model(weight, bias, share)


def _sampled(docs: DataFrame, labels: DataFrame, allowed: Column | None) -> DataFrame:
    """Features of the labelled sample: doc_id, toxic, n sentences, and pairs (sentence, feature) as raw ints."""
    known = labels.where("doc_id is not null and toxic is not null")
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # bounded
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def each(batch: pa.RecordBatch):
        for text in texts(batch.column(1)):
            row, _, _, pairs = features(text)
            cut = np.searchsorted(row, np.arange(text.rows + 1))
            order = np.argsort(pairs[0], kind="stable")
            s, f = pairs[0][order], pairs[1][order].astype(np.int32)
            at = np.searchsorted(s, cut)
            yield {
                "doc_id": batch.column(0).slice(text.first, text.rows),
                "toxic": batch.column(2).slice(text.first, text.rows),
                "n": np.diff(cut).astype(np.int32),
                "sentence": [(s[a:b] - c).astype(np.int32).tobytes() for a, b, c in zip(at[:-1], at[1:], cut)],
                "feature": [f[a:b].tobytes() for a, b in zip(at[:-1], at[1:])],
            }

    return arrow_map(sample.select("doc_id", "text", "toxic"), each, "doc_id long, toxic int, n int, sentence binary, feature binary")


def _screened(sample: DataFrame) -> np.ndarray:
    """Features that are frequent enough, and more so in toxic documents."""

    def each(batch: pa.RecordBatch):
        counts = np.zeros((2, 1 << BITS), np.int32)
        for toxic, own in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[int(toxic > 0), np.unique(np.frombuffer(own.as_buffer(), np.int32))] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield {"feature": seen.astype(np.int32), "clean": counts[0, seen].astype(np.int64), "toxic": counts[1, seen].astype(np.int64)}

    counts = arrow_map(sample.select("toxic", "feature"), each, "feature int, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kinds = sample.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    often = F.col("clean") + F.col("toxic") >= LEAST_DOCS
    lift = (F.col("toxic") + 0.5) / (kinds["toxic"] + 1) >= LIFT * (F.col("clean") + 0.5) / (kinds["clean"] + 1)
    return np.sort(counts.where(often & lift).select("feature").toArrow().column(0).to_numpy())  # at most 2**BITS


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Model:
    """Fits on a bounded sample of labelled documents. ``labels``: doc_id, toxic;
    ``allowed``: a condition on doc_id that the rows used for fitting must meet."""
    sample = stage(_sampled(docs, labels, allowed), "toxicity-sample")
    screened = sample.sparkSession.sparkContext.broadcast(_screened(sample))

    def each(batch: pa.RecordBatch):
        kept = screened.value
        out = {"sentence": [], "feature": []}
        for s, f in zip(batch.column(3), batch.column(4)):
            s, f = (np.frombuffer(x.as_buffer(), np.int32) for x in (s, f))
            place = np.minimum(np.searchsorted(kept, f), max(0, len(kept) - 1))
            good = kept[place] == f if len(kept) else np.zeros(len(f), bool)
            out["sentence"].append(s[good].tobytes())
            out["feature"].append(f[good].tobytes())
        yield out | {c: batch.column(i) for i, c in enumerate(("doc_id", "toxic", "n"))}

    rows = arrow_map(sample, each, "doc_id long, toxic int, n int, sentence binary, feature binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    n = rows.column("n").to_numpy()
    base = np.concatenate(([0], np.cumsum(n)))
    none = np.zeros(0, np.int64)
    sentence = [np.frombuffer(x.as_buffer(), np.int32) + base[i] for i, x in enumerate(rows.column("sentence"))]
    feature = [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in rows.column("feature")]
    pairs = np.stack((np.concatenate([none, *sentence]), np.concatenate([none, *feature])))
    return fit(rows.column("toxic").to_numpy() > 0, np.repeat(np.arange(len(n)), n), pairs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1), n_toxic_sentences (those with p of at least
    one half), worst_sentence (its text, lower case) and worst_score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.prior))
    names = docs.columns
    new = ["toxicity", "n_toxic_sentences", "worst_sentence", "worst_score"]
    if taken := {x.lower() for x in names} & set(new):
        docs = docs.drop(*taken)
        names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("toxicity double, n_toxic_sentences int, worst_sentence string, worst_score double").fields])

    def each(batches):
        weight, bias, prior = shared.value
        for batch in batches:
            column = batch.column(names.index("text"))
            for text in texts(column):
                row, first, last, pairs = features(text)
                z = np.bincount(pairs[0], weight[pairs[1]], len(row)) + bias if len(row) else np.zeros(0)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                some = np.bincount(row, minlength=text.rows)
                total = 1 - np.exp(np.bincount(row, np.log1p(-p), text.rows))
                total[some == 0] = prior
                toxic = np.bincount(row, p >= 0.5, text.rows).astype(np.int32)
                order = np.lexsort((np.arange(len(row)), -p, row))
                head = order[np.searchsorted(row, np.flatnonzero(some))] if len(row) else order
                worst, worst_p = [None] * text.rows, [None] * text.rows
                for s in head.tolist():
                    worst[row[s]], worst_p[row[s]] = text.string(first[s], last[s]), float(p[s])
                own = batch.slice(text.first, text.rows)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(total), pa.array(toxic), pa.array(worst, pa.string()), pa.array(worst_p, pa.float64())],
                    names=[*names, *new],
                )

    return docs.mapInArrow(each, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
        "n_toxic_sentences",
        "worst_sentence",
        "worst_score",
    )

"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in half; each half has a codebook of its own, and pairs of codes
form a grid of cells. A vector lies in the cell of its two nearest codes. Cells around a
query are visited by growing distance to their borders (the multi-sequence order), up to
the distance that holds the target recall: it is measured on simulated pairs at exactly the
threshold, whose difference points in a random direction. What the visited cells hold is
then compared by cosine in double precision.

The index is a table: a row per vector under (label, first code), and a row per visited
first code of each query with the second codes to look at. Vectors with equal label and
components are one. A crowded code is cut into blocks of vectors and of queries, which
meet block by block, so memory is bounded; a task returns counts and a spanning forest.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do rows without label or vec_id. Shorter vectors count as filled up with
zeros. Rows of one vec_id with different vectors are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, maybe_broadcast, stage, table

THRESHOLD, TARGET = 0.98, 0.9995
#: Bound of the sample that codebooks are fitted on; vectors of a cell aimed at; largest codebook.
SAMPLE_ROWS, CELL, MOST_CODES, STEPS = 20_000, 16, 512, 12
#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 2_048, 8_192


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    codes = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(STEPS):
        near = np.argmax(x @ codes.T - 0.5 * (codes**2).sum(1), axis=1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        total = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        full = count > 0
        codes[full] = total[full] / count[full, None]
    return codes


def borders(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each half vector, and its distance to the border of every code's region."""
    gap = (codes**2).sum(1) - 2 * (x @ codes.T)
    near = np.argmin(gap, axis=1)
    apart = np.sqrt(np.maximum(((codes[:, None] - codes[None]) ** 2).sum(2), 1e-18))
    over = (gap - gap[np.arange(len(x)), near][:, None]) / (2 * apart[near])
    return near, np.maximum(over, 0)


class Index:
    """Two codebooks and the distance to visit."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        k = max(1, min(codes, len(sample)))
        self.codes = [kmeans(part, k, seed) for seed, part in enumerate(self.split(sample))]
        rng = np.random.default_rng(5)
        x = sample[: 4_000]
        push = rng.standard_normal(x.shape)
        push -= (push * x).sum(1)[:, None] * x
        push /= np.maximum(np.linalg.norm(push, axis=1), 1e-12)[:, None]
        y = THRESHOLD * x + np.sqrt(1 - THRESHOLD**2) * push
        need = np.zeros(len(x))
        for a, b, codebook in zip(self.split(x), self.split(y), self.codes):
            need += borders(a, codebook)[1][np.arange(len(x)), borders(b, codebook)[0]] ** 2
        reach = float(np.quantile(need, TARGET)) if len(need) else 0.0
        self.reach = min(reach, 2 - 2 * THRESHOLD)  # at the latter nothing can be missed

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector."""
        return tuple(borders(part, codebook)[0] for part, codebook in zip(self.split(x), self.codes))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, first code) pairs to visit, and for each the second codes as bits of a byte row."""
        first, second = (borders(part, codebook)[1] ** 2 for part, codebook in zip(self.split(x), self.codes))
        query, code = np.nonzero(first <= self.reach)
        inside = second[query] <= (self.reach - first[query, code])[:, None]
        return query, code, np.packbits(inside, axis=1)


def unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column, filled up with zeros to ``width``."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    peak = np.abs(out).max(axis=1, keepdims=True) if len(out) else out[:, :1]
    out /= peak  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _listed(classes: DataFrame, shared, width: int) -> DataFrame:
    """Rows of the index and of the queries: label, code, query (or not), node, size, second (code, of an index row), look (bits, of a query), embedding."""

    def each(batch: pa.RecordBatch):
        index = shared.value
        x = unit(batch.column(3), width)
        first, second = index.place(x)
        query, code, look = index.visits(x)
        owner = np.concatenate((np.arange(len(x)), query))
        pick = pa.array(owner)
        yield {
            "label": batch.column(0).take(pick),
            "code": np.concatenate((first, code)).astype(np.int32),
            "query": np.arange(len(owner)) >= len(x),
            "node": batch.column(1).take(pick),
            "size": batch.column(2).take(pick),
            "second": np.concatenate((second, np.full(len(query), -1))).astype(np.int32),
            "look": pa.array([None] * len(x) + [r.tobytes() for r in look], pa.binary()),
            "embedding": batch.column(3).take(pick),
        }

    return arrow_map(
        classes.select("label", "node", "size", "embedding"),
        each,
        "label long, code int, query boolean, node long, size long, second int, look binary, embedding array<double>",
    )


def _meet(shared, width: int):
    def each(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
        node, size = group.column("node").to_numpy(), group.column("size").to_numpy()
        x = unit(group.column("embedding").combine_chunks(), width)
        codes = len(shared.value.codes[1])
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        looks = group.column("look").take(pa.array(q)).to_pylist()
        look = np.unpackbits(np.frombuffer(b"".join(looks), np.uint8).reshape(len(q), -1), axis=1)[:, :codes].astype(bool) if len(q) else np.zeros((0, codes), bool)
        second = group.column("second").to_numpy()[v]
        links = np.zeros(len(q), np.int64)
        edges: list[np.ndarray] = []
        for code in np.unique(second).tolist():
            a, b = np.flatnonzero(look[:, code]), v[second == code]
            if not len(a):
                continue
            near = x[q[a]] @ x[b].T >= THRESHOLD
            near &= node[q[a]][:, None] != node[b][None, :]
            links[a] += near @ size[b]
            edges.append(forest(near, node[q[a]], node[b]))
        some = np.flatnonzero(links)
        pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        return pa.table(
            {
                "node": np.concatenate((node[q[some]], pairs[:, 0])),
                "root": pa.array(np.concatenate((node[q[some]], pairs[:, 1]))),
                "links": np.concatenate((links[some], np.zeros(len(pairs), np.int64))),
            },
            schema=pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())]),
        )

    return each


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (node, smallest node of its component) of a bipartite graph of links."""
    a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, left, right = near[np.ix_(a, b)], left[a], right[b]
    if not len(a):
        return np.zeros((0, 2), np.int64)
    top = np.iinfo(np.int64).max
    up, down = left.copy(), right.copy()
    while True:
        fresh = np.minimum(down, np.where(near, up[:, None], top).min(axis=0))
        again = np.minimum(up, np.where(near, fresh[None, :], top).min(axis=1))
        if (fresh == down).all() and (again == up).all():
            break
        up, down = again, fresh
    pairs = np.concatenate((np.stack((left, up), 1), np.stack((right, down), 1)))
    return pairs[pairs[:, 0] != pairs[:, 1]]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id (smallest vec_id reachable by links) and kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some
    classes = stage(
        rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size")), "vectors"
    )
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.max(F.size("embedding")).alias("width")).first()
    if not shape["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = shape["width"] + shape["width"] % 2
    sample = classes.orderBy(F.xxhash64("label", "node"), "node").limit(SAMPLE_ROWS).select("embedding").toArrow()  # bounded
    sample = unit(sample.column(0).combine_chunks(), width)
    codes = int(np.clip(round((shape["n"] / shape["labels"] / CELL) ** 0.5), 2, MOST_CODES))
    shared = spark.sparkContext.broadcast(Index(sample, codes))
    listed = stage(_listed(classes, shared, width), "cells")
    count = listed.groupBy("label", "code").agg(F.count_if(~F.col("query")).alias("own"), F.count_if("query").alias("asked"))
    cut = count.select("label", "code", F.ceil(F.col("own") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("turns"))
    cut = maybe_broadcast(stage(cut.where("blocks > 0 and turns > 0"), "blocks"))
    dealt = listed.join(cut, ["label", "code"])
    block, turn = (F.pmod(F.xxhash64("node", F.lit(i)), F.col(c)).cast("int") for i, c in enumerate(("blocks", "turns")))
    # an index row goes to every turn of its block, a query to every block of its turn
    every = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))
    dealt = dealt.withColumn("other", F.explode(every))
    dealt = dealt.select(
        "label", "code",
        F.when(F.col("query"), F.col("other")).otherwise(block).alias("block"),
        F.when(F.col("query"), turn).otherwise(F.col("other")).alias("turn"),
        "query", "node", "size", "second", "look", "embedding",
    )
    met = stage(dealt.groupBy("label", "code", "block", "turn").applyInArrow(_meet(shared, width), "node long, root long, links long"), "links")
    found = met.groupBy("node").agg(F.sum("links").alias("links")).join(components(met.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node")
    known = classes.join(found, "node", "left").select(
        "label", "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    member = rows.withColumn("valid", F.coalesce(valid, F.lit(False))).join(known.withColumn("valid", F.lit(True)), ["valid", "label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return member.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

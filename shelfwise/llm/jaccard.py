"""N-gram Jaccard join: a forest of MinHash prefix tries, then exact checks.

A text becomes the set of its five-word shingles (a text of one to four words is
one shingle). Texts with equal sets are one class. Each class has one label in each
of ``TREES`` tries: ``LEVELS[0]`` minimum hashes in a row. Classes meet if they share a prefix
of their labels in any trie.

The descent begins with whole labels and shortens the prefix level by level. At each level
every class is compared exactly with two heads, smallest classes under its prefixes: the one
it shares most tries with, and the one of a single trie drawn by its id. As that trie is drawn
whatever the similarity s is, a drawn link stands for s ** -depth links, of which a share of
``recall(depth, s)`` meets: so the recall reached is measured on the data, a link at the threshold
that was never drawn included. The descent ends where it is ``TARGET`` or more, at the last level
at the latest, where links at the threshold reach it on any data.

Links to heads found on the way make groups of texts that are truly near. Within a group all
pairs are checked exactly, and of the others all that share a prefix of the last level, in
the first trie where they do. Chains of unrelated texts that only share prefixes thus cost their meetings,
not the square of the chain. Pairs are checked block against block, so a group or a prefix of any size
is spread over many tasks with bounded memory, and each task returns counts and a spanning
forest, not pairs.

Null and word-less texts link with nothing. Rows of one id count as one node each by
their text; null ids get no links and stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, maybe_broadcast, stage, table, text_key
from .words import shingles, signed, texts

WORDS, THRESHOLD = 5, 0.8
TREES, TARGET = 40, 0.999
#: Lengths of the prefixes in minimum hashes, from the whole label to the shortest.
LEVELS = (12, 10, 8)
DEPTH = LEVELS[0]
#: Rows with all prefixes of their labels that are broadcast at most; and texts compared at once.
LABEL_ROWS, PAIR_ROWS = 50_000, 128
#: Rows and shingles of one block of a candidate group.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000

_rng = np.random.default_rng(7)
_FACTOR = (_rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def recall(depth: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` in any tree."""
    return 1 - (1 - similarity**depth) ** trees


def measured(found: DataFrame, depth: int) -> float:
    """Recall of a level by its drawn links (column ``similarity``), and one more at the threshold."""
    s = F.col("similarity")
    weight = F.pow(s, F.lit(-depth))
    met = 1 - F.pow(1 - F.pow(s, F.lit(depth)), F.lit(TREES))
    total, part = found.agg(F.sum(weight), F.sum(weight * met)).first()
    own = THRESHOLD**-depth
    return ((part or 0.0) + own * recall(depth)) / ((total or 0.0) + own)


def shingle_sets(text) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of a slice, rows in order, repeats included."""
    row, start, end = text.words()
    word = text.hashes(start, end)
    at, h = shingles(row, word, WORDS)
    count = np.bincount(row, minlength=text.rows)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if not len(short):
        return row[at], h
    base = np.concatenate(([0], np.cumsum(count)))
    whole = np.array([shingles(row[base[r] : base[r + 1]], word[base[r] : base[r + 1]], int(count[r]))[1][0] for r in short], np.uint64)
    rows = np.concatenate((row[at], short))
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate((h, whole))[order]


def minima(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each run of shingles that begins at ``start`` its minimum under every hash function."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), len(_FACTOR)), np.uint32)
    for j in range(len(_FACTOR)):
        out[:, j] = np.minimum.reduceat(x * _FACTOR[j] + _SHIFT[j], start)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, key, text) with set_id (digest of its shingle
    set), n (size of the set) and per level (p12 and so on) the prefixes of its labels,
    hashed to longs, one per trie; without an id or words these are null."""

    def each(batch: pa.RecordBatch):
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for text in texts(batch.column(2)):
            row, h = shingle_sets(text)
            kept = known[text.first + row]
            row, h = row[kept], h[kept]
            owner, start = np.unique(row, return_index=True)
            ends = np.append(start[1:], len(h))
            ids, sizes = [None] * text.rows, np.zeros(text.rows, np.int32)
            for r, s, e in zip(owner.tolist(), start.tolist(), ends.tolist()):
                own = np.unique(h[s:e])
                ids[r] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                sizes[r] = len(own)
            low = minima(h, start).reshape(len(owner), TREES, DEPTH)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes > 0))).astype(np.int32) * TREES)
            k = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(owner), 1))
            levels = {}
            for d in range(DEPTH):
                k = (k ^ low[:, :, d].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                k ^= k >> np.uint64(29)
                if d + 1 in LEVELS:
                    levels[f"p{d + 1}"] = pa.ListArray.from_arrays(offsets, pa.array(signed(k.reshape(-1).copy())))
            yield {
                "doc_id": batch.column(0).slice(text.first, text.rows),
                "key": batch.column(1).slice(text.first, text.rows),
                "set_id": pa.array(ids, pa.binary()),
                "n": sizes,
                **levels,
            }

    prefixes = ", ".join(f"p{d} array<long>" for d in LEVELS)
    return arrow_map(docs, each, f"doc_id long, key long, set_id binary, n int, {prefixes}")


def sets_of(column) -> list[np.ndarray]:
    """The distinct shingles of each text."""
    sets = []
    for text in texts(column):
        row, h = shingle_sets(text)
        cut = np.searchsorted(row, np.arange(text.rows + 1))
        sets += [np.unique(h[cut[r] : cut[r + 1]]) for r in range(text.rows)]
    return sets


def meetings(labels: DataFrame, depth: int) -> DataFrame:
    """node, tree and head (the smallest node below that prefix) where a prefix of a level is shared by several nodes."""
    rows = labels.select("node", F.posexplode(f"p{depth}").alias("tree", "prefix"))
    crowded = rows.groupBy("prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    crowded = stage(crowded.select("prefix", "head"), "crowded")
    return rows.join(maybe_broadcast(crowded), "prefix").select("node", "tree", "head")


def head_pairs(met: DataFrame) -> DataFrame:
    """a, b (its heads) and drawn (it is that of the drawn trie): two rows at most per node."""
    drawn = F.pmod(F.xxhash64("node"), F.lit(TREES)) == F.col("tree")
    heads = met.where("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("tries"), F.max(drawn).alias("drawn"))
    most = F.max(F.struct("tries", F.bitwise_not("head").alias("turned"))).alias("most")  # of ties the smallest
    chosen = heads.groupBy("node").agg(most, F.max(F.when(F.col("drawn"), F.col("head"))).alias("of_draw"))
    one = F.struct(F.bitwise_not("most.turned").alias("b"), F.lit(False).alias("drawn"))
    two = F.struct(F.col("of_draw").alias("b"), F.lit(True).alias("drawn"))
    each = chosen.select(F.col("node").alias("a"), F.explode(F.array(one, two)).alias("pair")).select("a", "pair.*")
    return each.where("b is not null").groupBy("a", "b").agg(F.max("drawn").alias("drawn"))


def similarities(pairs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Exact similarity of each pair (a, b) of nodes."""

    def each(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, PAIR_ROWS):
            part = batch.slice(at, PAIR_ROWS)
            both = zip(sets_of(part.column(2)), sets_of(part.column(3)))
            common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in both]
            yield {"a": part.column(0), "b": part.column(1), "similarity": [c / (n - c) for c, n in common]}

    left = fetched.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = fetched.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    found = arrow_map(both, each, "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))  # an id may have several texts


def descend(labels: DataFrame, fetched: DataFrame) -> tuple[DataFrame, int]:
    """Links (a, b, similarity) of nodes to heads, and the length of the prefix that reaches the target recall."""
    known = None
    for depth in LEVELS:
        pairs = stage(head_pairs(meetings(labels, depth)), "pairs")
        fresh = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        fresh = stage(similarities(fresh, fetched), "compared")
        known = fresh if known is None else known.union(fresh)
        linked = known.where(F.col("similarity") >= THRESHOLD - 1e-9)
        if depth == LEVELS[-1] or measured(pairs.where("drawn").join(linked, ["a", "b"]), depth) >= TARGET:
            return linked, depth


def meeting_groups(labels: DataFrame, group: DataFrame, depth: int) -> DataFrame:
    """Prefixes shared by nodes of several groups, with all their nodes: tree, group (the prefix), node, key, size,
    n, own (the node's group), prefixes and major (it is of the largest group there, whose pairs are compared elsewhere)."""
    own = F.coalesce("component", "node").alias("own")
    named = labels.join(group, "node", "left").select("node", "key", "size", "n", own, F.col(f"p{depth}").alias("prefixes"))
    named = stage(named, "named")
    rows = named.select("node", "key", "own", F.posexplode("prefixes").alias("tree", "group"))
    count = rows.groupBy("tree", "group", "own").count()
    largest = F.max(F.struct("count", "own")).alias("largest")
    several = count.groupBy("tree", "group").agg(F.count(F.lit(1)).alias("owns"), largest).where("owns > 1")
    several = stage(several.select("tree", "group", F.col("largest.own").alias("most")), "several")
    met = rows.join(maybe_broadcast(several), ["tree", "group"])
    met = met.select("tree", "group", "node", "key", (F.col("own") == F.col("most")).alias("major"))
    return met.join(named, ["node", "key"])


def _verify(group: pa.Table) -> pa.Table:
    """Exact similarities of one pair of blocks: per node its number of links and a forest of edges.
    Under a prefix only pairs of two groups count, and only in the first trie where they meet."""
    names = list(zip(group.column("node").to_pylist(), group.column("key").to_pylist()))
    once = {name: i for i, name in reversed(list(enumerate(names)))}  # repeated rows count in ``size``
    group = group.take(pa.array(sorted(once.values())))
    left = np.asarray(group.column("left").to_numpy(), bool)
    right = np.asarray(group.column("right").to_numpy(), bool)
    node = group.column("node").to_numpy()
    size = group.column("size").to_numpy().astype(np.float64)
    sets = sets_of(group.column("text"))
    n = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), n)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column)
    kept = often[column] > 1
    column, member = (np.cumsum(often > 1) - 1)[column[kept]], member[kept]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    wide = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        present, local = np.unique(member[a:b], return_inverse=True)
        matrix = np.zeros((len(present), wide), np.float32)
        matrix[local, column[a:b] - lo] = 1
        common[np.ix_(present, present)] += matrix @ matrix.T
    near = common >= THRESHOLD * (n[:, None] + n[None, :] - common) - 1e-6
    near &= left[:, None] & right[None, :]
    tree = group.column("tree")[0].as_py()
    if tree >= 0:
        own = group.column("own").to_numpy()
        near &= own[:, None] != own[None, :]
        prefixes = group.column("prefixes").combine_chunks().flatten().to_numpy().reshape(len(sets), -1)
        x, y = np.nonzero(near)
        for at in range(0, len(x), 1 << 16):
            some = slice(at, at + (1 << 16))
            near[x[some], y[some]] = (prefixes[x[some]] == prefixes[y[some]]).argmax(axis=1) == tree
    near |= near.T
    np.fill_diagonal(near, False)
    links = near @ size
    # a forest: from each unseen node outwards
    parent = np.full(len(sets), -1)
    for root in range(len(sets)):
        if parent[root] >= 0 or not near[root].any():
            continue
        parent[root], wave = root, np.array([root])
        while len(wave):
            fresh = np.flatnonzero(near[wave].any(axis=0) & (parent < 0))
            parent[fresh] = root
            wave = fresh
    some = np.flatnonzero(links > 0)
    return pa.table(
        {"node": node[some], "links": links[some].astype(np.int64), "root": node[parent[some]]},
        schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]),
    )


def blocks(nodes: DataFrame) -> DataFrame:
    """Groups and prefixes dealt to pairs of blocks: a node goes to as many pairs as there are
    blocks; a node of a prefix's major group only meets the blocks of others."""
    place = ["tree", "group"]
    rows, shingles_of = F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")
    count = nodes.groupBy(*place, "major").agg(rows, shingles_of)
    need = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    count = count.groupBy(*place).agg(
        F.coalesce(F.max(F.when(~F.col("major"), need)), F.lit(0)).alias("mixed"), F.coalesce(F.max(F.when(F.col("major"), need)), F.lit(0)).alias("majors")
    )
    spread = nodes.join(count, place)
    hashed = F.xxhash64("node", "key")
    block = F.when(F.col("major"), F.col("mixed") + F.pmod(hashed, F.greatest("majors", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("mixed", F.lit(1))))
    others = F.when(F.col("major"), F.col("mixed")).otherwise(F.col("mixed") + F.col("majors"))
    spread = spread.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return spread.select(
        *place,
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("left"),
        (F.col("block") >= F.col("other")).alias("right"),
        "node",
        "key",
        "size",
        "own",
        "prefixes",
    )


def verified(nodes: DataFrame, fetched: DataFrame) -> DataFrame:
    """node, links and root of all pairs of blocks of ``nodes``."""
    dealt = stage(blocks(nodes), "blocks")
    pairs = maybe_broadcast(dealt, LABEL_ROWS).join(fetched, ["node", "key"])
    found = pairs.groupBy("tree", "group", "i", "j").applyInArrow(_verify, "node long, links long, root long")
    return stage(found, "links")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_links (other documents at least 0.8
    similar), component_id (smallest doc_id reachable by links), kept (it is its own
    component, or has no id), and key (tells texts of one id apart)."""
    docs = docs.select("doc_id", "text").withColumn("key", text_key())
    every = stage(signatures(docs.select("doc_id", "key", "text")), "signatures")
    narrow = every.select("doc_id", "key", "set_id", "n")
    sets = narrow.where("set_id is not null").groupBy("set_id", "n")
    sets = sets.agg(F.min(F.struct("doc_id", "key")).alias("head"), F.count(F.lit(1)).alias("size"))
    sets = stage(sets.select("set_id", "n", "size", F.col("head.doc_id").alias("node"), F.col("head.key").alias("key")), "sets")
    heads = sets.select(F.col("node").alias("doc_id"), "key", "size")
    labels = every.where("set_id is not null").join(heads, ["doc_id", "key"]).withColumnRenamed("doc_id", "node")
    # only classes that meet another at the shortest prefix are ever compared
    meets = stage(meetings(labels, LEVELS[-1]).select("node").distinct(), "meets")
    labels = stage(labels.join(meets, "node", "left_semi").drop("set_id"), "labels")
    wanted = labels.select("node", "key").distinct()
    fetched = docs.select(F.col("doc_id").alias("node"), "key", "text").join(maybe_broadcast(wanted), ["node", "key"], "left_semi")
    fetched = stage(fetched, "fetched")
    near, depth = descend(labels, fetched)
    group = components(near)
    alike = group.join(labels, "node").select(
        F.lit(-1).alias("tree"),
        F.col("component").alias("group"),
        "node",
        "key",
        "size",
        "n",
        F.col("component").alias("own"),
        F.lit(None).cast("array<long>").alias("prefixes"),
        F.lit(False).alias("major"),
    )
    exact = verified(alike, fetched).union(verified(meeting_groups(labels, group, depth), fetched))
    found = (
        exact.groupBy("node")
        .agg(F.sum("links").alias("links"))
        .join(components(exact.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node")
    )
    known = sets.join(found, "node", "left").select("set_id", "node", "size", "links", "component")
    rows = narrow.join(known, "set_id", "left")
    component = F.coalesce("component", "node", "doc_id")
    return rows.select(
        "doc_id",
        F.coalesce(F.col("links") + F.col("size") - 1, F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        "key",
    )


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("key")

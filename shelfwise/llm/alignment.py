"""Alignment of two tokenizers over the same text.

A text is encoded by a byte-level tokenizers file (A, on a blank and the text) and by a
SentencePiece model (B, which puts that blank in front itself). The bytes of the tokens on
both sides must be that blank and text again; else the text counts as having no tokens.

Tokens become rows (start, document) of two frames per batch of texts. ``merge_asof``, keyed
by document, finds for each token start the other side's token that covers it; the union of
both directions is the set of all pairs with overlapping bytes (links). Where a token of A
and one of B end at the same byte, a group ends.

How often a pair of ids is linked is counted over the whole corpus: a task puts out, per
block of about ``BLOCK_LINKS`` links, the block's distinct pairs once, and per document only
places in that list. Pairs are summed and ranked by Spark, and each block gets the counts of
its own pairs back by a join, so neither links nor the whole table of pairs reach one task.

Texts that both sides cut at a blank (one blank, a character that is no white space behind
it) are encoded by distinct words, which gives the same ids; a task remembers words, as
strings, up to ``KEEP`` of them. Texts of tokenizers that can't be cut so are encoded whole.

Null and empty texts have no tokens: zeros and an empty digest. Rows and ids may repeat, ids
may be null. Special tokens' strings inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table
from .sentencepiece_codec import BYTE, MARK, by_words, parse

#: Characters of texts that are aligned at once, and links of a block (a block ends with a document).
SLICE, BLOCK_LINKS = 1 << 20, 1_000_000
#: Words that a task remembers.
KEEP = 1_000_000


def byte_values() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable ones for
    themselves, all others, in order, for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def shared_models(spark: SparkSession, a_path: str, b_path: str):
    """Both files, read on the driver (a few megabytes) and broadcast."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


class Side:
    """Bytes of each id of one tokenizer, and ids of learned words one after the other."""

    def __init__(self, vocabulary: list[bytes], encode):
        self.bytes, self.encode = vocabulary, encode
        self.size = np.array([len(b) for b in vocabulary], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> list[bool]:
        """Adds words; tells for each whether its tokens' bytes are the blank and the word."""
        found = self.encode(words)
        n = np.array([len(x) for x in found], np.int64)
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(n)))
        return [b"".join(self.bytes[i] for i in x) == b" " + w.encode() for x, w in zip(found, words)]

    def tokens(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in order."""
        n = self.starts[place + 1] - self.starts[place]
        skip = np.repeat(self.starts[place] - (np.cumsum(n) - n), n)
        return n, self.ids[skip + np.arange(len(skip))]


class Aligner:
    """Both tokenizers in a worker, and the words it has seen."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(a_json)
        first.encode_special_tokens = True
        first.no_truncation()
        first.no_padding()
        spec = json.loads(a_json)
        values = byte_values()
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        names = {i: s for s, i in first.get_vocab(with_added_tokens=True).items()}
        a_bytes = [special[i].encode() if i in special else bytes(values[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.a = Side(a_bytes, lambda words: [e.ids for e in first.encode_batch_fast([" " + w for w in words], add_special_tokens=False)])
        second = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        model = parse(b_model)
        b_bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model["pieces"]]
        self.b = Side(b_bytes, lambda words: second.encode(words, num_threads=1))
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.cut = bool(byte_level and by_words(model) and model["prefix"])
        digits = [str(i).encode() for i in range(max(len(a_bytes), len(b_bytes)))]
        self.digits = np.array(digits, "S").view(np.uint8).reshape(len(digits), -1)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.a.clear()
        self.b.clear()

    def words(self, text: str) -> list[str]:
        """The text cut where both tokenizers cut; each word lacks the one blank before it."""
        if not self.cut:
            return [text]
        parts = text.split(" ")
        if all(parts) and not any(p[0].isspace() for p in parts):
            return parts
        out: list[list[str]] = []
        joins = False  # after an empty part: what follows it stays with it
        for part in parts:
            if out and (joins or not part or part[0].isspace()):
                out[-1].append(part)
            else:
                out.append([part])
            joins = not part
        return [" ".join(x) for x in out]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words per text (none if it is empty), and the number of each word."""
        if len(self.index) > KEEP:
            self.clear()
        found = [self.words(t) if t else [] for t in texts]
        new = list({w: None for ws in found for w in ws if w not in self.index})
        if new:
            good = np.array(self.a.learn(new)) & np.array(self.b.learn(new))
            self.good = np.concatenate((self.good, good))
            known = len(self.index)
            self.index.update(zip(new, range(known, known + len(new))))
        n = np.array([len(ws) for ws in found], np.int64)
        return n, np.fromiter((self.index[w] for ws in found for w in ws), np.int64, int(n.sum()))


class Aligned:
    """Tokens, links and groups of some whole texts; tokens, links and groups are in order of text and byte."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        self.aligner, self.rows = aligner, len(texts)
        words, place = aligner.places(texts)
        row = np.repeat(np.arange(self.rows), words)
        bad = np.bincount(row, ~aligner.good[place], self.rows) > 0
        place, row = place[~bad[row]], row[~bad[row]]
        sides = []
        for side in (aligner.a, aligner.b):
            n, ids = side.tokens(place)
            end = np.cumsum(side.size[ids])
            sides.append((ids, np.repeat(row, n), end - side.size[ids], end))
        (self.a_id, self.a_row, a_start, a_end), (self.b_id, self.b_row, b_start, b_end) = sides
        self.link_a, self.link_b = self._links(a_start, b_start)
        self.link_row = self.a_row[self.link_a]
        # the last token of a group on either side
        self.a_last, self.b_last = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)

    def _links(self, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the linked tokens of both sides."""
        a = pd.DataFrame({"start": a_start, "row": self.a_row, "a": np.arange(len(a_start))})
        b = pd.DataFrame({"start": b_start, "row": self.b_row, "b": np.arange(len(b_start))})
        by_a = pd.merge_asof(a, b, on="start", by="row")
        by_b = pd.merge_asof(b, a, on="start", by="row")
        a_of_b = by_b["a"].to_numpy(np.int64)
        # tokens that start together are found from both sides
        more = a_start[a_of_b] != b_start if len(a_of_b) else np.zeros(0, bool)
        link_a = np.concatenate((by_a["a"].to_numpy(np.int64), a_of_b[more]))
        link_b = np.concatenate((by_a["b"].to_numpy(np.int64), by_b["b"].to_numpy(np.int64)[more]))
        order = np.lexsort((link_b, link_a))
        return link_a[order], link_b[order]

    def counts(self) -> dict[str, np.ndarray]:
        """Tokens of both sides, groups and links per text."""
        def per_row(rows):
            return np.bincount(rows, minlength=self.rows).astype(np.int64)

        return {"n_a": per_row(self.a_row), "n_b": per_row(self.b_row), "n_groups": per_row(self.a_row[self.a_last]), "n_links": per_row(self.link_row)}

    def group_texts(self) -> Iterator[bytes]:
        """The groups of each text, ``a1,a2|b1;a3|b2,b3``."""
        numbers = [np.cumsum(last) - last for last in (self.a_last, self.b_last)]
        key = np.concatenate((numbers[0] * 2, numbers[1] * 2 + 1))
        order = np.argsort(key, kind="stable")
        ids, key = np.concatenate((self.a_id, self.b_id))[order], key[order]
        size = self.aligner.n_digits[ids]
        end = np.cumsum(size + 1)
        begin = end - size - 1
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        for k in range(self.aligner.digits.shape[1]):
            has = np.flatnonzero(size > k)
            out[begin[has] + k] = self.aligner.digits[ids[has], k]
        same = np.append(key[1:] == key[:-1], False) if len(key) else np.zeros(0, bool)
        out[end - 1] = np.where(same, ord(","), np.where(key % 2 == 0, ord("|"), ord(";")))
        items = np.bincount(self.a_row, minlength=self.rows) + np.bincount(self.b_row, minlength=self.rows)
        bounds = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(items)))]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield out[x : max(x, y - 1)].tobytes()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of ids per text: the text, the pair (id of A times size of B's
        vocabulary, plus id of B) and how many links hold it."""
        ids = len(self.aligner.b.bytes)
        code = self.a_id[self.link_a] * ids + self.b_id[self.link_b]
        span = len(self.aligner.a.bytes) * ids
        key, times = np.unique(self.link_row * span + code, return_counts=True)
        return key // span, key % span, times


_cache: dict[int, Aligner] = {}


def _ready(blobs: tuple[str, bytes]) -> Aligner:
    """The tokenizers of this worker, made once."""
    key = zlib.crc32(blobs[1], zlib.crc32(blobs[0].encode()))
    if key not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _cache.clear()
        _cache[key] = Aligner(*blobs)
    return _cache[key]


def _slices(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[tuple[pa.Array, Aligned]]:
    """doc_id and alignment of slices of whole texts. Batches: doc_id, text."""
    for batch in batches:
        sizes = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
            part = batch.slice(at, to - at)
            yield part.column(0), Aligned(aligner, [t or "" for t in part.column(1).to_pylist()])
            at = to


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def _lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """One list per row of values that are in order of row."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, a_last array<boolean>, b_last array<boolean>"


def alignments(docs: DataFrame, shared) -> DataFrame:
    """The tokens, links and groups of each text (doc_id, text): a_ids and b_ids; link_a and
    link_b, the linked tokens' numbers in those; a_last and b_last, which tokens end a group."""

    def run(batches):
        for doc_id, found in _slices(batches, _ready(shared.value)):
            def lists(values, row, kind):
                return _lists(values, row, found.rows, kind)

            firsts = [np.concatenate(([0], np.cumsum(np.bincount(r, minlength=found.rows)))) for r in (found.a_row, found.b_row)]
            columns = [
                doc_id,
                lists(found.a_id.astype(np.int32), found.a_row, pa.int32()),
                lists(found.b_id.astype(np.int32), found.b_row, pa.int32()),
                lists((found.link_a - firsts[0][found.link_row]).astype(np.int32), found.link_row, pa.int32()),
                lists((found.link_b - firsts[1][found.link_row]).astype(np.int32), found.link_row, pa.int32()),
                lists(found.a_last, found.a_row, pa.bool_()),
                lists(found.b_last, found.b_row, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "link_a", "link_b", "a_last", "b_last"])

    return _sized(docs).mapInArrow(run, LINKS)


STAGED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, "
    "codes array<long>, totals array<long>"
)


def _blocks(docs: DataFrame, shared) -> DataFrame:
    """Rows of two kinds. Documents: counts, digest, and at and times, the places of their
    distinct pairs in their block's list and how many links hold each. Blocks: codes and totals,
    the block's distinct pairs and their links."""
    from pyspark import TaskContext

    def run(batches):
        number, held, links = TaskContext.get().partitionId() << 32, [], 0
        schema = pa.schema([(n, t) for n, t in _types()])

        def flush():
            nonlocal number, held, links
            codes, place = np.unique(np.concatenate([p[1] for _, _, p in held]), return_inverse=True)
            totals = np.bincount(place, np.concatenate([p[2] for _, _, p in held]), len(codes)).astype(np.int64)
            at = 0
            for doc_id, columns, (row, code, times) in held:
                here = place[at : at + len(code)]
                at += len(code)
                rows = len(doc_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, number), pa.int64()),
                        doc_id.cast(pa.int64()),
                        *columns,
                        _lists(here.astype(np.int32), row, rows, pa.int32()),
                        _lists(times.astype(np.int32), row, rows, pa.int32()),
                        pa.nulls(rows, pa.list_(pa.int64())),
                        pa.nulls(rows, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )
            last = [pa.array([number], pa.int64()), *(pa.nulls(1, f.type) for f in list(schema)[1:9]), pa.array([codes], schema.field("codes").type), pa.array([totals], schema.field("totals").type)]
            yield pa.RecordBatch.from_arrays(last, schema=schema)
            number, held, links = number + 1, [], 0

        for doc_id, found in _slices(batches, _ready(shared.value)):
            counts = found.counts()
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.group_texts()]
            held.append((doc_id, [*(pa.array(counts[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests, pa.string())], found.pairs()))
            links += len(found.link_a)
            if links >= BLOCK_LINKS:
                yield from flush()
        if held:
            yield from flush()

    return _sized(docs).mapInArrow(run, STAGED)


def _types() -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return [(name, kinds[kind]) for name, kind in (c.split(" ") for c in STAGED.split(", "))]


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the counts of their pairs. ``pairs``: the block's, in any order."""
    place = np.zeros(pairs.num_rows, np.int64)
    place[pairs.column("place").to_numpy()] = np.arange(pairs.num_rows)
    count, best = (pairs.column(c).to_numpy()[place] for c in ("count", "best"))
    documents = documents.combine_chunks()
    at = documents.column("at").combine_chunks()
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
    where, times = at.flatten().to_numpy(), documents.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    sums = {"n_best": np.zeros(len(at), np.int64), "count_sum": np.zeros(len(at), np.int64)}
    np.add.at(sums["n_best"], row, times * best[where])
    np.add.at(sums["count_sum"], row, times * count[where])
    return pa.table({c: sums.get(c, documents.column(c) if c in documents.column_names else None) for c in (x.split(" ")[0] for x in RESULT.split(", "))})


def pair_counts(blocks: DataFrame, b_ids: int) -> DataFrame:
    """block, place, code, count (links of the pair in the corpus) and best (1 if no pair of its id of B has more)."""
    pairs = blocks.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "totals")).alias("place", "pair"))
    pairs = pairs.select("block", "place", F.col("pair.codes").alias("code"), F.col("pair.totals").alias("n"))
    # one row per pair of ids; an id of B has at most as many as A has ids
    summed = pairs.groupBy("code").agg(F.sum("n").alias("count"))
    top = F.max("count").over(W.partitionBy(F.col("code") % b_ids))
    known = summed.withColumn("best", (F.col("count") == top).cast("long"))
    return pairs.select("block", "place", "code").join(known, "code")


def alignment_counts(docs: DataFrame, shared) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): tokens, groups, links, and how common its linked pairs are."""
    blocks = stage(_blocks(docs, shared), "aligned")
    b_ids = len(parse(shared.value[1])["pieces"])
    pairs = pair_counts(blocks, b_ids).select(F.col("block").alias("of_block"), "place", "count", "best")
    documents = blocks.where("codes is null").drop("codes", "totals")
    return documents.groupBy("block").cogroup(pairs.groupBy("of_block")).applyInArrow(_scored, RESULT)


def paths() -> tuple[str, str]:
    import public_tokenizers

    a, b = os.environ.get("ALIGN_TOKENIZER_A"), os.environ.get("ALIGN_TOKENIZER_B")
    return a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"), shared_models(spark, *paths()))

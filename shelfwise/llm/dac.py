"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of the ids that have one, and so on. A bitmap per level
tells which chunks continue; a rank directory counts its ones before each block of 512
bits. The place of a token's next chunk is the rank of its bit, so any token is read by a
few lookups, without decoding a block. One file (a shard) holds the documents of a run of
ascending doc_id, with their ids and token offsets.

File: magic ``DAC1``; then little-endian uint32: chunk bits, levels, documents; uint64:
tokens; then doc_id (int64 each), token offsets (uint64, documents + 1), and per level:
uint64 entries, chunks (uint8), bitmap (packed, low bit first), rank directory (uint64).

Texts are sorted by range, so each task writes whole shards; a shard is written under a
temporary name and renamed, hence a retried task replaces it with the same bytes. Null
texts count as empty, null ids come first, and rows that repeat an id keep an order by text.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shelfwise.session import run_dir

from .common import arrow_map, table
from .pieces import WordEncoder

CHUNK, BLOCK = 8, 512
MAGIC = b"DAC1"
#: A shard is closed at the end of the slice of texts in which it reaches this many tokens.
SHARD_TOKENS = 4_000_000
NULL_ID = -(1 << 63)
#: Tasks per core that read shards, if there are as many.
READ_TASKS = 4


def pack(ids: np.ndarray, docs: np.ndarray, offsets: np.ndarray) -> bytes:
    """A shard: ids of all tokens, doc_id of each document, its token offsets (one more)."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> np.uint32(CHUNK) > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[more] >> np.uint32(CHUNK)
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IIIQ", CHUNK, len(levels), len(docs), len(ids))
    return head + docs.astype("<i8").tobytes() + offsets.astype("<u8").tobytes() + b"".join(levels)


class Shard:
    """Random access to the tokens of a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        chunk, levels, docs, self.tokens = struct.unpack_from("<IIIQ", data, 4)
        self.chunk, at = chunk, 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.docs, self.offsets = take("<i8", docs), take("<u8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK) + 1)))

    def token(self, i: int) -> int:
        """Token number ``i`` of the shard."""
        value = 0
        for level, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (level * self.chunk)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(rank[block]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """Ids of all tokens."""
        value = np.zeros(self.tokens, np.uint32)
        where: slice | np.ndarray = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            value[where] |= chunks.astype(np.uint32) << np.uint32(level * self.chunk)
            more = np.flatnonzero(np.unpackbits(bits, bitorder="little")[: len(chunks)])
            where = more if level == 0 else where[more]
        return value


def _store(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _write(path: str, data: bytes) -> None:
    store, name = _store(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, name)


def _read(path: str) -> bytes:
    store, name = _store(path)
    with store.open_input_stream(name) as f:
        return f.readall()


def write(docs: DataFrame, path: str, encoder: WordEncoder, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards below ``path``. Returns the
    manifest (file, first_start: tokens of all shards before it, tokens, docs), stored there too."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    shared = encoder.share(spark)

    def each(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, names, ends, held = [], [], [], 0

        def flush():
            nonlocal ids, names, ends, held, number
            file = f"{path}/shards/part-{part:06d}-{number:06d}.dac"
            lengths = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            _write(file, pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(names), offsets))
            row = {"file": [file], "part": [part], "number": [number], "tokens": [held], "docs": [len(lengths)]}
            ids, names, ends, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, schema=manifest_schema)

        manifest_schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("tokens", pa.int64()), ("docs", pa.int64())])
        worker = shared.value.ready()
        for batch in batches:
            for first, lengths, found in worker.encode(batch.column(1), end_id):
                # cut after the document that reaches the bound
                names.append(batch.column(0).slice(first, len(lengths)).fill_null(NULL_ID).to_numpy())
                ids.append(found)
                ends.append(lengths)
                held += len(found)
                if held >= SHARD_TOKENS:
                    yield flush()
        if names:
            yield flush()

    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
    rows = placed.mapInArrow(each, "file string, part int, number int, tokens long, docs long")
    rows.write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    # one row per shard of millions of tokens
    before = F.sum("tokens").over(W.Window.orderBy("part", "number").rowsBetween(W.Window.unboundedPreceding, -1))
    stored.withColumn("first_start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema("file string, part int, number int, tokens long, docs long, first_start long").parquet(f"{path}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def each(batch: pa.RecordBatch):
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = Shard(_read(file))
            ids, offsets = shard.all().astype("<u4"), shard.offsets.astype(np.int64)
            names = pa.array(shard.docs, mask=shard.docs == NULL_ID)
            yield {
                "doc_id": names,
                "start": offsets[:-1] + base,
                "n_tokens": np.diff(offsets),
                "ids_crc32": np.array([zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64),
            }

    # by number: adaptive execution would put all rows, a hundred bytes each, into one task
    tasks = min(manifest.count(), READ_TASKS * manifest.sparkSession.sparkContext.defaultParallelism)
    many = manifest.select("file", "first_start").repartition(max(1, tasks), "file")
    return arrow_map(many, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return os.environ.get("OUTPUT_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "token-files")
    return read(write(table(spark, sf_dir, "documents"), path, WordEncoder(tokenizer_path()), 1))

"""SentencePiece models on the tokenizers library, with every result compared.

The driver parses the model's protobuf and rebuilds it as a tokenizers pipeline:
normaliser (its character map, extra spaces, dummy prefix), the space marker, unigram
scores or merges in the order of the pieces' scores, byte fallback, and the decoder.
Tasks get that pipeline and the model as two broadcast blobs, encode batches with
several threads, and compare each result with the original library's. A text for which
the two differ gets the original's ids and ``parity`` false, so ids are always right.
If no piece of the model goes on after the end of a word, words are encoded and compared
once per task and joined; other models encode whole texts.

Null texts count as empty and have no ids. ``round_trip`` tells whether decoding gives
the text back; it is false where the model's normaliser changes the text, and for texts
that contain the space marker itself.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .pieces import Pieces
from .words import texts

MARK = "▁"
THREADS = 2
UNIGRAM, BPE = 1, 2
#: Types of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse(model: bytes) -> dict:
    """Pieces (text, score, type) and the settings that encoding needs."""
    out = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk": 0, "charsmap": b"", "prefix": True, "squeeze": True, "suffix": False}
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out["pieces"].append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            out |= {"type": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0)), "unk": trainer.get(40, 0), "suffix": bool(trainer.get(24, 0))}
        elif number == 3:
            rule = dict(fields(value))
            out |= {"charsmap": rule.get(2, b""), "prefix": bool(rule.get(3, 1)), "squeeze": bool(rule.get(4, 1))}
    if out["type"] not in (UNIGRAM, BPE) or out["suffix"]:
        raise ValueError("only unigram and BPE models with a leading space marker are supported")
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best scores first."""
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in (CONTROL, UNKNOWN, UNUSED, BYTE)}
    found = []
    for piece, i in rank.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                found.append((-pieces[i][1], i, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def words_apart(spec: dict) -> bool:
    """Whether no piece holds the end of a word and the marker of the next."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in spec["pieces"] if kind in (NORMAL, USER))


def by_words(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, one after the other."""
    plain = not spec["charsmap"] and not spec["squeeze"] and spec["byte_fallback"]
    return plain and words_apart(spec) and all(kind != USER for _, _, kind in spec["pieces"])


def build(model: bytes):
    """The tokenizers pipeline of a SentencePiece model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parse(model)
    pieces = spec["pieces"]
    if spec["type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], spec["unk"], spec["byte_fallback"])
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(pieces)},
            merges(pieces),
            unk_token=pieces[spec["unk"]][0],
            fuse_unk=True,
            byte_fallback=spec["byte_fallback"],
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(" ")] if spec["prefix"] else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if words_apart(spec):  # no piece crosses into the next word, so words can be looked up one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec["prefix"] else [])]
    )
    return tokenizer


class Codec:
    """Both libraries' forms of a model; what a task knows of its words."""

    def __init__(self, blob: tuple[str, bytes], threads: int):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer, self.threads = Tokenizer.from_str(blob[0]), threads
        self.original = sentencepiece.SentencePieceProcessor(model_proto=blob[1])
        spec = parse(blob[1])
        self.prefix, self.by_words, self.words = spec["prefix"], by_words(spec), Pieces(self.compared)

    def compared(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and ids as the rebuilt tokenizer gives them, or the original library where it differs;
        whether both agree, and whether the ids decode to the text."""
        rebuilt = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        original = self.original.encode(own, num_threads=self.threads)
        agree = [x == y for x, y in zip(rebuilt, original)]
        ids = [x if same else y for x, y, same in zip(rebuilt, original, agree)]
        back = [a == b for a, b in zip(self.tokenizer.decode_batch(ids, skip_special_tokens=False), own)]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        return lengths, flat, np.array((agree, back)).T

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row, ids per row, all ids and flags per row, for one slice of rows after the other."""
        for text in texts(column, lower=False):
            if not self.by_words:
                yield text.first, *self.compared(column.slice(text.first, text.rows).to_pylist())
                continue
            space = text.data == 32
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            ends = text.offsets[1:][np.diff(text.offsets) > 0]
            begin[ends - 1] = False  # a single space at the end stays with its word: alone it would be no text
            heads = text.offsets[:-1][np.diff(text.offsets) > 0]
            begin[heads] = True
            start = np.flatnonzero(begin)
            end = np.append(start[1:], len(text.data))[: len(start)]
            first = np.isin(start, heads, assume_unique=True)
            # the libraries put a marker before what they get: a later word brings its own
            skip = np.where(first | (not self.prefix), 0, 1)
            place = self.words.find(text.hashes(start, end) << np.uint64(1) | first.astype(np.uint64), lambda i: text.string(start[i] + skip[i], end[i]))
            n, ids = self.words.joined(place)
            row = np.searchsorted(text.offsets, start, "right") - 1
            flags = np.ones((text.rows, 2), bool)
            if len(place):
                flags[:] = np.stack([np.bincount(row, ~self.words.flags[place, k], text.rows) == 0 for k in (0, 1)], axis=1)
            yield text.first, np.bincount(row, n, text.rows).astype(np.int64), ids, flags


_cache: dict[tuple[int, int], Codec] = {}


def _ready(blob: tuple[str, bytes], threads: int) -> Codec:
    """The model in this worker, made once."""
    key = zlib.crc32(blob[1]), threads
    if key not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        _cache.clear()
        _cache[key] = Codec(blob, threads)
    return _cache[key]


def load(spark: SparkSession, path: str):
    """Reads a model on the driver and shares it with all tasks. A plain path; half a megabyte is typical."""
    with open(path, "rb") as f:
        model = f.read()
    return spark.sparkContext.broadcast((build(model).to_str(), model))


def encode(docs: DataFrame, shared, text: str = "text", threads: int = THREADS) -> DataFrame:
    """``docs`` with ids (array of int), parity and round_trip; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "parity", "round_trip")])
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("ids array<int>, parity boolean, round_trip boolean").fields])

    def each(batches):
        codec = _ready(shared.value, threads)
        for batch in batches:
            for first, n, ids, flags in codec.encode(batch.column(names.index(text)).fill_null("")):
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, len(n)).columns, lists, pa.array(flags[:, 0]), pa.array(flags[:, 1])],
                    names=[*names, "ids", "parity", "round_trip"],
                )

    return docs.mapInArrow(each, schema)


def decode(encoded: DataFrame, shared, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text of its ids; null ids give an empty text."""
    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded"])
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def each(batches):
        tokenizer = _ready(shared.value, THREADS).tokenizer
        for batch in batches:
            rows = [x or [] for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokenizer.decode_batch(rows, skip_special_tokens=False), pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(each, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as comma-joined digits), parity and round_trip."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(joined.cast("binary")).alias("ids_crc32"), "parity", "round_trip")


def model_path() -> str:
    import public_tokenizers

    return os.environ.get("SENTENCEPIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode(docs, load(spark, model_path())))

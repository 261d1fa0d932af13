import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from llm_cases import awkward, make, prose  # noqa: F401
from tokenizers import Tokenizer

from shelfwise.llm import dac, pieces, sentencepiece_codec, token_counts
from shelfwise.session import run_dir


def whole(name, texts):
    t = Tokenizer.from_file(P.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_counts_and_cache(spark, make, awkward):
    tokens = token_counts.Tokens(spark, P.path("byte_bpe_50k.json"))
    cache = run_dir(spark, "cache")
    want = Counter((i, len((t or "").encode()), len(n)) for (i, t), n in zip(awkward, whole("byte_bpe_50k.json", [t for _, t in awkward])))
    got = token_counts.token_counts(make(awkward), tokens, cache)
    assert Counter(tuple(r) for r in got.collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in awkward})
    # a second run finds all but the new text, one of a wrong count stays
    spark.createDataFrame([("f" * 64, "other", 5)], token_counts.CACHE).write.mode("append").parquet(cache)
    more = [*awkward, (50, "a new text"), (51, "a new text")]
    assert token_counts.token_counts(make(more), tokens, cache).count() == len(more)
    assert spark.read.parquet(cache).count() == stored + 2
    assert token_counts.token_counts(make([]), tokens, cache).count() == 0


def test_counts_of_a_sentencepiece_model(spark, make):
    tokens = token_counts.Tokens(spark, P.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(make([(1, "ab cd"), (2, None)]), tokens, run_dir(spark, "cache")).collect()
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0


def test_pieces_equal_the_library(awkward):
    import pyarrow as pa

    texts = [t for _, t in awkward] + ["ǅ İ ſs Å. x×. ÷, «b» 12a-3", "İstanbul ΣΑΣ. Σ", "<|STARTOFTEXT|>x", "don't've 'twas ''s", "á. é,"]
    encoder = pieces.WordEncoder(P.path("word_bpe_49k.json")).ready()
    got = []
    for _, n, ids in encoder.encode(pa.array(texts), 1):
        got += np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in got] == [[*x, 1] for x in whole("word_bpe_49k.json", texts)]
    with pytest.raises(ValueError):
        pieces.WordEncoder(P.path("byte_bpe_50k.json"))


def test_codes_are_addressed_directly():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 1 << 32, 3000), rng.integers(0, 200, 1000), np.array([0, 255, 256, 65535, 65536, 2**32 - 1]), np.zeros(0)):
        shard = dac.Shard(dac.pack(ids.astype(np.uint32), np.array([7]), np.array([0, len(ids)])))
        assert (shard.all() == ids).all() and [shard.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    with pytest.raises(ValueError):
        dac.Shard(b"something else")


def test_files_hold_every_document_in_order(spark, make, awkward):
    path = run_dir(spark, "files")
    manifest = dac.write(make(awkward), path, pieces.WordEncoder(P.path("word_bpe_49k.json")), 1)
    got = dac.read(manifest).collect()
    key = lambda d: (d[0] is not None, d[0] or 0, d[1] or "")
    ordered = sorted(awkward, key=key)
    start, want = 0, []
    for (i, _), ids in zip(ordered, whole("word_bpe_49k.json", [t for _, t in ordered])):
        ids = np.array([*ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[1:] for r in got) == sorted(w[1:] for w in want) and Counter(r.doc_id for r in got) == Counter(w[0] for w in want)
    assert manifest.count() >= 1 and not [f for f in os.listdir(f"{path}/shards") if f.endswith(".tmp")]
    assert dac.read(dac.write(make([]), run_dir(spark, "files"), pieces.WordEncoder(P.path("word_bpe_49k.json")), 1)).count() == 0


def test_sentencepiece_equals_the_original(spark, make, awkward):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    docs = [*awkward, (60, "  two  spaces  "), (61, " "), (62, "▁ marks ▁▁x"), (63, "aaaa aaaaaaa abababab"), (64, " ".join(prose(3, 300)))]
    shared = sentencepiece_codec.load(spark, model)
    encoded = sentencepiece_codec.encode(make(docs), shared)
    got = sentencepiece_codec.decode(encoded, shared).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(processor.encode(t or ""))) for i, t in docs)
    assert all(r.parity for r in got)
    assert all((r.decoded == (r.text or "")) == r.round_trip and (r.round_trip or r.doc_id == 62) for r in got)
    assert got[0].source == "s" and sentencepiece_codec.encode(make([]), shared).count() == 0


def test_unigram_models_are_rebuilt():
    def field(number, kind, data):
        head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return head + (bytes([len(data)]) + data if kind == 2 else data)

    import struct

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    model = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    model += b"".join(piece(p, s, 1) for p, s in (("▁", -3), ("a", -2), ("b", -2.5), ("▁ab", -1), ("ab", -1.5), ("aab", -9)))
    model += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_proto=model)
    rebuilt = sentencepiece_codec.build(model)
    for text in ("ab ab", "aabab", "  b", "é ab", "", "aaab"):
        assert rebuilt.encode(text, add_special_tokens=False).ids == original.encode(text)
        assert rebuilt.decode(original.encode(text), skip_special_tokens=False) == text


def test_shards_are_read_by_several_tasks(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dac, "SHARD_TOKENS", 1)  # a shard per slice of texts
    docs = [(k, " ".join(prose(k, 60_000))) for k in range(12)]
    manifest = dac.write(make(docs), run_dir(spark, "shards"), pieces.WordEncoder(P.path("word_bpe_49k.json")), 1)
    assert manifest.count() >= 4
    read = dac.read(manifest)
    assert read.select(F.spark_partition_id()).distinct().count() > 1  # not put together by adaptive execution
    assert [r.doc_id for r in read.orderBy("start").collect()] == list(range(12))


def test_known_pieces_take_few_bytes(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(pieces, "KEEP", 250_000)
    rng = np.random.default_rng(1)
    known = pieces.Pieces(lambda new: (np.ones(len(new), np.int64), np.array(new, np.uint32), np.zeros((len(new), 0), bool)))
    hashes = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    tracemalloc.start()
    for k in range(0, len(hashes), 20_000):
        some = np.concatenate((hashes[k : k + 20_000], hashes[: k // 2]))
        names = np.concatenate((np.arange(k, k + 20_000), np.arange(k // 2)))
        assert (known.joined(known.find(some, lambda i: names[i]))[1] == names).all()
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 50 * len(hashes)
    for k in range(3):  # what is kept stays bounded
        found = known.find(rng.integers(0, 1 << 63, 200_000).astype(np.uint64), lambda i: i)
        assert (known.joined(found)[1] == np.arange(200_000)).all() and len(known.known) <= pieces.KEEP + 200_000

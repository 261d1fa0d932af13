"""Token counts with a digest cache.

The cache is a Parquet table (digest of the content, tokenizer version, n_tokens) in a
shared folder. Counting joins the digests of the texts to it, encodes one text per
digest that is missing, appends those counts, and joins again. The tokenizer version
is the digest of its file, so a changed file never meets old counts. Content is
compared as it is, without any normalisation: with a byte-level tokenizer every byte
can change the count. Appended files are complete or absent (Spark's commit), and a
digest that two runs append at once is counted once when read.

Null texts count as empty. Rows keep their order of columns; ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import run_dir

from .common import arrow_map, table
from .words import texts

LIMIT = 1024
CACHE = "digest string, version string, n_tokens long"


class Tokens:
    """A tokenizer file of the tokenizers or sentencepiece library, shared with all tasks."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.version = hashlib.sha256(data).hexdigest()[:32]
        self.shared = spark.sparkContext.broadcast((path.endswith(".model"), data))


_ready: dict[str, object] = {}


def counter(version: str, blob: tuple[bool, bytes]):
    """A function from a list of texts to their numbers of tokens, made once per worker."""
    if version not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if blob[0]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=blob[1])
            _ready[version] = lambda rows: [len(x) for x in model.encode(rows, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_buffer(blob[1])
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _ready[version] = lambda rows: [len(x) for x in tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    return _ready[version]


def encode_misses(misses: DataFrame, tokens: Tokens) -> DataFrame:
    """digest and n_tokens of ``misses`` (digest, text)."""
    version, shared = tokens.version, tokens.shared

    def each(batch: pa.RecordBatch):
        count = counter(version, shared.value)
        column = batch.column(1).fill_null("")
        for part in texts(column, lower=False):
            yield {
                "digest": batch.column(0).slice(part.first, part.rows),
                "n_tokens": np.array(count(column.slice(part.first, part.rows).to_pylist()), np.int64),
            }

    return arrow_map(misses, each, "digest string, n_tokens long")


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of a tokenizer version; an absent cache is empty."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)  # makes the folder
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokens: Tokens, cache: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens. Appends to the cache."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    stored = read_cache(spark, cache, tokens.version)
    # one text per digest: copies meet in the map task where they can, before the shuffle
    misses = keyed.select("digest", "text").join(stored, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    found = encode_misses(misses, tokens)
    found.select("digest", F.lit(tokens.version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, tokens.version)
    narrow = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def tokenizer_path() -> str:
    import public_tokenizers

    return os.environ.get("COUNT_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """A cold start: the query fills a cache of its own, so every run does the whole work."""
    counts = token_counts(table(spark, sf_dir, "documents"), Tokens(spark, tokenizer_path()), run_dir(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)

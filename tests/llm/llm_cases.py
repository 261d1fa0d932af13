"""Awkward inputs and helpers of these tests."""

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, label string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def rows(pairs):
    return [(i, t, "en", "s", len(t or ""), "k", 1, "x") for i, t in pairs]


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnprst") + str(rng.randint(0, 30)) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, very long, repeated and odd texts, and rows of one id."""
    long = " ".join(prose(1, 30_000))
    return [
        (None, "an old row without an id and with some words"),
        (1, None),
        (2, ""),
        (3, " \n\n \t"),
        (4, long),
        (5, "Été à l'œuvre, naïve café. ΣΊΣΥΦΟΣ и Москва 日本語テキスト 😀 é"),
        (6, "The same text twice, with enough words to be a shingle."),
        (7, "The same text twice, with enough words to be a shingle."),
        (7, "The same text twice, with enough words to be a shingle."),
        (8, "one id"),
        (8, "two texts of one id"),
        (9, "<|endoftext|> <|startoftext|> <s> </s> a\x00b\x01c\x1cd e　f it's we're 'st x.y"),
        (10, "word " * 3000),
    ]


@pytest.fixture(scope="session")
def make(spark):
    def build(pairs):
        return spark.createDataFrame(rows(pairs), DOCS)

    return build


@pytest.fixture
def documents(make, tmp_path):
    """Writes documents with clashing extra columns and gives the folder that queries take."""

    def build(pairs):
        make(pairs).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return build

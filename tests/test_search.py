"""Gram search against ``in`` on small tables, and what it reads."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import search as G
from shelfwise.session import run_dir

TEXTS = [
    (1, "Vitamin C 1000 mg"), (2, "vitamin d3"), (3, ""), (4, None), (5, "aaa"), (6, "  spaced   out  "),
    (7, "emoji 😀 face 😀😀"), (8, "Κρέμα προσώπου SPF 30"), (9, "line\nbreak\n\nmin"), (None, "vitamin without an id"),
    (10, "vitamin d3"), (11, "x" * 50_000 + "needle" + "y" * 50_000), (12, "100% [a-z] (min)"), (13, "one id"), (13, "one id, vitamin"),
]
TERMS = [
    "vitamin", " VITAMIN ", "min", "in", "a", "", "   ", None, "aaaa", "aaa", "😀", "😀 f", "😀😀", "κρέμα", "k\nb", "e\nb", "needle", "xneedley",
    "[a-z]", "%", "no such text", "one id, vitamin", "d3",
]


def brute(texts, terms):
    out = set()
    for t in terms:
        needle = (t or "").lower().strip(" ")
        out |= {(t, i) for i, text in texts if i is not None and needle in (text or "").lower()}
    return out


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(TEXTS, "key long, words string").withColumn("id", F.lit("clash"))


def test_equals_plain_containment(spark, rows):
    index = G.write_index(rows, "key", "words", run_dir(spark, "grams"))
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = [(r.term, r.id) for r in G.search_terms(rows, "key", "words", index, terms).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(TEXTS, TERMS)


def test_only_the_folders_of_wanted_grams_are_read(spark, rows):
    index = G.write_index(rows, "key", "words", run_dir(spark, "grams"))
    needles = spark.createDataFrame([("vitamin",), ("no such text",)], "needle string")
    wanted = G.rarest_grams(index, needles)
    listed = wanted.collect()
    assert {r.needle for r in listed} == {"vitamin"} and len(listed) == G.RAREST
    found = G.candidates(index, wanted)
    text = found._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert all(str(r.bucket) in filters for r in listed) and len({r.bucket for r in listed}) < G.BUCKETS / 2
    assert {r.id for r in found.collect()} == {1, 2, 10, 13}


def test_common_grams_are_dealt_to_several_files(spark):
    rows = spark.range(2_000).select("id", F.lit("same").alias("words"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for large tables
    try:
        index = G.write_index(rows, "id", "words", run_dir(spark, "grams"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    bucket = spark.range(1).select(G.bucket_of(F.lit("sam"))).first()[0]
    assert len([f for f in index.postings.inputFiles() if f"bucket={bucket}/" in f]) > 1
    assert {r.gram: r.n for r in index.counts.collect()} == {"sam": 2_000, "ame": 2_000}


def test_empty_tables(spark, rows):
    index = G.write_index(rows.limit(0), "key", "words", run_dir(spark, "grams"))
    terms = spark.createDataFrame([("vitamin",), ("a",)], "term string")
    assert G.search_terms(rows.limit(0), "key", "words", index, terms).count() == 0
    index = G.write_index(rows, "key", "words", run_dir(spark, "grams"))
    assert G.search_terms(rows, "key", "words", index, terms.limit(0)).count() == 0


def test_postings_are_bits_of_blocks_not_rows(spark):
    """A gram that all rows hold takes one posting per block; full homes go on in a second block; each row is found."""
    rows = spark.range(3_000).selectExpr("id", "if(id % 7 = 0, 'same words', 'same') AS words").union(spark.sql("SELECT 5L, 'same other'"))
    index = G.write_index(rows, "id", "words", run_dir(spark, "grams"))
    lists = index.postings.groupBy("gram").count().collect()
    assert {r.gram: r["count"] for r in lists}["ame"] <= 3_000 / 16
    n = {r.gram: r.n for r in index.counts.collect()}
    assert (n["sam"], n["wor"], n["oth"]) == (3_001, 429, 1)
    assert index.members.select("block", "place").distinct().count() == 3_001 and index.members.agg(F.max("place")).first()[0] < G.PLACES
    terms = spark.createDataFrame([("same",), ("me w",), ("other",), ("me",), ("zz",)], "term string")
    got = {}
    for r in G.search_terms(rows, "id", "words", index, terms).collect():
        got.setdefault(r.term, []).append(r.id)
    assert {t: sorted(x) for t, x in got.items()} == {"same": [*range(3_000)], "me w": [*range(0, 3_000, 7)], "other": [5], "me": [*range(3_000)]}


def test_pieces_hold_each_gram(spark):
    texts = {n: "".join(chr(0x1F600 + k) if k % 5 == 0 else chr(0x3B1 + k % 24) if k % 3 else f"\n{n % 10}"[k % 2] for k in range(n)) for n in (*range(5), *range(31, 37), *range(62, 70), 200)}
    index = G.write_index(spark.createDataFrame([*texts.items()], "id long, words string"), "id", "words", run_dir(spark, "grams"))
    held = {n: set() for n in texts}
    for r in index.postings.join(index.members, "block").where("getbit(bits, place) = 1").collect():
        held[r.id].add(r.gram)
    assert held == {n: {t[k : k + 3] for k in range(n - 2)} for n, t in texts.items()}


def test_many_short_terms_and_few_give_the_same(spark, rows, monkeypatch):
    index = G.write_index(rows, "key", "words", run_dir(spark, "grams"))
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    monkeypatch.setattr(G, "COMPARED", 0)
    assert {(r.term, r.id) for r in G.search_terms(rows, "key", "words", index, terms).collect()} == brute(TEXTS, TERMS)

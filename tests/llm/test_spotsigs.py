import hashlib
import re

import pytest
from conftest import SF_DIR
from llm_cases import awkward, documents, make, prose  # noqa: F401
from pyspark.sql import functions as F

from shelfwise.llm import spotsigs
from shelfwise.llm.queries import QUERIES


def spots(text):
    words = re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " " + text.lower())
    content = [i for i, w in enumerate(words) if w and w not in spotsigs.ANCHORS]
    return {
        (words[i], *(words[p] for p in content[m : m + spotsigs.CHAIN]))
        for m, p in enumerate(content)
        for i in range(content[m - 1] + 1 if m else 0, p)
    }


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
    out = []
    for k, (i, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        own = spots(text)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, spots(edited)), jaccard(own, spots(other)), len(own)))
    return sorted(out, key=str)


def checked(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_spots) for r in rows), key=str)


@pytest.mark.parametrize("rows", [500, 2, 1])
def test_query_equals_brute_force(spark, documents, awkward, monkeypatch, rows):
    monkeypatch.setattr(spotsigs, "ROWS", rows)  # down to one range per id
    docs = [*awkward, (-(1 << 63), "The lowest id of all is here."), (None, ""), (30, "the a of and"), (31, "Nur der die das Haus am See")]
    got = QUERIES["op13_spot_fingerprints"](spark, documents(docs))
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert checked(rows) == brute_force(docs)
    assert all(r.fingerprint.count(",") + 1 == r.n_spots for r in rows if r.n_spots) and all(r.fingerprint == "" for r in rows if not r.n_spots)
    same = {r.fingerprint for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op13_spot_fingerprints"](spark, SF_DIR).collect()
    assert checked(rows) == brute_force(docs)
    # a text is nearer to its edited form than to an unrelated one
    long = [r for r in rows if r.n_spots >= 10 and r.near_next < 0.1]
    assert len(long) > 50 and sum(r.near_edited > r.near_next for r in long) == len(long)


def test_sizes_prune_and_partition(spark):
    sets = [([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1], [1, 2, 3]), ([], []), ([], [1])]
    df = spark.createDataFrame(sets, "a array<long>, b array<long>")
    got = df.select(spotsigs.likeness("a", "b"), spotsigs.likeness("a", "b", 0.8)).collect()
    assert [tuple(r) for r in got] == [(0.8, 0.8), (1 / 3, 0.0), (1.0, 1.0), (0.0, 0.0)]
    sizes = spark.range(0, 3000).withColumn("s", F.sequence(F.lit(1), F.greatest("id", F.lit(1))))
    part = {r[0]: r[1] for r in sizes.select("id", spotsigs.length_partition("s")).collect()}
    assert all(part[n] - part[m] <= 1 for n in range(1, 3000) for m in range(-(-n * 8 // 10), n + 1) if m)


def test_plan_shuffles_texts_once_without_python(spark):
    plan = QUERIES["op13_spot_fingerprints"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("SortMergeJoin") == 0


def test_empty_table(spark, documents):
    assert QUERIES["op13_spot_fingerprints"](spark, documents([])).count() == 0

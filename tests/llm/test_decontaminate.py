import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm_cases import awkward, make, prose, words  # noqa: F401
from shelfwise.llm import decontaminate as D



def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= items_of - {None}
        out.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return out


def test_equals_brute_force(make, spark, awkward):
    a, b, c = prose(1, 30_000), prose(2, 40), prose(3, 25)
    items = [(0, " ".join(b)), (1, ". ".join(c).upper()), (2, " ".join(a[500:510])), (3, "te 1 xu"), (4, ""), (5, None),
             (6, " ".join(b[5:15])), (None, " ".join(c[:10])), (7, "zz " * 12), (8, "a b c d e")]
    docs = [
        *awkward,
        (20, " ".join(prose(4, 50) + b[3:20] + prose(5, 50) + b[3:20])),
        (21, " ".join(c[:9] + prose(6, 8) + c[10:19])),
        (22, "x te 1 xu te 1 xu"),
        (23, "zz " * 40),
        (24, " ".join(c[:10])),
        (25, "q a b c d e q"),
        (26, " ".join(a[495:515])),
        (27, " ".join(b[:5] + ["changed"] + b[6:])),
    ]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    got = D.contamination(make(docs), table).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got)
    assert got == Counter(brute(docs, items))


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:] for r in D.contamination(make([(1, "some words")]), none).collect()] == [(2, 0, [], False)]
    assert D.contamination(make([]), none).count() == 0


def test_any_shared_window_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(50):
        window = rng.integers(0, 5, 10).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        around = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in rng.integers(0, 20, 4)]
        one, two = (np.concatenate((around[i], window, around[i + 2])) for i in (0, 1))
        marks = [set(D.winnow(np.zeros(len(x), int), x)[1].tolist()) for x in (one, two)]
        assert marks[0] & marks[1]


def test_query_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(12)))), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(map(str, range(11)))), (9, " ".join(map(str, range(2, 12))))], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two = D.op7_decontamination(spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()
    assert tuple(one)[1:5] == (12, 12, 2, hashlib.sha256(b"10,9").hexdigest())
    assert tuple(two) == (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_texts_are_counted_in_one_pass_and_only_those_with_hits_are_shuffled(make, spark):
    b = prose(2, 40)
    docs = make([(1, " ".join(b)), (2, "İ Σ no hit\x00here 日本"), (2, None), (None, "a-b"), *((9 + k, " ".join(prose(9 + k, 30))) for k in range(20))])
    items = spark.createDataFrame([(7, " ".join(b[3:20]))], "item_id long, text string")
    found = D.contamination(docs, items)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in found.collect())
    assert {(1, 40, 17), (2, 6, 0), (2, 0, 0), (None, 2, 0)} <= set(got) and sum(got.values()) == 24


def test_more_hits_than_are_broadcast(make, spark, monkeypatch):
    b = prose(2, 40)
    docs = make([(k, " ".join(prose(k, 5) + b)) for k in range(4)])
    items = spark.createDataFrame([(7, " ".join(b))], "item_id long, text string")
    few = sorted(map(tuple, D.contamination(docs, items).collect()))
    monkeypatch.setattr(D, "KEY_ROWS", 1)
    assert few == sorted(map(tuple, D.contamination(docs, items).collect())) and len(few) == 4

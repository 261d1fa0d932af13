"""Precedence, keys and ties on small inline rows."""

from pyspark.sql import functions as F

from shelfwise.operators import layers as L
from shelfwise.operators import quality as Q
from shelfwise.operators import serve as S

BASE = "ordinal long, barcode string, name string"


def layer(spark, rows):
    return spark.createDataFrame(rows, "barcode string, name string, description string, image string")


def test_fields_fall_through_records_do_not(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "", "p"), (4, None, "p"), (5, "z", "p")], BASE)
    first = layer(spark, [("a", "", "d1", None), ("b", "n1", None, "")])
    second = layer(spark, [("a", "n2", "d2", "i2"), ("b", "n2", "d2", "i2"), ("", "no", "no", "no")])
    fields = ["name", "description", "image"]
    got = {r.ordinal: (r.layer_name, r.layer_description, r.layer_image) for r in L.cascade_fields(base, [first, second], fields).collect()}
    assert got == {1: ("n2", "d1", "i2"), 2: ("n1", "d2", "i2"), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}
    got = {r.ordinal: (r.layer_name, r.layer_description, r.layer_no) for r in L.cascade_records(base, [first, second], fields).collect()}
    assert got[1] == ("", "d1", 1) and got[2] == ("n1", None, 1) and got[5] == (None, None, None)


def test_variant_lookup_first_row_wins(spark):
    p = spark.createDataFrame([(2, "m", ["v"], "two"), (1, "v", ["m", "v"], "one"), (3, "", None, "three")],
                              "ordinal long, barcode string, variants array<string>, name string")
    q = spark.createDataFrame([(1, "m"), (2, "v"), (3, "x"), (4, None), (5, "")], "id long, code string")
    got = {r.id: r.name for r in L.by_any_code(p, q, "code", ["id"], ["name"]).collect()}
    assert got == {1: "one", 2: "one", 3: None, 4: None, 5: None}


def test_resolve_prefers_the_hint(spark):
    a = spark.createDataFrame([(2, "k", "a2"), (1, "k", "a1")], "ordinal long, code string, name string")
    b = spark.createDataFrame([(1, "k", "b1"), (2, "only", "b2")], "ordinal long, code string, name string")
    q = spark.createDataFrame([(1, "k", "b"), (2, "k", None), (3, "only", "a"), (4, "x", "a")], "id long, code string, hint string")
    got = {r.id: (r.catalog, r.name) for r in L.resolve(q, {"a": a, "b": b}, "code", "hint", ["id"], ["name"]).collect()}
    assert got == {1: ("b", "b1"), 2: ("a", "a1"), 3: ("b", "b2"), 4: (None, None)}


def test_upsert_and_dedupe(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 1)], "k string, version int")
    new = spark.createDataFrame([("b", 3), ("b", 2), ("c", 2)], "k string, version int")
    assert sorted(map(tuple, L.upsert_last(cur, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 2)]
    df = spark.createDataFrame([(3, "u"), (1, "u"), (2, "w")], "ordinal long, k string")
    assert sorted(map(tuple, L.dedupe_first(df, "k").collect())) == [(1, "u"), (2, "w")]


def test_worklist_modes(spark):
    base = spark.createDataFrame([(i, k, "p") for i, k in enumerate(["x", "o", "s", "", "oi"])], BASE).select("ordinal", "barcode")
    good = "λέξη " * 60
    over = layer(spark, [("o", "n", good, ""), ("oi", "n", good, "img")])
    supp = layer(spark, [("s", "n", "short", "img")])
    got = sorted((r.barcode or "", r.mode) for r in L.worklist(base, over, supp, ["filler"]).collect())
    assert got == sorted(
        [("x", "missing"), ("x", "force"), ("x", "flagged"), ("o", "missing"), ("o", "force"),
         ("s", "force"), ("s", "flagged"), ("s", "has-image"),
         ("", "missing"), ("", "force"), ("", "flagged"), ("oi", "has-image")]
    )


def test_related_counts_null_groups_as_one(spark):
    rows = [(i, None if i % 2 else "g", f"n{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "ordinal long, g string, name string")
    got = S.related(df, ["g"], ["name"], 3).where("ordinal in (1, 4)").orderBy("ordinal", "rank").collect()
    assert [(r.ordinal, r.related) for r in got] == [(1, 3), (1, 5), (1, 7), (4, 0), (4, 2), (4, 6)]


def test_related_fill_with_one_dominant_line(spark):
    rows = [(i, "b", "big") for i in range(30)] + [(30, "b", "small"), (31, "b", None), (32, "c", "big")]
    df = spark.createDataFrame(rows, "ordinal long, brand string, line string")
    got = {}
    for r in S.related_fill(df, "brand", "line", [], 6).orderBy("rank").collect():
        got.setdefault(r.ordinal, []).append(r.related)
    assert got[0] == [1, 2, 3, 4, 5, 6] and got[30] == got[31] and 32 not in got
    assert got[30] == [0, 1, 2, 3, 4, 5]


def test_pick_by_quality_looks_at_all_candidates(spark):
    g = lambda n: "λέξη " * n
    rows = [("a", 1, g(20)), ("a", 2, g(70)), ("a", 3, g(100))]
    rows += [("b", 1, g(20)), ("b", 2, g(40)), ("b", 3, None)]
    rows += [("c", i, g(10)) for i in range(8)] + [("c", 8, g(100))]
    df = spark.createDataFrame(rows, "k string, o long, t string")
    assert sorted((r.k, r.o) for r in Q.pick_by_quality(df, "k", "t", "o", ["filler"]).collect()) == [("a", 2), ("b", 2), ("c", 8)]


def test_search_blank_term_matches_all(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, None)], "ordinal long, name string")
    assert S.search(df, ["name"], "  ").count() == 2
    assert tuple(S.search_summary(df, ["name"], "aB").first()) == (1, 2)
    assert S.search(df, ["name"], "%").count() == 0


def test_price(spark):
    df = spark.createDataFrame([(12.5,), (0.0,)], "p double").select(S.display_price(F.col("p").cast("decimal(10,2)")))
    assert [r[0] for r in df.collect()] == ["12,50 €", "—"]

"""The score join against comparing every pair, on inputs built to be skewed."""

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import match as M
from shelfwise.operators.score_join import Measure, Weights, score_join

W = Weights(measures=(Measure("size", "", 3.0, -1.0), Measure("count", "", 2.0)), promo_only_right=-3.0, promo_both=2.0)


def score(l, r, w):
    total = 0.0
    for t in l["tokens"]:
        if t in r["strong"]:
            total += w.strong
        elif t in r["weak"]:
            total += w.weak
    for a, b, m in zip(l["ms"], r["ms"], w.measures):
        if a and b:
            total += m.equal if a == b else m.unequal
    if r["promo"]:
        total += w.promo_both if l["promo"] else w.promo_only_right
    return total


def brute(left, right, w, n, floor):
    out = []
    for l in left:
        ranked = sorted(((-score(l, r, w), r["ord"]) for r in right))[:n]
        out += [
            (l["lid"], o, -s, k) for k, (s, o) in enumerate(ranked, 1) if floor is None or -s >= floor
        ]
    return sorted(out)


def random_rows(seed, shape):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)]
    phrase = [f"brand{i}" for i in range(5)]

    def words(k):
        return sorted(set(rnd.choices(vocabulary, weights=[2.0 ** -i for i in range(14)], k=k)))

    def row(i, unique):
        if shape == "copies" and i % 3 == 0:
            return phrase[:3]
        if shape == "near-copies" and i % 3 != 2:
            return phrase + ([f"id{unique}{i}"] if i % 2 else words(1))
        return words(rnd.randint(0, 5))

    def measures():
        return [rnd.choice(["", "50ml", "50ml", "30ml"]), rnd.choice(["", "60caps", "30caps"])]

    left = [
        dict(lid=i, tokens=row(i, "l"), ms=measures(), promo=rnd.random() < 0.2) for i in range(70)
    ]
    right = []
    for i in range(90):
        strong = row(i, "r")
        weak = sorted(set(words(3)) - set(strong))
        right.append(dict(ord=1000 - 7 * i, strong=strong, weak=weak, ms=measures(), promo=rnd.random() < 0.3))
    return left, right


def frames(spark, left, right):
    l = spark.createDataFrame(left, "lid long, tokens array<string>, ms array<string>, promo boolean")
    r = spark.createDataFrame(
        right, "ord long, strong array<string>, weak array<string>, ms array<string>, promo boolean"
    )
    return l, r


@pytest.mark.parametrize(
    "shape,hot_rows,n,floor",
    [
        ("plain", 1000, 1, 3.0),
        ("plain", 2, 3, None),
        ("copies", 4, 1, None),
        ("copies", 8, 2, 3.0),
        ("near-copies", 1000, 1, 3.0),
        ("near-copies", 4, 1, None),
        ("near-copies", 2, 3, None),
    ],
)
def test_equals_every_pair(spark, shape, hot_rows, n, floor):
    left, right = random_rows(hot_rows, shape)
    l, r = frames(spark, left, right)
    got = sorted(map(tuple, score_join(l, r, W, n, floor, hot_rows).collect()))
    assert got == brute(left, right, W, n, floor)


def test_near_copies_do_not_multiply(spark):
    """400 x 400 rows that differ in one word each collapse to a single pair."""
    phrase = ["alpha", "beta", "gamma", "delta"]
    left = [dict(lid=i, tokens=[*phrase, f"l{i}"], ms=["", ""], promo=False) for i in range(400)]
    right = [dict(ord=i, strong=[*phrase, f"r{i}"], weak=[], ms=["", ""], promo=False) for i in range(400)]
    got = score_join(*frames(spark, left, right), W, 1, 3.0, hot_rows=50).collect()
    assert len(got) == 400 and {tuple(g)[1:] for g in got} == {(0, 8.0, 1)}


def test_weights_outside_the_bounds_are_refused():
    for bad in (dict(strong=0.1), dict(measures=(Measure("m", "", 0.0),)), dict(promo_only_right=1.0)):
        with pytest.raises(ValueError):
            Weights(**bad)


def names(spark, left, right):
    l = spark.createDataFrame(left, "ordinal long, name string")
    r = spark.createDataFrame(right, "ordinal long, name string, url string, section string")
    return l, r


def test_size_alone_reaches_the_threshold(spark):
    l, r = names(spark, [(1, "alpha 30ml")], [(5, "beta 40ml", "", "x"), (6, "gamma 30 ml", "", "x")])
    assert [tuple(x) for x in M.fuzzy_match(l, r, M.BY_SIZE).collect()] == [(1, 6, 3.0, 1)]


def test_promo_pairs(spark):
    site = [(1, "alpha beta", "", "s"), (2, "alpha beta δώρο", "", "s"), (3, "alpha beta", "/me-doro/", "s")]
    l, r = names(spark, [(10, "Alpha Beta"), (11, "alpha beta ΔΩΡΟ")], site)
    got = {x.lid: (x.ord, x.score) for x in M.fuzzy_match(l, r, M.BY_SIZE).collect()}
    assert got == {10: (1, 4.0), 11: (2, 6.0)}


def test_token_counts_once_and_url_half(spark):
    site = [(1, "alpha", "https://x/beta-alpha", "s"), (2, "alpha beta", "", "s")]
    l, r = names(spark, [(10, "alpha beta beta")], site)
    got = M.fuzzy_match(l, r, M.BY_SIZE, n=2, floor=None).collect()
    assert [(x.ord, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(2, 4.0), (1, 2.5)]


def test_tie_goes_to_the_earlier_row(spark):
    l, r = names(spark, [(1, "alpha beta")], [(9, "alpha beta", "", "s"), (3, "beta alpha", "", "s")])
    assert M.fuzzy_match(l, r, M.BY_SIZE).collect()[0].ord == 3


def test_greek_names_match_without_accents_and_final_sigma(spark):
    l, r = names(spark, [(1, "ΚΡΕΜΑΣ ΑΛΟΗΣ")], [(4, "κρεμας αλόης", "", "s")])
    assert M.fuzzy_match(l, r, M.BY_SIZE).collect()[0].score == 4.0


def test_dose_and_count(spark):
    l, r = names(spark, [(1, "Zinc 15mg 60caps")], [(2, "zinc 15mg 60 caps", "", "s"), (3, "zinc 30mg 60caps", "", "s")])
    got = M.fuzzy_match(l, r, M.BY_DOSE, n=2, floor=None).collect()
    scores = {x.ord: x.score for x in got}
    assert scores == {2: 9.0, 3: 5.0}


def test_transliterated_slug(spark):
    p = spark.createDataFrame([(1, "Κρέμα χεριών θρέψης")], "ordinal long, name string")
    u = spark.createDataFrame(
        [(1, "https://a.gr/krema/other"), (2, "https://a.gr/x/krema-cherion-threpsis.html")], "url_ordinal long, url string"
    )
    got = M.slug_match(p, u, "name", transliterate=True, expand=False).collect()
    assert [(x.ord, x.score) for x in got] == [(2, 6.0)]
    assert M.slug_match(p, u, "name", expand=False).collect() == []


def test_conflicts(spark):
    rows = [
        ("Cream DAY", "https://x/creme-nuit.jpg"),
        ("Cream DAY", "https://x/day-and-night.jpg"),
        ("cream night", "https://x/creme-jour.jpg"),
        ("NGT cream", "https://x/holiday.jpg"),
    ]
    df = spark.createDataFrame(rows, "name string, url string")
    kept = [r.url for r in M.drop_conflicts(df, "name", "url").collect()]
    assert kept == ["https://x/day-and-night.jpg", "https://x/holiday.jpg"]


def test_two_stage_keeps_the_hit_without_a_page(spark):
    p = spark.createDataFrame([(1, "111", None), (2, "222", None), (3, "333", None), (4, "", None)], "ordinal long, barcode string, line string")
    h = spark.createDataFrame([("111", "alpha beta cream", "h1"), ("222", "nowhere", "h2")], "barcode string, name string, url string")
    u = spark.createDataFrame([(1, "https://b.gr/x/alpha-beta")], "url_ordinal long, url string")
    got = {r.barcode: (r.url, r.source) for r in M.two_stage(p, h, u).collect()}
    assert got == {"111": ("https://b.gr/x/alpha-beta", "brand"), "222": ("h2", "hit")}


def test_no_plan_compares_every_pair(spark):
    from conftest import SF_DIR

    from shelfwise.plans.fixtures import table

    cfg = replace(M.BY_SIZE, hot_rows=20)
    df = M.fuzzy_match(table(spark, SF_DIR, "supplier_list"), table(spark, SF_DIR, "site_list"), cfg, n=3, floor=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert df.select(F.count_distinct("lid")).first()[0] == 200


@pytest.mark.parametrize("k,size", [(8, 3000), (12, 3000)])
def test_shared_vocabulary_does_not_multiply(spark, k, size):
    """Distinct rows of one own word and k of k + 3 words that nearly all rows share."""
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(k + 3)]

    def row(own):
        return [own, *sorted(rnd.sample(words, k))]

    left = [dict(lid=i, tokens=row(f"l{i}"), ms=["", ""], promo=False) for i in range(size)]
    right = [dict(ord=i, strong=row(f"r{i}"), weak=[], ms=["", ""], promo=False) for i in range(size)]
    l, r = frames(spark, left, right)
    start = time.monotonic()
    got = {x.lid: (x.ord, x.score) for x in score_join(l, r, W, 1, 4.0).collect()}
    took = time.monotonic() - start
    first = {}
    for x in reversed(right):
        first[frozenset(x["strong"][1:])] = x["ord"]
    for x in rnd.sample(left, 200):
        own = frozenset(x["tokens"][1:])
        less, ord_ = min((-2.0 * len(own & s), o) for s, o in first.items())
        assert got[x["lid"]] == (ord_, -less)
    assert len(got) == size and took < 90

"""Descriptions from a template table, against plain loops."""

from compare import compare, connect
from conftest import SF_DIR

from shelfwise.operators import templates as T
from shelfwise.plans.queries import QUERIES

TEMPLATE = "brand string, line string, attribute string, least double, place int, sentence string"
PRODUCT = "id long, brand string, line string, labels array<string>, level double, size string, brand_label string"
RULES = [
    (None, None, None, None, 1, "By {brand}."),
    ("a", None, None, None, 1, "A makes it."),
    ("a", "x", None, None, 1, "A's line x, {size}."),
    (None, "x", None, None, 1, "Some x."),
    (None, None, None, 10.0, 2, "Ten."),
    (None, None, None, 20.0, 2, "Twenty."),
    (None, None, "kids", None, 3, "For kids."),
    (None, None, "kids", None, 3, "For children."),
    ("b", None, "kids", 15.0, 3, "B for kids."),
    (None, None, None, None, 4, "Pack of {size}."),
]
PRODUCTS = [
    (1, "a", "x", ["kids"], 20.0, "5 ml", "A"),
    (2, "a", "x", None, None, None, "A"),
    (3, "b", "y", ["kids", "sport"], 15.0, " ", "B"),
    (4, None, None, [], 9.0, "1 g", None),
    (5, "b", "x", ["kids", None, "kids"], None, "2 g", ""),
]


def expected(product):
    _, brand, line, labels, level, size, label = product
    values, out = {"brand": label, "size": size}, {}
    for b, l, attribute, least, place, sentence in RULES:
        if any(want is not None and want != got for want, got in ((b, brand), (l, line))) or attribute is not None and attribute not in (labels or []):
            continue
        if least is not None and (level is None or level < least):
            continue
        named = [n for n in values if "{" + n + "}" in sentence]
        if any(not (values[n] or "").strip() for n in named):
            continue
        text = sentence
        for n in named:
            text = text.replace("{" + n + "}", values[n])
        rank = (-sum(x is not None for x in (b, l, attribute)), -least if least is not None else float("inf"), -len(named), text)
        out[place] = min(out.get(place, rank), rank)
    return " ".join(out[p][-1] for p in sorted(out))


def described(spark, products, rules):
    left, right = spark.createDataFrame(products, PRODUCT), spark.createDataFrame(rules, TEMPLATE)
    return T.describe_by_templates(left, right, "id", ["brand", "line"], "labels", "level", {"brand": "brand_label", "size": "size"})


def test_most_specific_row_of_each_place(spark):
    got = {r.id: r.description for r in described(spark, PRODUCTS, RULES).collect()}
    assert got == {p[0]: expected(p) for p in PRODUCTS}
    assert got[1] == "A's line x, 5 ml. Twenty. For children. Pack of 5 ml." and got[4] == "Pack of 1 g."


def test_long_table_is_joined_without_broadcast(spark, monkeypatch):
    want = sorted(described(spark, PRODUCTS, RULES).collect())
    monkeypatch.setattr(T, "is_small", lambda df: False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = described(spark, PRODUCTS, RULES)
        assert sorted(df.collect()) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_tables(spark):
    assert [r.description for r in described(spark, PRODUCTS, []).collect()] == [""] * len(PRODUCTS)
    assert described(spark, [], RULES).count() == 0


def test_query_uses_every_audience_sentence(spark):
    diff, _, _ = compare(spark, connect(SF_DIR), SF_DIR, "line_descriptions")
    assert diff is None, diff
    text = " ".join(r.description for r in QUERIES["line_descriptions"](spark, SF_DIR).collect())
    with open(T.__file__.replace("operators/templates.py", "plans/line_templates.tsv"), encoding="utf-8") as f:
        sentences = [x.rstrip("\n").split("\t") for x in f][1:]
    assert all(x[7] in text for x in sentences if x[0] == "sun" and x[4])

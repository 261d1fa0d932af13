"""Text rules the given tables cannot show: Greek, accents, borders of words."""

from pyspark.sql import functions as F

from shelfwise.functions import attributes as A
from shelfwise.functions import text as X
from shelfwise.functions.quality import reasons, richness
from shelfwise.operators import rules as R


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_greek_case_and_final_sigma_fold(spark):
    assert one(spark, "ΚΑΛΛΥΝΤΙΚΟΣ", X.fold) == one(spark, "καλλυντικός", X.fold) == "καλλυντικοσ"


def test_accents_of_all_ranges(spark):
    assert one(spark, "Éèñ ü ώ ϊ ΐ Ἄ", X.strip_accents) == "Een u ω ι ι Α"
    assert one(spark, "é", X.strip_accents) == "e"


def test_word_border_is_ascii(spark):
    assert one(spark, "κρέμα50ml", lambda c: F.regexp_extract(c, X.regex(r"\b(\d+)ml"), 1)) == "50"
    assert one(spark, "a50ml", lambda c: F.regexp_extract(c, X.regex(r"\b(\d+)ml"), 1)) == ""


def test_tokens(spark):
    got = one(spark, "Crème & ΚΡΈΜΑ κρεμα a 50ml, the", lambda c: X.tokens(c, ["the"]))
    assert got == ["creme", "κρεμα", "50ml"]
    assert one(spark, None, X.tokens) == []


def test_unit_gr_stays_gr(spark):
    assert one(spark, "Cream 50 GR", A.volume) == "50gr"
    assert one(spark, "Cream 7,5 g", A.volume) == "7,5g"
    assert one(spark, "Cream", A.volume) is None


def test_labels(spark):
    types = lambda c: F.array_join(A.labels(c, A.TYPE_LABELS), "|")
    assert one(spark, "Sun gel-cream oil", types) == "Κρέμα-Gel|Λάδι"
    assert one(spark, "ΚΡΈΜΑ χεριών", types) == "Κρέμα"
    areas = lambda c: F.array_join(A.labels(c, A.AREA_LABELS), "|")
    assert one(spark, "milk face/body", areas) == "Πρόσωπο & Σώμα"


def test_clean_name_keeps_short_words_that_are_no_locale(spark):
    assert one(spark, "RICH HAND BALM 75ML EN gr", X.clean_name) == "Rich Hand Balm 75ml"
    assert one(spark, "UVA BALM ds24 FR", X.clean_name) == "UVA Balm DS24"
    assert one(spark, "CREAM FOR YOU", X.clean_name) == "Cream For You"


def test_decap_name(spark):
    assert one(spark, "ALOE  plus Honey", lambda c: X.decap_name(c, "Shelf")) == "Shelf Aloe plus Honey"
    assert one(spark, "SHELF ALOE", lambda c: X.decap_name(c, "Shelf")) == "Shelf Aloe"
    assert one(spark, "SHELFX", lambda c: X.decap_name(c, "Shelf")) == "Shelf Shelfx"
    assert one(spark, "", lambda c: X.decap_name(c, "Shelf")) == ""


def test_expand_name_and_lookahead(spark):
    assert one(spark, "SH LOT cr T150ML EN gr", X.expand_name) == "Shampoo Lotion Cream 150ML"
    assert one(spark, "MAT MATCH", X.expand_name) == "Mat MATCH"


def test_prepend_if_absent(spark):
    df = spark.createDataFrame([("SA", "with sa acid"), ("SA", "salve"), ("a.b", "axb"), (None, "x")], "h string, t string")
    got = [r[0] for r in df.select(X.prepend_if_absent(F.col("h"), F.col("t"))).collect()]
    assert got == ["with sa acid", "SA salve", "a.b axb", "x"]


def test_slug(spark):
    assert one(spark, "Crème SPF50+ F/B & κρέμα — x", X.slug) == "creme-spf50-f-b-x"
    assert one(spark, "ab cd", lambda c: X.slug(c, 3)) == "ab"


def test_cut_at_word(spark):
    assert one(spark, "one two three four", lambda c: X.cut_at_word(c, 12)) == "one two..."
    assert one(spark, "one two", lambda c: X.cut_at_word(c, 7)) == "one two"


def test_romanize(spark):
    assert one(spark, "Θρέψη χεριών", X.romanize) == "threpsi cherion"


LONG_GREEK = "λέξη " * 60


def test_reasons(spark):
    why = lambda c: F.array_join(reasons(c, [r"Δωρε[άα]ν μεταφορικ[άα]"]), "|")
    assert one(spark, "  ", why) == one(spark, None, why) == "missing"
    assert one(spark, LONG_GREEK, why) == ""
    assert one(spark, "Short …", why) == "too-short|truncated"
    assert one(spark, "english words only " * 10, why) == "english-only"
    assert one(spark, LONG_GREEK + "ΔΩΡΕΆΝ ΜΕΤΑΦΟΡΙΚΆ", why) == "pharmacy-fluff"


def test_richness(spark):
    assert one(spark, "", lambda c: richness(c, ["filler"])) == 0.0
    assert one(spark, LONG_GREEK, lambda c: richness(c, ["filler"])) == 2.99
    assert one(spark, LONG_GREEK * 3, lambda c: richness(c, ["filler"])) == 5.0


def test_rules_first_match_wins(spark):
    section = lambda c: F.coalesce(R.first_match(c, R.SECTION_RULES), F.lit("diafora"))
    assert one(spark, "Garlic and zinc", section) == "ugeia-kardias"
    assert one(spark, "Maca cocoa", section) == "energia"
    assert one(spark, "zincy", section) == "diafora"
    assert one(spark, None, section) == "diafora"


def test_validate(spark):
    rows = [("b", "n", "12,505"), ("b", "", "1"), ("x", "n", "1"), ("b", "n", "n/a"), ("b", "n", None)]
    df = spark.createDataFrame(rows, "brand string, name string, price string")
    got = R.validate(df, ["name", "price"], "price", ("brand", ["b"])).collect()
    assert [r.problem for r in got] == [None, "required", "unknown-key", "price", "required"]
    assert str(got[0].price_value) == "12.51"

"""Plan shapes, skew helpers, sinks and the incremental job."""

import glob
import json

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from shelfwise.operators import layers as L
from shelfwise.operators import pages as P
from shelfwise.operators import quality as Q
from shelfwise.operators import serve as S
from shelfwise.plans import skew
from shelfwise.plans.fixtures import read, table
from shelfwise.plans.queries import QUERIES
from shelfwise.sources import io
from shelfwise.streaming.ingest import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["facet_filter"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#11)]" in text
    assert "p_retailprice" not in text


def test_top_n_is_limited_before_the_shuffle(spark):
    for name in ("dedupe_first", "top1_per_brand", "pick_by_source", "upsert_last", "related_items"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF_DIR)), name


def test_small_dimension_is_broadcast_and_a_large_one_is_not(spark, monkeypatch):
    products = table(spark, SF_DIR, "products")
    dim = spark.createDataFrame([("SMALL", "s")], "line string, label string")
    assert "BroadcastHashJoin" in plan(L.with_dim(products, dim, "line", "label", F.lit("-")))
    monkeypatch.setattr(skew, "is_small", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = L.with_dim(products, dim, "line", "label", F.lit("-"))
        assert "SortMergeJoin" in plan(df)
        assert df.where("label = 's'").count() == products.where("line = 'SMALL'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_query_compares_all_pairs(spark):
    for name, query in QUERIES.items():
        if name == "incremental_ingest":
            continue
        text = plan(query(spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_keyed_lookup_with_hot_and_null_keys(spark):
    base = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k")
    )
    look = base.select("k").distinct().where("k is not null").withColumn("v", F.upper("k"))
    hot = skew.hot_keys(base, ["k"], 50)
    assert {r.k: r._parts for r in hot.collect()} == {"hot": 7}
    for got in (skew.keyed_lookup(base, look, "k", "id"), skew.keyed_lookup(base, look, "k", "id", hot=hot)):
        assert got.count() == 1000
        assert got.where("v <=> upper(k)").count() == 1000


def test_keyed_lookup_does_not_count_its_base(spark):
    for name in ("cascade_fields", "display_table"):
        text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
        assert text.count("FileScan") <= 6, (name, text.count("FileScan"))
    df = QUERIES["cascade_fields"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert df.count("FileScan") <= 4 and df.count("Exchange hashpartitioning") <= 3


def test_lists_may_be_tables(spark):
    urls = spark.createDataFrame([("https://www.a.com/x",), ("https://b.com/y",)], "url string")
    hosts = spark.createDataFrame([("a.com",)], "host string")
    assert P.host_in(urls, hosts).collect() == P.host_in(urls, ["a.com"]).collect() != []
    cands = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("l", "c", 3)], "k string, host string, o long")
    ranks = spark.createDataFrame([("a", 0), ("b", 5)], "host string, rank int")
    listed, tabled = (sorted(map(tuple, Q.pick_by_source(cands, r, "k", "host", "o", F.lit(True)).select("k", "o", "host_rank").collect())) for r in ([("a", 0), ("b", 5)], ranks))
    assert listed == tabled == [("k", 2, 0), ("l", 3, 10)]


def test_running_rank_over_ranges(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("g"), (F.col("id") % 5 == 0).alias("late"))
    got = skew.running_rank(df, ["g", "late"], "id", ["g"], width=37)
    want = df.selectExpr("*", "row_number() over (partition by g order by late, id) as rank")
    assert sorted(map(tuple, got.select("id", "rank").collect())) == sorted(map(tuple, want.select("id", "rank").collect()))


def test_limit_is_exact(spark):
    assert skew.is_small(spark.range(10), 10) and not skew.is_small(spark.range(11), 10)


def test_export(spark, tmp_path):
    df = spark.createDataFrame(
        [('a "b"', 1.005, None, ["x", "y"]), ("two\n words;", 2.0, 3, [])], "n string, p double, i int, v array<string>"
    )
    lines = [r.value for r in io.export_rows(df, ["n", "p", "i", "v"]).collect()]
    assert lines[0].startswith('"a ""b""";1,0') and lines[0].endswith(";;x, y")
    assert lines[1] == '"two words;";2,00;3,00;'
    io.write_rows(io.export_rows(df, ["n"]), str(tmp_path / "out"), header=["n"])
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert spark.read.text(str(tmp_path / "out_header")).first().value == "n"


def test_report(spark, tmp_path):
    v = Q.with_verdict(spark.createDataFrame([(1, None), (2, "short")], "id long, t string"), "t", ["filler"])
    io.write_report(io.report_rows(Q.totals(v, "t"), Q.audit(v, "t").select("id", "reasons")), str(tmp_path / "r"))
    rows = spark.read.text(str(tmp_path / "r")).collect()
    totals = [json.loads(r.value) for r in rows if r.kind == "totals"]
    assert totals == [{"products": 2, "with_text": 1, "ok": 0, "flagged": 2}]
    assert len(rows) == 3


def test_read_catalog_and_map(spark, tmp_path):
    row = '{"ordinal": 1, "barcode": "0012", "price": 1.5, "variants": ["1"], "extra": 1}'
    (tmp_path / "c.json").write_text(row)
    got = io.read_catalog(spark, str(tmp_path / "c.json"), fmt="json").first()
    assert got.barcode == "0012" and str(got.price) == "1.50" and got.name is None
    df = spark.createDataFrame([('{"_comment": "x", "1": "a", "2": "b"}',)], "j string")
    assert sorted(map(tuple, io.explode_map(df, "j").collect())) == [("1", "a"), ("2", "b")]


def test_ranked_list_keeps_its_gaps(spark):
    ranked = spark.createDataFrame([(["b", "none", "a"],)], "codes array<string>")
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "late")], "ordinal long, barcode string, name string")
    got = S.ranked_join(ranked, p, "codes", "barcode", "ordinal", ["name"]).collect()
    assert sorted((r["rank"], r.name) for r in got) == [(1, "y"), (3, "x")]


def store_rows(spark, store):
    return sorted((r.url, r.n) for r in spark.read.parquet(store).collect())


def test_ingest_is_incremental_and_first_wins(spark, tmp_path):
    src, store, check = (str(tmp_path / n) for n in ("src", "store", "check"))
    schema = "n long, url string"

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        ingest(stream, store, check, "url", "n", lambda b: b)

    add("one", [(2, "a"), (1, "a"), (3, "b")])
    run()
    assert store_rows(spark, store) == [("a", 1), ("b", 3)]
    add("two", [(0, "a"), (9, "c"), (8, "c")])
    run()
    run()
    assert store_rows(spark, store) == [("a", 1), ("b", 3), ("c", 8)]
    assert len(glob.glob(f"{store}/batch_id=*")) == 2


def test_ingest_replays_a_lost_batch(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    spark.createDataFrame([(1, "a"), (2, "a")], "n long, url string").write.parquet(src)
    for attempt in ("c1", "c2"):  # a lost checkpoint repeats batch 0 over its own output
        stream = spark.readStream.schema("n long, url string").parquet(src)
        ingest(stream, store, str(tmp_path / attempt), "url", "n", lambda b: b)
        assert store_rows(spark, store) == [("a", 1)]


def test_pages_are_read_whole(spark):
    longest = read(spark, SF_DIR, "pages").agg(F.max(F.length("html"))).first()[0]
    assert QUERIES["page_audit"](spark, SF_DIR).agg(F.max("size")).first()[0] == longest


class FakeSession:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, configured=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: configured)})


def test_shared_folder():
    from shelfwise.session import run_dir, shared_dir

    assert shared_dir(FakeSession("spark://host", "hdfs://shared/")) == "hdfs://shared"
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local) and run_dir(local, "a") != run_dir(local, "a")
    for master in ("spark://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(FakeSession(master))

"""Reading product tables and keyed maps, writing exports and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import squash

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("barcode", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("raw_name", T.StringType()),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("vat", T.IntegerType()),
        T.StructField("variants", T.ArrayType(T.StringType())),
    ]
)


#: A scan of fewer splits than this may be spread.
FEW_SPLITS = 8


def read_catalog(spark: SparkSession, path: str, schema: T.StructType = PRODUCT_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """A product table with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def spread_scan(df: DataFrame) -> DataFrame:
    """For a plain scan ahead of heavy per-row work: a table of a few splits, so of
    about a gigabyte at most, is spread over all cores. Larger tables are never
    shuffled; read them with a smaller ``spark.sql.files.maxPartitionBytes`` to get
    more and shorter tasks."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def explode_map(df: DataFrame, col: str, key: str = "barcode", value: str = "value", value_type: str = "string") -> DataFrame:
    """JSON objects keyed by code to rows; keys that start with ``_`` are comments."""
    parsed = F.from_json(F.col(col), f"map<string,{value_type}>")
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(parsed).alias(key, value)).where(~F.col(key).startswith("_"))


def _cell(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType,)):
        text = F.array_join(F.col(name), ", ")
    elif isinstance(dtype, T.NumericType):
        # float and double go through decimal so that no binary digits appear
        text = F.replace(F.col(name).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    else:
        text = F.col(name).cast("string")
    text = squash(F.coalesce(text, F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[";]'), quoted).otherwise(text)


def export_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Delimited lines: ``;``, decimal comma with two digits, quotes if needed."""
    return df.select(*keep, F.concat_ws(";", *[_cell(df, c) for c in cols]).alias("value"))


def write_rows(lines: DataFrame, path: str, header: Sequence[str] | None = None, mode: str = "error") -> None:
    """One text file per task; the header, if any, is a file of its own."""
    lines.select("value").write.mode(mode).text(path)
    if header:
        lines.sparkSession.createDataFrame([(";".join(header),)], "value string").coalesce(1).write.mode(mode).text(
            path.rstrip("/") + "_header"
        )


def report_rows(totals: DataFrame, flagged: DataFrame) -> DataFrame:
    """JSON lines: one ``totals`` object, then one object per flagged row."""
    head = totals.select(F.lit("totals").alias("kind"), F.to_json(F.struct(*totals.columns)).alias("value"))
    body = flagged.select(F.lit("flagged").alias("kind"), F.to_json(F.struct(*flagged.columns)).alias("value"))
    return head.unionByName(body)


def write_report(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).partitionBy("kind").text(path)

"""Stage tables, rules and bands on the given tables. Prices are decimals, so that sums are exact."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom import Band, ColumnRule, Comparison, Impact, StageRule, analyse
from steploom.operators.stages import first_row_per_id

ID = "l_orderkey"
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
SEGMENTS = ["o_orderpriority", "c_mktsegment", "n_name", "note"]

BANDS = (
    Band("Big drop", -0.085),
    Band("Drop", -0.055),
    Band("Small drop", -0.025),
    Band("Flat", -0.005),
    Band("Rise", 0.005),
)

STAGE_RULES = [
    StageRule(ID, "Net", 1, "List", "stage_1", "price_list", "price_list"),
    StageRule(ID, "Net", 2, "Discounted", "stage_2", "price_discounted", "price_half_discounted"),
    StageRule(ID, "Net", 3, "Taxed", "stage_3", "price_taxed", "price_half_taxed"),
    StageRule(ID, "Rate", 1, "List", "stage_1", "rate_discount"),
    StageRule(ID, "Rate", 2, "Discounted", "stage_2", "rate_tax"),
    StageRule(ID, "Rate", 3, "Taxed", "stage_3", "rate_both"),
]
COMPARISON = Comparison(STAGE_RULES)
RENEWAL = Comparison(STAGE_RULES, renewal=True)

CUSTOMER_RULES = [
    ColumnRule("C CUSTKEY", "ID", "INTEGE"),
    ColumnRule("c_mktsegment", "SEGMENT", "CODE"),
    ColumnRule("c_acctbal", "BALANCE", "DECIMA"),
    ColumnRule("c_name", "NAME", "CODE", optional=True),
    ColumnRule("c_nationkey", "NATION", "INTEGE", optional=True),
    ColumnRule("c_phone", "PHONE", "CODE", optional=True),
]
SEGMENT_MAP = {"c_mktsegment": {"AUTOMOBILE": "AUTO", "MACHINERY": "MACHINE"}}

PART_RULES = [
    ColumnRule("p_partkey", "PART", "INTEGE"),
    ColumnRule("p_retailprice", "PRICE", "DECIMA"),
    ColumnRule("is_large", "SIZE_FLAGS", "INTEGE", is_list=True, optional=True),
    ColumnRule("is_huge", "SIZE_FLAGS", "INTEGE", is_list=True, optional=True),
    ColumnRule("is_costly", "PRICE_FLAGS", "INTEGE", is_list=True, optional=True),
    ColumnRule("is_even", "PRICE_FLAGS", "INTEGE", is_list=True, optional=True),
    ColumnRule("is_third", "PRICE_FLAGS", "INTEGE", is_list=True, optional=True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for written results: in the shared folder the cluster names, else local (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"written-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="steploom-")


def note(priority: Column) -> Column:
    """Text that is blank for some priorities."""
    return F.when(priority == "5-LOW", "  ").when(priority == "1-URGENT", "").otherwise(F.concat(F.lit(" "), priority))


def stage_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three snapshots of the first line of each order; later ones lack some orders."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    half = F.lit(0.5).cast("decimal(2,1)")
    one = F.lit(1).cast("decimal(1,0)")
    first = first_row_per_id(table(spark, sf_dir, "lineitem"), ID, LINE_ORDER)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    stage_1 = (
        first.select(
            ID, "l_linenumber", "l_returnflag", price.alias("price_list"), discount.alias("rate_discount")
        )
        .join(orders, F.col(ID) == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("note", note(F.col("o_orderpriority")))
        .select(ID, "l_linenumber", "l_returnflag", *SEGMENTS, "price_list", "rate_discount")
    )
    stage_2 = first.filter(F.col("l_returnflag") != "R").select(
        ID,
        "l_linenumber",
        (price * (one - discount)).alias("price_discounted"),
        (price * (one - discount * half)).alias("price_half_discounted"),
        tax.alias("rate_tax"),
    )
    stage_3 = first.filter(F.col("l_linestatus") != "O").select(
        ID,
        "l_linenumber",
        (price * (one - discount) * (one + tax)).alias("price_taxed"),
        (price * (one - discount * half) * (one + tax * half)).alias("price_half_taxed"),
        (discount + tax).alias("rate_both"),
    )
    return {"stage_1": stage_1, "stage_2": stage_2, "stage_3": stage_3}


def impact(spark: SparkSession, sf_dir: str, renewal: bool = False) -> Impact:
    comparison = RENEWAL if renewal else COMPARISON
    return analyse(stage_tables(spark, sf_dir), comparison, BANDS, ["l_linenumber"], keep=["l_returnflag", *SEGMENTS])


def parts_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with flags of 0 or 1; ``is_third`` is null for two thirds of the parts."""
    return table(spark, sf_dir, "part").withColumns(
        {
            "is_large": (F.col("p_size") > 10).cast("int"),
            "is_huge": (F.col("p_size") > 25).cast("int"),
            "is_costly": (F.col("p_retailprice") > 950).cast("int"),
            "is_even": F.when(F.col("p_size") != 30, 1 - F.col("p_size") % 2),
            "is_third": F.when(F.col("p_partkey") % 3 == 0, 1),
        }
    )


def ship_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates as text in several layouts and as spreadsheet serials."""
    day = F.col("l_shipdate").cast("date")
    serial = F.date_diff(day, F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.date_format(day, "yyyy-MM-dd").alias("iso_text"),
        F.date_format(day, "d/M/yyyy").alias("slash_text"),
        F.date_format(day, "MM-dd-yyyy").alias("us_text"),
        F.date_format(day, "d MMM yyyy").alias("name_text"),
        (serial + F.lit(0.25)).alias("serial"),
        serial.cast("string").alias("serial_text"),
    )

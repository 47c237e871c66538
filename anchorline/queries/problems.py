"""Queries p1 to p4 and p7 with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions.text import strip
from anchorline.operators import references, rolling, skew
from anchorline.operators import value_counts as vc
from anchorline.operators.hot_deck import HotDeck, Target, hot_deck
from anchorline.operators.stand_ins import StandIns, find_stand_ins
from anchorline.session import materialize

#: The tiers there are.
TIERS = r"\A(Anchor|Core|Growth|Trial)\z"
EMAIL, TIER, AMOUNT = ("demo_customers", "Email"), ("demo_customers", "Tier"), ("demo_sales", "Amount")
SALE = ["CustomerID", "Product", "Category", "Amount", "Quantity", "Date", "SalesRep"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stand_ins(sales: DataFrame) -> StandIns:
    return find_stand_ins(sales, "Product", "Category", "Amount", "Quantity", "load_id")


def missing_cells(sales: DataFrame) -> dict:
    """For each of Amount, Quantity and Category: the cell is null or a stand-in."""
    known = stand_ins(sales)
    return {
        "Amount": F.col("Amount").isNull() | skew.is_in(F.col("Amount"), [int(v) for v in known.values("Amount")]),
        "Quantity": F.col("Quantity").isNull() | skew.is_in(F.col("Quantity"), [int(v) for v in known.values("Quantity")]),
        "Category": F.col("Category").isNull() | skew.is_in(F.col("Category"), known.values("Category")),
    }


# Problem 1


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of both tables, per load."""
    store = vc.ValueCounts(spark)
    for t in ("demo_sales", "demo_customers"):
        store.apply(read(spark, sf_dir, t), t)
    state = materialize(store.state(), "counts")
    numbers = {("demo_sales", c) for c in ("row_id", "TransactionID", "CustomerID", "Amount", "Quantity")} | {("demo_customers", c) for c in ("row_id", "CustomerID")}
    return vc.profile_counts(state, {EMAIL: vc.EMAIL, TIER: TIERS}, numbers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad cells of Email and Tier, and the loads in which Email, Tier or Amount is far from usual."""
    customers = read(spark, sf_dir, "demo_customers")
    store = vc.ValueCounts(spark)
    store.apply(customers, "demo_customers", ["Email", "Tier"]).apply(read(spark, sf_dir, "demo_sales"), "demo_sales", ["Amount"])
    state = materialize(store.state(), "counts")
    out = vc.odd_loads(state, median_columns={"Amount"}, share_columns={"Email", "Tier"})
    found = out.select(F.concat_ws(".", "table", "col").alias("col"), F.lit("load").alias("kind"), F.col("load_id").cast("bigint").alias("ref")).distinct()
    for (table, col), rx in ((EMAIL, vc.EMAIL), (TIER, TIERS)):
        bad = vc.bad_cells(customers, state, table, col, rx)
        found = found.unionByName(bad.select(F.lit(f"{table}.{col}").alias("col"), F.lit("value").alias("kind"), F.col("row_id").alias("ref")))
    return found


# Problem 2


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, averages and numbers of sales of the last 7 and 30 days for every customer and day.

    A sale counts once however often delivered; a stand-in Amount counts as none.
    """
    sales = read(spark, sf_dir, "demo_sales")
    none = missing_cells(sales)["Amount"]
    once = rolling.first_delivery(sales, "TransactionID", "row_id", ["CustomerID", "Date", "Amount"])
    return rolling.rolling_totals(once.withColumn("Amount", F.when(~none, F.col("Amount"))), "CustomerID", "Date", "Amount", (7, 30), sales.select(F.max("Date").alias("last")))


# Problem 3


def _keys(sales: DataFrame) -> DataFrame:
    cells = F.array(
        F.struct(F.lit("CustomerID").alias("col"), F.col("CustomerID").cast("string").alias("key_value")),
        F.struct(F.lit("SalesRep").alias("col"), F.lower(strip(F.col("SalesRep"))).alias("key_value")),
    )
    return sales.withColumn("_c", F.explode(cells)).withColumns({"col": F.col("_c.col"), "key_value": F.col("_c.key_value")}).drop("_c").filter("key_value is not null")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and per sales person: rows as delivered, sales (each TransactionID once), their total, smallest and largest Amount.

    Heavy keys are salted by TransactionID, so all deliveries of a sale meet in one part and distinct sales add up. Sales without
    a TransactionID count as rows only. A stand-in Amount counts as none.
    """
    sales = read(spark, sf_dir, "demo_sales")
    none = missing_cells(sales)["Amount"]
    rows = sales.withColumn("Amount", F.when(~none, F.col("Amount"))).select("TransactionID", "CustomerID", "SalesRep", "Amount")
    keyed = _keys(rows).withColumn("_pair", F.concat_ws("\x1f", "col", "key_value"))
    hot = skew.is_in(F.col("_pair"), skew.heavy_keys(keyed, "_pair", 0.005))
    # Two-stage over (key, salt): first each sale once, then its part's totals, then the key's.
    salt = F.when(hot, F.pmod(F.xxhash64("TransactionID"), F.lit(32)).cast("int")).otherwise(F.lit(0))
    sales1 = keyed.withColumn("_salt", salt).groupBy("col", "key_value", "_salt", "TransactionID").agg(F.count(F.lit(1)).alias("n"), F.max("Amount").alias("Amount"))
    real = F.col("TransactionID").isNotNull()
    part = sales1.groupBy("col", "key_value", "_salt").agg(
        F.sum("n").alias("n"), F.count("TransactionID").alias("sales"), F.sum(F.when(real, F.col("Amount"))).alias("total"), F.min(F.when(real, F.col("Amount"))).alias("least"), F.max(F.when(real, F.col("Amount"))).alias("most")
    )
    return part.groupBy("col", "key_value").agg(
        F.sum("n").alias("rows"), F.sum("sales").alias("sales"), F.sum("total").alias("total_amount"), F.min("least").alias("min_amount"), F.max("most").alias("max_amount")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and sales people with more than 3 % of all rows."""
    sales = read(spark, sf_dir, "demo_sales").select("row_id", "CustomerID", "SalesRep")
    keyed = _keys(sales).withColumn("_pair", F.concat_ws("\x1f", "col", "key_value"))
    # Each row has up to two keys: half the share, and less where keys are null, so every candidate is salted.
    heavy = skew.heavy_keys(keyed, "_pair", 0.01)
    sums = skew.salted_aggregate(keyed, ["col", "key_value"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, F.col("row_id"), skew.is_in(F.col("_pair"), heavy))
    total = sales.agg(F.count(F.lit(1)).alias("total"))
    return sums.crossJoin(F.broadcast(total)).filter(F.col("n") * 100 > F.col("total") * 3).select("col", "key_value")  # one row


# Problem 4


def filled_sales(sales: DataFrame) -> HotDeck:
    targets = [
        Target("Amount", [["Product", "Quantity"], ["Product", "Quantity"], ["Product"], ["Category"], []]),
        Target("Quantity", [["Product", "Amount"], ["Product", "Amount"], ["Product"], ["Category"], []]),
        Target("Category", [["Product"], ["CustomerID"], []], numeric=False, timed=False),
    ]
    return hot_deck(sales, targets, missing_cells(sales), "row_id", "Date")


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales rows with missing Amount, Quantity and Category filled, marked and with the donor of each filled cell."""
    return filled_sales(read(spark, sf_dir, "demo_sales")).filled


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the hot deck found missing and worked on."""
    return filled_sales(read(spark, sf_dir, "demo_sales")).cells.select("row_id", "col")


# Problem 7


def _orphans(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return references.orphan_rows(read(spark, sf_dir, "demo_sales"), read(spark, sf_dir, "demo_customers"), "CustomerID", "loaded_at", "loaded_at", "deleted_at", keep)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales rows whose customer is missing, deleted or not there yet."""
    return _orphans(spark, sf_dir, ["row_id"])


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of such rows per table, month of Date and kind."""
    return references.orphan_report(_orphans(spark, sf_dir, ["row_id", "Date"]), "demo_sales", "Date")


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p2_rolling, p3_found, p3_totals, p4_found, p4_filled, p7_found, p7_report)}

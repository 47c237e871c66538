"""Queries p5, p6, p8, p9 and p10 with their production parameters, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import mixing, names, text_stats, tokenizer
from anchorline.llm import top_n as top
from anchorline.queries.problems import missing_cells, read
from anchorline.queries.problems_sql import STAND_INS

# Problem 5


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers whose names are spellings of one person or organisation."""
    return names.link_names(read(spark, sf_dir, "demo_customers"), "CustomerID", "Name").pairs


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each named customer with its entity and the number of customers of that entity."""
    found = names.link_names(read(spark, sf_dir, "demo_customers"), "CustomerID", "Name").members
    sizes = found.groupBy("entity").agg(F.count(F.lit(1)).alias("customers"))
    return found.join(sizes, "entity").select("CustomerID", "entity", "customers")


# Problem 6


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 sales of highest Amount in each Category and Product."""
    sales = read(spark, sf_dir, "demo_sales")
    gone = missing_cells(sales)
    known = sales.filter(F.col("Product").isNotNull() & ~gone["Amount"] & ~gone["Category"])
    return top.top_n(known, ["Category", "Product"], "Amount", "TransactionID", 3).select("Category", "Product", "TransactionID")


# Problem 8


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenizer.encode(read(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none (a null text decodes to an empty one)."""
    docs = read(spark, sf_dir, "documents")
    ids = tokenizer.encode(docs, "text", ["doc_id", "text"])
    again = tokenizer.decode(ids.withColumnRenamed("text", "was"), "ids", ["doc_id", "was"])
    return again.filter(F.coalesce("was", F.lit("")) != F.col("text")).select("doc_id")


# Problem 9


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    sizes = tokenizer.encode(read(spark, sf_dir, "documents"), "text", ["doc_id", "source"], count_only=True)
    return mixing.mix_sources(sizes, read(spark, sf_dir, "mix_targets"), "doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen, with their tokens and how often each is used."""
    return _mix(spark, sf_dir).chosen


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir).shares


# Problem 10


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document and the kind that the learned rules give it."""
    return text_stats.classify(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose."""
    return p10_stats(spark, sf_dir).filter(F.col("kind") != "prose").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p5_found, p5_groups, p6_found, p8_ids, p8_roundtrip, p9_mix, p9_shares, p10_found, p10_stats)}

SQL = {
    "p6_found": f"""
WITH {STAND_INS},
s AS (SELECT DISTINCT Category, Product, TransactionID, Amount FROM demo_sales
  WHERE Product IS NOT NULL AND Amount IS NOT NULL AND Category IS NOT NULL AND TransactionID IS NOT NULL AND Amount NOT IN (SELECT a FROM bad_a) AND Category NOT IN (SELECT c FROM bad_c))
SELECT Category, Product, TransactionID FROM s QUALIFY row_number() OVER (PARTITION BY Category, Product ORDER BY Amount DESC, TransactionID) <= 3
""",
    "p8_roundtrip": "SELECT doc_id FROM documents WHERE false",
}

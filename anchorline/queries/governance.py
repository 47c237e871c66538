"""Queries of the quality layer, of pipelines, the converter and streams, with SQL where it can state them."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from anchorline.plans.pipeline import Pipeline
from anchorline.quality import contracts, pii
from anchorline.quality.profile import profile as make_profile
from anchorline.queries.reference import query
from anchorline.session import get_spark, new_path
from anchorline.streaming import adapter

TIERS = ["Anchor", "Core", "Growth", "Trial"]


@query("""SELECT 'Amount' AS "Column", 'bigint' AS "Dtype", count(*) AS "Row_Count", count(*) - count(Amount) AS "Null_Count", round((count(*) - count(Amount)) * 100.0 / count(*), 4) AS "Null_Rate_Pct", count(DISTINCT Amount) AS "Unique_Count",
    CAST(min(Amount) AS VARCHAR) AS "Min", CAST(max(Amount) AS VARCHAR) AS "Max", round(avg(Amount), 6) AS "Mean",
    (SELECT string_agg(Amount || ' (' || n || ')', ', ' ORDER BY n DESC, CAST(Amount AS VARCHAR)) FROM (SELECT Amount, count(*) AS n FROM demo_sales WHERE Amount IS NOT NULL GROUP BY 1 ORDER BY n DESC, CAST(Amount AS VARCHAR) LIMIT 5)) AS "Top_Values" FROM demo_sales
  UNION ALL SELECT 'Product', 'string', count(*), count(*) - count(Product), round((count(*) - count(Product)) * 100.0 / count(*), 4), count(DISTINCT Product), min(Product), max(Product), NULL,
    (SELECT string_agg(Product || ' (' || n || ')', ', ' ORDER BY n DESC, Product) FROM (SELECT Product, count(*) AS n FROM demo_sales WHERE Product IS NOT NULL GROUP BY 1 ORDER BY n DESC, Product LIMIT 5)) FROM demo_sales""")
def profile(t):
    """Profile of two sales columns."""
    return make_profile(t("demo_sales").select("Amount", "Product")).drop("Cardinality_Pct", "Std")


@query("""SELECT 'quality' AS "Suite", c AS "Contract", CASE WHEN n > 0 THEN s ELSE 'PASS' END AS "Status", CAST(n > 0 AS BIGINT) AS "Violation_Count" FROM (
    SELECT 'customers' AS c, 'FAIL' AS s, count(*) FILTER (Tier NOT IN ('Anchor', 'Core', 'Growth', 'Trial')) AS n FROM demo_customers
    UNION ALL SELECT 'sales', 'WARN', count(*) FILTER (Quantity < 0) FROM demo_sales
    UNION ALL SELECT 'sales:volume', 'FAIL', CAST(count(*) < 1 AS BIGINT) FROM demo_sales
    UNION ALL SELECT 'sales:freshness', 'FAIL', CAST(max(loaded_at) < TIMESTAMP '2026-01-01' - INTERVAL 3650 DAY AS BIGINT) FROM demo_sales)""")
def contract_suite(t):
    """A suite of schema, value, volume and freshness contracts over both tables."""
    suite = contracts.ContractSuite("quality")
    suite.add_contract("customers", {"columns": {"Tier": {"dtype": "str", "allowed_values": TIERS}, "row_id": {"dtype": "int", "nullable": False, "unique": True}}})
    suite.add_contract("sales", {"columns": {"Quantity": {"dtype": "int", "min_value": 0}}}, strict=False)
    suite.add_volume_check("sales", min_rows=1).add_freshness_check("sales", "loaded_at", timedelta(days=3650), datetime(2026, 1, 1, tzinfo=UTC))
    return suite.run({"customers": t("demo_customers"), "sales": t("demo_sales")}).select("Suite", "Contract", "Status", "Violation_Count")


@query("""SELECT column_name AS "Column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE 'int' END AS dtype, n AS nullable FROM (VALUES ('row_id', 'BIGINT', (SELECT bool_or(row_id IS NULL) FROM demo_customers)), ('Tier', 'VARCHAR', (SELECT bool_or(Tier IS NULL) FROM demo_customers)), ('load_id', 'INTEGER', (SELECT bool_or(load_id IS NULL) FROM demo_customers))) v(column_name, data_type, n)""")
def infer_schema(t):
    found = contracts.infer_schema(t("demo_customers").select("row_id", "Tier", "load_id"))["columns"]
    return get_spark().createDataFrame([(n, s["dtype"], s["nullable"]) for n, s in found.items()], "Column string, dtype string, nullable boolean")


@query("""SELECT 'CustomerID' AS "Column", 'internal_cust_id' AS "PII_Type", 'column_name' AS "Detection_Method", 'high' AS "Confidence" UNION ALL SELECT 'Email', 'email', 'column_name', 'high'
  UNION ALL SELECT 'Phone', 'phone_us', 'column_name', 'high' UNION ALL SELECT 'Phone', 'phone_intl', 'column_name', 'high'""")
def pii_scan(t):
    """Personal data by the names of columns."""
    df = t("demo_customers").select("CustomerID", "Email", "Phone")
    return pii.scan_pii(df, warn=False).filter("Detection_Method = 'column_name'").select("Column", "PII_Type", "Detection_Method", "Confidence")


_TEXTS = ("Name", "Region", "Tier", "Email", "Phone")
_BY_NAME = {"CustomerID": ("internal_cust_id",), "Email": ("email",), "Phone": ("phone_us", "phone_intl")}
_BY_VALUE = [f"""SELECT '{c}' AS "Column", '{k}' AS "PII_Type", 'value_regex' AS "Detection_Method", count(*) FILTER (regexp_matches({c}, '{p[0]}')) AS "Matches", count(*) AS "Texts" FROM demo_customers WHERE {c} IS NOT NULL"""
             for c in _TEXTS for k, p in pii.PATTERNS.items() if p[0] and k not in _BY_NAME.get(c, ())]


@query(f"""SELECT * FROM ({" UNION ALL ".join(_BY_VALUE)}) WHERE "Matches" > 0
  UNION ALL {" UNION ALL ".join(f"SELECT '{c}', '{k}', 'column_name', NULL, NULL" for c, kinds in _BY_NAME.items() for k in kinds)}""")
def pii_scan_full(t):
    """Personal data by the names of columns and by the values of all rows, with the numbers of texts that match."""
    return pii.scan_pii(t("demo_customers"), warn=False, full_scan=True, counts=True).select("Column", "PII_Type", "Detection_Method", "Matches", "Texts")


@query("SELECT count(*) FILTER (regexp_matches(Email, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) * 1.0 / count(*) > 0.5 AS high FROM demo_customers WHERE Email IS NOT NULL")
def pii_scan_values(t):
    """Whether a column of another name is found to hold addresses by its values, over all rows."""
    df = t("demo_customers").select(F.col("Email").alias("contact"))
    return pii.scan_pii(df, warn=False, full_scan=True).filter("PII_Type = 'email'").select((F.col("Confidence") == "high").alias("high"))


@query("SELECT row_id, substr(sha256(Email), 1, 12) AS Email FROM demo_customers")
def mask_hash(t):
    return pii.mask_pii(t("demo_customers").select("row_id", "Email"), strategy="hash", columns_to_mask=["Email"])


@query("SELECT row_id, '[REDACTED]' AS Email FROM demo_customers")
def mask_redact(t):
    return pii.mask_pii(t("demo_customers").select("row_id", "Email"), columns_to_mask=["Email"])


@query("SELECT count(DISTINCT Email) AS names, count(Email) AS filled FROM demo_customers")
def mask_pseudonymise(t):
    """Pseudonyms keep what is equal and what is null."""
    out = pii.mask_pii(t("demo_customers").select("row_id", "Email"), strategy="pseudonymise", columns_to_mask=["Email"]).df
    return out.agg(F.count_distinct("Email").alias("names"), F.count("Email").alias("filled"))


@query("SELECT Region, CAST(sum(Revenue) AS BIGINT) AS \"Sum_Revenue\" FROM sales_plan WHERE Revenue > 300000 AND Region IS NOT NULL GROUP BY 1")
def pipeline_run(t):
    """A pipeline of input, filter, summarize and sort, declared as data."""
    path = t("sales_plan").inputFiles()[0]
    spec = {"name": "plan", "steps": [
        {"id": "load", "tool": "InOut.input_data", "args": {"path": path.replace("file://", ""), "format": "parquet"}},
        {"id": "big", "tool": "Preparation.filter", "inputs": {"df": "load"}, "args": {"condition": "Revenue > 300000"}},
        {"id": "sum", "tool": "Transform.summarize", "inputs": {"df": "big.true"}, "args": {"group_by": "Region", "aggregations": {"Revenue": "sum"}}},
        {"id": "out", "tool": "Preparation.sort", "inputs": {"df": "sum"}, "args": {"columns": "Region"}},
    ]}
    pipe = Pipeline(spec)
    pipe.run()
    return pipe.state["out"]


@query("SELECT event_type, count(*) AS rows FROM events WHERE value > 50 GROUP BY 1")
def stream_pipeline(t):
    """A pipeline of row-wise tools over the events as a stream of files, written and counted."""
    spark = get_spark()
    src = new_path(spark, "stream-in")
    t("events").write.parquet(src)
    stream = adapter.read_stream(spark, src)
    kept = adapter.apply_to_stream(stream, {"steps": [{"id": "big", "tool": "Preparation.filter", "inputs": {"df": "stream"}, "args": {"condition": "value > 50"}}]})
    out = new_path(spark, "stream-out")
    adapter.for_each_batch(kept, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS rows FROM events GROUP BY ALL")
def stream_windows(t):
    """Events per type and day as a windowed aggregate of a stream, over all its files."""
    spark = get_spark()
    src = new_path(spark, "windows-in")
    t("events").coalesce(1).write.parquet(src)
    totals = adapter.windowed_totals(adapter.read_stream(spark, src), "ts", "value", ["event_type"], "1 day", late="3650 days")
    out = new_path(spark, "windows-out")
    q = totals.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", new_path(spark, "windows-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "rows")



"""One query per tool, each over whole tables, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.operators import combine, develop, parse, transform
from anchorline.operators import preparation as prep
from anchorline.queries.problems import read
from anchorline.session import get_spark, use_spark
from anchorline.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with use_spark(spark):
                return fn(lambda t: read(spark, sf_dir, t))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# Flagship: a chain of tools


@query("""SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS "Sum_Revenue", count(l_orderkey) AS "Count_l_orderkey"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_returnflag <> 'R' GROUP BY 1, 2""")
def flagship_revenue(t):
    """Revenue by region and segment: filter, formula, joins, summarize, sort."""
    kept = prep.filter(t("lineitem"), "l_returnflag != 'R'").true
    priced = prep.formula(kept, "Revenue", "l_extendedprice * (1 - l_discount)")
    out = combine.join(priced, t("orders"), left_on="l_orderkey", right_on="o_orderkey").joined
    out = combine.join(out, t("customer"), left_on="o_custkey", right_on="c_custkey").joined
    out = combine.join(out, t("nation"), left_on="c_nationkey", right_on="n_nationkey").joined
    out = combine.join(out, t("region"), left_on="n_regionkey", right_on="r_regionkey").joined
    out = transform.summarize(out, ["r_name", "c_mktsegment"], {"Revenue": "sum", "l_orderkey": "count"}, sort=False)
    return prep.sort(prep.formula(out, "Sum_Revenue", "round(Sum_Revenue, 2)"), ["r_name", "c_mktsegment"])


# In/Out


@query("SELECT * FROM demo_customers")
def input_data(t):
    return t("demo_customers")


@query("SELECT format, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet'), ('orc')) v(format)")
def output_data(t):
    """Orders written as csv, tsv, json, parquet and orc and read again: rows by format."""
    from anchorline.session import new_path

    src, spark = t("orders"), get_spark()
    out = None
    for fmt in ("csv", "tsv", "jsonl", "parquet", "orc"):
        path = new_path(spark, f"sink-{fmt}")
        files.output_data(src, path, format=fmt)
        n = transform.count_records(files.input_data(path, format=fmt), "rows").select(F.lit(fmt).alias("format"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (CAST(2 AS BIGINT), NULL)) v(ID, Name)")
def text_input(t):
    return files.text_input({"ID": [1, 2], "Name": ["a", None]})


@query(None)
def directory(t):
    import os

    at = t("region").inputFiles()[0].replace("file://", "")
    folder = os.path.dirname(at)
    return files.directory(folder if not folder.endswith(".parquet") else os.path.dirname(folder), "*")


@query("SELECT * FROM (VALUES ('nations.parquet', 'nations', true), ('regions.csv', 'regions', true)) v(\"FileName\", \"ShortFileName\", filled)")
def directory_written(t):
    """The files that two sinks wrote, by the names that the listing gives and whether they hold bytes."""
    from anchorline.session import new_path

    folder = new_path(get_spark(), "listed").replace("file://", "")
    files.output_data(t("nation"), f"{folder}/nations.parquet")
    files.output_data(t("region"), f"{folder}/regions.csv")
    return files.directory(folder, "*").select("FileName", "ShortFileName", (F.col("Size") > 0).alias("filled"))


@query("SELECT true AS given, true AS near")
def date_time_now_given(t):
    """The present moment is given, and is that of the session's clock."""
    now = F.col("DateTime").cast("timestamp")
    return files.date_time_now().select(now.isNotNull().alias("given"), (F.abs(F.unix_timestamp(now) - F.unix_timestamp(F.current_timestamp())) < 86_400).alias("near"))


@query(None)
def date_time_now(t):
    return files.date_time_now()


@query("SELECT * FROM nation")
def browse(t):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()):
        return files.browse(t("nation"))


# Preparation


@query("SELECT * FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05")
def filter_true(t):
    return prep.filter(t("lineitem"), "l_quantity > 25 and l_discount <= 0.05").true


@query("SELECT row_id, Amount FROM demo_sales WHERE (Amount > 500) IS NOT TRUE")
def filter_false_nulls(t):
    return prep.filter(t("demo_sales").select("row_id", "Amount"), "Amount > 500").false


@query("SELECT row_id, Tier FROM demo_customers WHERE Tier IS DISTINCT FROM 'Core'")
def filter_not_equal(t):
    return prep.filter(t("demo_customers").select("row_id", "Tier"), column="Tier", operator="!=", value="Core").true


@query("SELECT row_id, Email FROM demo_customers WHERE coalesce(Email, '') = ''")
def filter_is_empty(t):
    return prep.filter(t("demo_customers").select("row_id", "Email"), column="Email", operator="is empty").true


@query("SELECT row_id, Name FROM demo_customers WHERE Name IS NULL OR NOT contains(Name, 'GmbH')")
def filter_not_contains(t):
    return prep.filter(t("demo_customers").select("row_id", "Name"), column="Name", operator="does not contain", value="GmbH").true


@query("SELECT row_id, Amount / nullif(Quantity, 0) AS unit, Amount - Quantity * floor(Amount / nullif(Quantity, 0)) AS rest FROM demo_sales")
def formula_arith(t):
    out = prep.formula(t("demo_sales").select("row_id", "Amount", "Quantity"), "unit", "Amount / Quantity")
    out = prep.formula(out, "rest", "Amount % Quantity")
    return prep.formula(out, "rest", F.col("rest").cast("double")).select("row_id", "unit", "rest")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def formula_callable(t):
    return prep.formula(t("orders").select("o_orderkey", "o_totalprice"), "size", lambda df: F.when(df.o_totalprice > 100000, "big").otherwise("small")).select("o_orderkey", "size")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"Order\", CAST(round(o_totalprice, 0) AS BIGINT) AS Price FROM orders")
def select_cast_rename(t):
    whole = prep.formula(t("orders"), "o_totalprice", "round(o_totalprice, 0)")
    return prep.select(whole, ["o_orderkey", "o_totalprice"], {"o_orderkey": "Order", "o_totalprice": "Price"}, {"Order": "str", "Price": "int64"})


@query(r"SELECT row_id, upper(regexp_replace(SalesRep, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS SalesRep FROM demo_sales")
def cleanse_upper(t):
    return prep.data_cleansing(t("demo_sales").select("row_id", "SalesRep"), ["SalesRep"], modify_case="upper")


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS c_name FROM customer")
def cleanse_letters_punct(t):
    return prep.data_cleansing(t("customer").select("c_custkey", "c_name"), ["c_name"], remove_letters=True, remove_punctuation=True)


@query("SELECT row_id, coalesce(Tier, 'none') AS Tier FROM demo_customers")
def cleanse_fill(t):
    return prep.data_cleansing(t("demo_customers").select("row_id", "Tier"), ["Tier"], replace_nulls_with="none", strip_whitespace=False)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_topk(t):
    return prep.sample(prep.sort(t("orders"), ["o_totalprice", "o_orderkey"], [False, True]), n=100)


_FIRST = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn FROM {table}) WHERE rn {op} 1"


@query(_FIRST.format(key="user_id", by="event_id", table="events", op="="))
def unique_u(t):
    return prep.unique(t("events"), "user_id", order_by="event_id").unique


@query(_FIRST.format(key="user_id", by="event_id", table="events", op=">"))
def unique_d(t):
    return prep.unique(t("events"), "user_id", order_by="event_id").duplicate


@query(_FIRST.format(key="lower(SalesRep)", by="row_id", table="(SELECT row_id, SalesRep FROM demo_sales)", op="="))
def unique_icase(t):
    return prep.unique(t("demo_sales").select("row_id", "SalesRep"), "SalesRep", ignore_case=True, order_by="row_id").unique


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_first(t):
    return prep.sample(t("orders"), n=50, order_by="o_orderkey")


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM orders)")
def sample_last_pct(t):
    return prep.sample(t("orders"), pct=0.01, position="last", order_by="o_orderkey")


@query("SELECT 500 AS \"Count\"")
def sample_random_count(t):
    return transform.count_records(prep.sample(t("orders"), n=500, random=True, random_state=1))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) + 99 AS \"RecordID\", * FROM orders")
def record_id(t):
    return prep.record_id(t("orders"), start=100, order_by="o_orderkey")


@query("SELECT range AS n, range * range AS square FROM range(1000)")
def generate_rows(t):
    return prep.generate_rows(1000, lambda i: {"n": i, "square": i * i})


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part")
def auto_field(t):
    out = prep.auto_field(t("part").select("p_partkey", "p_size", "p_brand"))
    return prep.select(out, dtypes={"p_partkey": "int64", "p_size": "int64"})


@query("SELECT p_partkey, p_size * 2 AS p_size, p_retailprice * 2 AS p_retailprice FROM part")
def multi_field(t):
    return prep.multi_field_formula(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "_CurrentField_ * 2")


@query("SELECT event_id, value - lag(value) OVER (ORDER BY event_id) AS value FROM events")
def multi_row_diff(t):
    return prep.multi_row_formula(t("events").select("event_id", "value"), "value", lambda cur, prev: cur - prev, order_by="event_id")


@query("SELECT event_id, user_id, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
def multi_row_next(t):
    return prep.multi_row_formula(t("events").select("event_id", "user_id", "value"), "value", lambda cur, nxt: nxt, -1, "user_id", "event_id")


@query("""WITH e AS (SELECT quantile_cont(CAST(p_size AS DOUBLE), 0.25) AS a, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS b, quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS c FROM part)
  SELECT p_partkey, CASE WHEN p_size <= a THEN 1 WHEN p_size <= b THEN 2 WHEN p_size <= c THEN 3 ELSE 4 END AS "Tile" FROM part, e""")
def tile_records(t):
    return prep.tile(t("part").select("p_partkey", "p_size"), "p_size", 4).select("p_partkey", "Tile")


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
  SELECT c_custkey, CAST(least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / 5)), 1), 5) AS INT) AS "Tile" FROM customer, e""")
def tile_range(t):
    return prep.tile(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5, "equal_range").select("c_custkey", "Tile")


@query("""SELECT row_id, coalesce(CAST(Amount AS DOUBLE), (SELECT avg(Amount) FROM demo_sales)) AS Amount, coalesce(CAST(Quantity AS DOUBLE), (SELECT avg(Quantity) FROM demo_sales)) AS Quantity,
  Amount IS NULL AS "Amount_WasImputed", Quantity IS NULL AS "Quantity_WasImputed" FROM demo_sales""")
def impute_mean(t):
    return prep.imputation(t("demo_sales").select("row_id", "Amount", "Quantity"), ["Amount", "Quantity"])


@query("SELECT row_id, coalesce(CAST(Quantity AS DOUBLE), (SELECT median(Quantity) FROM demo_sales)) AS Quantity, Quantity IS NULL AS \"Quantity_WasImputed\" FROM demo_sales")
def impute_median(t):
    return prep.imputation(t("demo_sales").select("row_id", "Quantity"), "Quantity", "median")


@query("SELECT row_id, coalesce(Tier, (SELECT Tier FROM demo_customers WHERE Tier IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS Tier FROM demo_customers")
def impute_mode(t):
    return prep.imputation(t("demo_customers").select("row_id", "Tier"), "Tier", "mode", add_indicator=False)


@query("SELECT CAST(floor(n * 0.5) AS BIGINT) AS e, CAST(floor(n * 0.3) AS BIGINT) AS v, n - CAST(floor(n * 0.5) AS BIGINT) - CAST(floor(n * 0.3) AS BIGINT) AS h FROM (SELECT count(*) AS n FROM orders)")
def create_samples_sizes(t):
    s = prep.create_samples(t("orders"), 0.5, 0.3, 0.2, random_state=5)
    n = [transform.count_records(x, c) for x, c in zip(s, ("e", "v", "h"), strict=True)]
    return combine.append_fields(combine.append_fields(n[0], n[1]), n[2])


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def date_filter_in(t):
    return prep.date_filter(t("orders"), "o_orderdate", "1995-01-01", "1996-06-30").true


@query("SELECT row_id, Date FROM demo_sales WHERE (Date >= DATE '2025-01-01') IS NOT TRUE")
def date_filter_out(t):
    return prep.date_filter(t("demo_sales").select("row_id", "Date"), "Date", "2025-01-01").false


@query("SELECT o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') ELSE count(*) END AS \"Size_o_orderkey\" FROM orders GROUP BY 1")
def oversample_counts(t):
    out = prep.oversample_field(t("orders"), "o_orderstatus", "P", 0.5, random_state=3)
    return transform.summarize(out, "o_orderstatus", {"o_orderkey": "size"})


def _rank(method: str, expr: str) -> None:
    def fn(t):
        return prep.rank(t("part").select("p_partkey", "p_size"), "p_size", method=method, order_by="p_partkey")

    fn.__name__ = f"rank_{method}"
    fn.__doc__ = f"Global rank, ties: {method}."
    query(f'SELECT p_partkey, p_size, {expr} AS "Rank" FROM part')(fn)


_rank("min", "rank() OVER (ORDER BY p_size DESC)")
_rank("dense", "dense_rank() OVER (ORDER BY p_size DESC)")
_rank("first", "row_number() OVER (ORDER BY p_size DESC, p_partkey)")
_rank("max", "rank() OVER (ORDER BY p_size DESC) + count(*) OVER (PARTITION BY p_size) - 1")
_rank("average", "rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2")


@query("SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS \"Rank\" FROM part")
def rank_grouped(t):
    return prep.rank(t("part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_brand", ascending=True)


# Join


@query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_j(t):
    return combine.join(t("orders"), t("lineitem"), left_on="o_orderkey", right_on="l_orderkey").joined.select("o_orderkey", "o_custkey", "l_partkey", "l_quantity")


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_l(t):
    return combine.join(t("orders"), t("lineitem"), left_on="o_orderkey", right_on="l_orderkey").left


@query("SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_r(t):
    done = prep.filter(t("orders"), "o_orderstatus = 'F'").true
    return combine.join(done, t("lineitem"), left_on="o_orderkey", right_on="l_orderkey").right


@query("SELECT a.row_id AS row_id_left, b.Quarter FROM demo_customers a JOIN sales_plan b ON a.Region IS NOT DISTINCT FROM b.Region")
def join_nullkeys(t):
    out = combine.join(t("demo_customers").select("row_id", "Region"), t("sales_plan"), on="Region").joined
    return out.select(F.col("row_id").alias("row_id_left"), "Quarter")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_keydrift(t):
    text = prep.select(t("customer"), ["c_custkey", "c_name"], None, {"c_custkey": "str"})
    return combine.join(t("orders"), text, left_on="o_custkey", right_on="c_custkey").joined.select("o_orderkey", "c_name")


@query("SELECT a.CustomerID, a.row_id AS row_id_left, b.row_id AS row_id_right FROM demo_customers a JOIN demo_customers b USING (CustomerID) WHERE a.Tier = 'Core'")
def join_suffix(t):
    c = t("demo_customers").select("CustomerID", "row_id", "Tier")
    return combine.join(prep.filter(c, "Tier = 'Core'").true.drop("Tier"), c.drop("Tier"), on="CustomerID").joined


@query("SELECT n_nationkey AS k, n_name, c_customers, s_suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c_customers FROM customer GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s_suppliers FROM supplier GROUP BY 1) s ON n_nationkey = s.k")
def join_multiple(t):
    n = prep.select(t("nation"), ["n_nationkey", "n_name"], {"n_nationkey": "k"})
    c = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c_customers"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("s_suppliers"))
    return combine.join_multiple(n, c, s, on="k", join_type="outer")


@query("SELECT r_regionkey AS id, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_name(t):
    r = prep.select(t("region"), renames={"r_regionkey": "id", "r_name": "name"})
    return combine.union(r, prep.select(t("nation"), renames={"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"}))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_position(t):
    return combine.union(t("region"), t("nation").select("n_nationkey", "n_name"), by="position")


@query("SELECT n_name, r_name FROM nation, region")
def append_fields(t):
    return combine.append_fields(t("nation").select("n_name"), t("region").select("r_name"))


@query("SELECT c_custkey, n_name AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def find_replace_entire(t):
    c = prep.select(t("customer"), ["c_custkey", "c_nationkey"], None, {"c_nationkey": "str"})
    return combine.find_replace(c, t("nation"), "n_nationkey", "n_name", "c_nationkey")


@query("SELECT p_partkey, replace(replace(p_type, 'a', 'A'), 'E', '3') AS p_type FROM part")
def find_replace_partial(t):
    table = files.text_input([["a", "A"], ["E", "3"]], ["f", "r"])
    return combine.find_replace(t("part").select("p_partkey", "p_type"), table, "f", "r", "p_type", mode="partial")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'b' WHEN contains(c_mktsegment, 'A') THEN 'a' END AS kind FROM customer")
def find_replace_append(t):
    table = files.text_input([["BUILD", "b"], ["A", "a"]], ["f", "kind"])
    return combine.find_replace(t("customer").select("c_custkey", "c_mktsegment"), table, "f", "kind", "c_mktsegment", mode="partial", append=True)


@query(None)
def fuzzy_match(t):
    """Nations with similar names, by matching characters."""
    n = t("nation").select("n_name")
    return combine.fuzzy_match(n, n, "n_name", "n_name", 0.6)


@query("SELECT a.n_name AS n_name_left, b.n_name AS n_name_right, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 4) AS \"MatchScore\" FROM nation a, nation b WHERE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) >= 0.5")
def fuzzy_match_levenshtein(t):
    n = t("nation").select("n_name")
    return combine.fuzzy_match(n, n, "n_name", "n_name", 0.5, method="levenshtein")


#: Plain letters only: a distance in SQL counts bytes.
_NAMES = "SELECT DISTINCT Name, lower(substr(Name, 1, 2)) AS k FROM (SELECT regexp_replace(Name, '[^ -~]', '', 'g') AS Name FROM demo_customers)"


@query(f"""SELECT a.Name AS "Name_left", a.k AS "k_left", b.Name AS "Name_right", b.k AS "k_right", round(1 - levenshtein(a.Name, b.Name) / greatest(length(a.Name), length(b.Name)), 4) AS "MatchScore"
  FROM ({_NAMES}) a JOIN ({_NAMES}) b ON a.k = b.k WHERE length(a.Name) > 0 AND 1 - levenshtein(a.Name, b.Name) / greatest(length(a.Name), length(b.Name)) >= 0.8""")
def fuzzy_match_blocked(t):
    """All customers' names against all that begin with the same two letters."""
    n = t("demo_customers").select(F.regexp_replace("Name", "[^ -~]", "").alias("Name")).filter("length(Name) > 0").select("Name", F.lower(F.substring("Name", 1, 2)).alias("k")).distinct()
    return combine.fuzzy_match(n, n, "Name", "Name", 0.8, method="levenshtein", block=("k", "k"))


@query("SELECT Region, max(Revenue) - min(Revenue) AS \"Spread_Revenue\" FROM sales_plan WHERE Region IS NOT NULL GROUP BY 1")
def summarize_callable(t):
    """An aggregate given as a function of the column."""

    def spread(c):
        return F.max(c) - F.min(c)

    return transform.summarize(t("sales_plan"), "Region", {"Revenue": spread})


@query("SELECT * FROM lineitem WHERE l_quantity > 45")
def filter_pandas(t):
    """A filter whose condition is a function of a pandas frame."""
    return prep.filter(t("lineitem"), lambda f: f["l_quantity"] > 45, udf=True).true


@query("SELECT row_id, Amount, CAST(Amount * 2 + 1 AS DOUBLE) AS twice FROM demo_sales")
def formula_pandas(t):
    """A formula that is a function of a pandas frame."""
    return prep.formula(t("demo_sales").select("row_id", "Amount"), "twice", lambda f: f["Amount"] * 2.0 + 1.0, udf=True, returns="double")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'u' || user_id AS a, 'd' || (user_id // 3) AS b FROM events),
  n AS (SELECT a AS k FROM e UNION SELECT b FROM e), g AS (SELECT k, 'd' || (CAST(substr(k, 2) AS BIGINT) // CASE WHEN k LIKE 'u%' THEN 3 ELSE 1 END) AS grp FROM n)
  SELECT min(k) OVER (PARTITION BY grp) AS "Group", k AS "Key" FROM g""")
def make_group(t):
    pairs = t("events").select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("d"), F.expr("user_id div 3")).alias("b"))
    return combine.make_group(pairs, "a", "b")


# Transform

_AGGS = {
    "sum": "CAST(coalesce(sum({c}), 0) AS BIGINT)", "mean": "avg({c})", "count": "count({c})", "count distinct": "count(DISTINCT {c})", "count null": "count(*) FILTER ({c} IS NULL)",
    "min": "min({c})", "max": "max({c})", "first": "min_by({c}, row_id) FILTER ({c} IS NOT NULL)", "last": "max_by({c}, row_id) FILTER ({c} IS NOT NULL)", "std": "stddev_samp({c})", "var": "var_samp({c})", "median": "median({c})", "size": "count(*)",
}


def _summarize(name: str, expr: str) -> None:
    def fn(t):
        out = transform.summarize(t("demo_sales"), "Product", {"Quantity": name}, order_by="row_id", sort=False)
        return out.withColumnRenamed(out.columns[1], "v")

    fn.__name__ = "summarize_" + name.replace(" ", "_")
    fn.__doc__ = f"{name} of Quantity per Product."
    query(f"SELECT Product, {expr.format(c='Quantity')} AS v FROM demo_sales WHERE Product IS NOT NULL GROUP BY 1")(fn)


for _n, _e in _AGGS.items():
    _summarize(_n, _e)


def _summarize_text(name: str, expr: str) -> None:
    def fn(t):
        out = transform.summarize(t("demo_customers"), "Region", {"Tier": name}, order_by="row_id", sort=False)
        return out.withColumnRenamed(out.columns[1], "v")

    fn.__name__ = "summarize_" + name.replace(" ", "_")
    fn.__doc__ = f"{name} of Tier per Region."
    query(f"SELECT Region, {expr} AS v FROM demo_customers WHERE Region IS NOT NULL GROUP BY 1")(fn)


for _n, _e in {
    "count blank": r"count(*) FILTER (regexp_full_match(Tier, '\s*'))", "count non blank": r"count(*) FILTER (NOT regexp_full_match(Tier, '\s*'))",
    "concatenate": "coalesce(string_agg(Tier, ',' ORDER BY row_id), '')", "concatenate distinct": "array_to_string(list_transform(list_sort(map_entries(map_from_entries(list_reverse(list(ROW(Tier, row_id) ORDER BY row_id) FILTER (Tier IS NOT NULL))))), x -> x), ',')",
    "longest": "min_by(Tier, (-length(Tier), row_id)) FILTER (Tier IS NOT NULL)", "shortest": "min_by(Tier, (length(Tier), row_id)) FILTER (Tier IS NOT NULL)",
}.items():
    _summarize_text(_n, _e)

SQL["summarize_concatenate_distinct"] = """SELECT Region, string_agg(Tier, ',' ORDER BY r) AS v FROM (SELECT Region, Tier, min(row_id) AS r FROM demo_customers WHERE Region IS NOT NULL AND Tier IS NOT NULL GROUP BY ALL) GROUP BY 1"""


@query("SELECT Region, (SELECT Tier FROM demo_customers b WHERE b.Region = a.Region AND Tier IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS v FROM (SELECT DISTINCT Region FROM demo_customers WHERE Region IS NOT NULL) a")
def summarize_mode(t):
    return transform.summarize(t("demo_customers"), "Region", {"Tier": "mode"}, sort=False).withColumnRenamed("Mode_Tier", "v")


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS \"Sum_l_quantity\", count(l_orderkey) AS \"Count_l_orderkey\" FROM lineitem")
def summarize_global(t):
    return transform.summarize(t("lineitem"), None, {"l_quantity": "sum", "l_orderkey": "count"})


@query("SELECT Region, Quarter, 'Revenue' AS \"Name\", Revenue AS \"Value\" FROM sales_plan UNION ALL SELECT Region, Quarter, 'Quantity', Quantity FROM sales_plan")
def transpose(t):
    return transform.transpose(t("sales_plan"), ["Region", "Quarter"])


@query("SELECT Region, CAST(coalesce(sum(Revenue) FILTER (Quarter = '2024-Q1'), 0) AS BIGINT) AS \"2024-Q1\", CAST(coalesce(sum(Revenue) FILTER (Quarter = '2024-Q2'), 0) AS BIGINT) AS \"2024-Q2\" FROM sales_plan WHERE Region IS NOT NULL AND Quarter IS NOT NULL GROUP BY 1")
def cross_tab(t):
    return transform.cross_tab(t("sales_plan"), "Region", "Quarter", "Revenue", "sum", values=["2024-Q1", "2024-Q2"])


@query("SELECT o_orderpriority, " + ", ".join(f"count(o_orderkey) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def cross_tab_count(t):
    return transform.cross_tab(t("orders"), "o_orderpriority", "o_orderstatus", "o_orderkey", "count")


@query("SELECT event_id, sum(user_id) OVER (ORDER BY event_id) AS total FROM events")
def running_total(t):
    return transform.running_total(t("events").select("event_id", "user_id"), "user_id", None, "total", order_by="event_id").select("event_id", "total")


@query("SELECT row_id, CASE WHEN Quantity IS NOT NULL AND Product IS NOT NULL THEN CAST(sum(Quantity) OVER (PARTITION BY Product ORDER BY row_id) AS BIGINT) END AS \"RunningTotal_Quantity\" FROM demo_sales")
def running_total_grouped(t):
    return transform.running_total(t("demo_sales").select("row_id", "Product", "Quantity"), "Quantity", "Product", order_by="row_id").select("row_id", "RunningTotal_Quantity")


@query("SELECT count(*) AS \"Count\" FROM lineitem")
def count_records(t):
    return transform.count_records(t("lineitem"))


@query("SELECT l_orderkey, l_discount AS rate, l_quantity AS q FROM lineitem UNION ALL SELECT l_orderkey, l_tax, l_extendedprice FROM lineitem")
def arrange(t):
    return transform.arrange(t("lineitem"), "l_orderkey", {"rate": ["l_discount", "l_tax"], "q": ["l_quantity", "l_extendedprice"]})


@query("WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT max(k) FILTER (i % 3 = 0) AS o_orderkey_1, max(k) FILTER (i % 3 = 1) AS o_orderkey_2, max(k) FILTER (i % 3 = 2) AS o_orderkey_3 FROM n GROUP BY i // 3")
def make_columns(t):
    return transform.make_columns(t("orders").select("o_orderkey"), 3, order_by="o_orderkey")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS \"WeightedAverage\" FROM lineitem GROUP BY 1")
def weighted_average(t):
    out = transform.weighted_average(t("lineitem"), "l_discount", "l_quantity", "l_returnflag")
    return prep.formula(out, "WeightedAverage", "round(WeightedAverage, 8)")


# Parse


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders")
def date_time_fmt(t):
    d = prep.select(t("orders"), ["o_orderkey", "o_orderdate"], {"o_orderdate": "d"})
    return parse.date_time(d, "d", output_fmt="%d/%m/%Y")


@query("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders")
def date_time_parse(t):
    d = prep.formula(t("orders").select("o_orderkey", "o_orderdate"), "d", "date_format(o_orderdate, 'dd.MM.yyyy')").select("o_orderkey", "d")
    return prep.formula(parse.date_time(d, "d", "%d.%m.%Y"), "d", "cast(d as timestamp_ntz)")


@query(r"SELECT row_id, coalesce(regexp_matches(Email, '\.example$'), false) AS \"Match\" FROM demo_customers".replace("\\\"", "\""))
def regex_match(t):
    return parse.regex_match(t("demo_customers").select("row_id", "Email"), "Email", r"\.example$").select("row_id", "Match")


@query(r"SELECT row_id, CASE WHEN regexp_matches(Email, '^([a-z]+)[._]([a-z]+)') THEN regexp_extract(Email, '^([a-z]+)[._]([a-z]+)', 1) END AS a, CASE WHEN regexp_matches(Email, '^([a-z]+)[._]([a-z]+)') THEN regexp_extract(Email, '^([a-z]+)[._]([a-z]+)', 2) END AS b FROM demo_customers")
def regex_parse(t):
    return parse.regex_parse(t("demo_customers").select("row_id", "Email"), "Email", r"^(?P<a>[a-z]+)[._](?P<b>[a-z]+)", ["a", "b"]).select("row_id", "a", "b")


@query(r"SELECT row_id, regexp_replace(Phone, '(\d{3})-(\d{4})', '\2-\1', 'g') AS Phone FROM demo_customers")
def regex_replace(t):
    return parse.regex_replace(t("demo_customers").select("row_id", "Phone"), "Phone", r"(\d{3})-(\d{4})", r"\2-\1")


@query(r"SELECT row_id, unnest(CASE WHEN Name IS NULL THEN [NULL] ELSE regexp_split_to_array(Name, ' +') END) AS Name FROM demo_customers")
def tokenize_rows(t):
    return parse.regex_tokenize(t("demo_customers").select("row_id", "Name"), "Name", " +")


@query(r"SELECT p_partkey, regexp_split_to_array(p_type, ' +')[1] AS p_type_1, regexp_split_to_array(p_type, ' +')[2] AS p_type_2 FROM part")
def tokenize_columns(t):
    return parse.regex_tokenize(t("part").select("p_partkey", "p_type"), "p_type", " +", "columns", 2)


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS c_name_1, split_part(c_name, '#', 2) AS c_name_2 FROM customer")
def text_to_columns(t):
    return parse.text_to_columns(t("customer").select("c_custkey", "c_name"), "c_name", "#")


_XML = "concat('<o id=\"', o_orderkey, '\"><status>', o_orderstatus, '</status><price>', o_custkey, '</price></o>')"


@query("SELECT o_orderkey, o_orderstatus AS \"ParsedXML\" FROM orders")
def xml_parse(t):
    x = prep.formula(t("orders"), "x", _XML)
    return parse.xml_parse(x.select("o_orderkey", "x"), "x", "status").select("o_orderkey", "ParsedXML")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS x_id, CAST(o_custkey AS VARCHAR) AS x_price, o_orderstatus AS x_status FROM orders")
def xml_parse_children(t):
    x = prep.formula(t("orders"), "x", _XML)
    return parse.xml_parse(x.select("o_orderkey", "x"), "x", "o", "x", return_child_values=True).select("o_orderkey", "x_id", "x_price", "x_status")


# Developer


@query("SELECT row_id, base64(encode(Name)) AS \"Name_Base64\" FROM demo_customers")
def base64_encode(t):
    return develop.base64_encode(t("demo_customers").select("row_id", "Name"), "Name").select("row_id", "Name_Base64")


@query("SELECT row_id, Name FROM demo_customers")
def base64_roundtrip(t):
    e = develop.base64_encode(t("demo_customers").select("row_id", "Name"), "Name", "b")
    return develop.base64_decode(e.drop("Name"), "b", "Name").select("row_id", "Name")


@query("""SELECT 'CustomerID' AS "Name", count(CustomerID) AS "NonNullCount", count(*) - count(CustomerID) AS "NullCount", count(DISTINCT CustomerID) AS "UniqueCount" FROM demo_sales
  UNION ALL SELECT 'Product', count(Product), count(*) - count(Product), count(DISTINCT Product) FROM demo_sales""")
def column_info(t):
    return develop.column_info(t("demo_sales").select("CustomerID", "Product")).select("Name", "NonNullCount", "NullCount", "UniqueCount")


@query("SELECT r_name AS r_regionkey, r_regionkey AS r_name FROM region")
def dynamic_rename(t):
    return develop.dynamic_rename(t("region"), files.text_input({"OldName": ["r_name", "r_regionkey"], "NewName": ["r_regionkey", "r_name"]}))


@query("SELECT c_name, c_mktsegment FROM customer")
def dynamic_select(t):
    return develop.dynamic_select(t("customer"), dtype_include="string", pattern="^c_")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(t):
    return develop.json_parse(t("events").select("event_id", "props"), "props", "")


@query("SELECT * FROM nation")
def assert_test(t):
    return develop.test(t("nation"), "count(*) = count(distinct n_nationkey)", "keys repeat")


@query("SELECT count(*) AS \"Count\" FROM nation")
def assert_equal(t):
    develop.test_equal(t("nation"), t("nation").repartition(3))
    return transform.count_records(t("nation"))


# Smoke workloads of a fixed size


@query("SELECT 499999 AS \"Count\"")
def bench_filter_1m(t):
    df = get_spark().range(1_000_000).select("id", (F.col("id") * 2).alias("v"))
    return transform.count_records(prep.filter(df, "v > 1000000").true)


@query("SELECT range AS id FROM range(1000000)")
def bench_sort_1m(t):
    df = get_spark().range(1_000_000).select((F.lit(999_999) - F.col("id")).alias("id"))
    return prep.sort(df, "id")


@query("SELECT 250000 AS \"Count\"")
def bench_join_500k(t):
    a = get_spark().range(500_000).select("id", (F.col("id") * 3).alias("x"))
    b = get_spark().range(250_000).select("id", (F.col("id") * 5).alias("y"))
    return transform.count_records(combine.join(a, b, on="id").joined)


@query("SELECT range % 4 AS g, CAST(sum(range) AS BIGINT) AS \"Sum_v\", avg(range) AS \"Mean_v\", count(*) AS \"Count_v\" FROM range(1000000) GROUP BY 1")
def bench_summarize_1m(t):
    df = get_spark().range(1_000_000).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"))
    return transform.summarize(df, "g", {"v": ["sum", "mean", "count"]})

"""Independent SQL for the queries of `problems`, where SQL can state them."""

from __future__ import annotations

EMAIL = r"[A-Za-z0-9_%+-]+(\.[A-Za-z0-9_%+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"

P1_FOUND = f"""
WITH c AS (SELECT row_id, load_id, Email, Tier FROM demo_customers),
vals AS (
  SELECT 'demo_customers.Email' AS col, 'value' AS kind, row_id AS ref FROM c WHERE Email IS NOT NULL AND NOT regexp_full_match(Email, '{EMAIL}')
  UNION ALL SELECT 'demo_customers.Tier', 'value', row_id FROM c WHERE Tier IS NOT NULL AND Tier NOT IN ('Anchor', 'Core', 'Growth', 'Trial')),
long AS (
  SELECT 'demo_customers.Email' AS col, load_id, Email AS v FROM c
  UNION ALL SELECT 'demo_customers.Tier', load_id, Tier FROM c
  UNION ALL SELECT 'demo_sales.Amount', load_id, CAST(Amount AS VARCHAR) FROM demo_sales),
per AS (SELECT col, load_id, count(*) AS n, count(v) AS m, 1 - count(v) / count(*) AS nulls, median(CAST(CASE WHEN col = 'demo_sales.Amount' THEN v END AS BIGINT)) AS med FROM long GROUP BY ALL),
usual AS (SELECT col, median(nulls) AS nulls, median(med) AS med FROM per GROUP BY ALL),
shares AS (SELECT l.col, l.load_id, l.v, count(*) / any_value(p.m) AS share FROM long l JOIN per p USING (col, load_id) WHERE l.v IS NOT NULL AND l.col <> 'demo_sales.Amount' GROUP BY ALL),
grid AS (SELECT p.col, p.load_id, x.v, coalesce(s.share, 0) AS share FROM per p JOIN (SELECT DISTINCT col, v FROM shares WHERE share > 0.25) x USING (col) LEFT JOIN shares s USING (col, load_id, v) WHERE p.m > 0),
ushare AS (SELECT col, v, median(share) AS u FROM grid GROUP BY ALL),
odd AS (
  SELECT col, load_id FROM per JOIN usual USING (col) WHERE abs(per.nulls - usual.nulls) > 0.2 OR per.med > greatest(2 * usual.med, usual.med / 2) OR per.med < least(2 * usual.med, usual.med / 2)
  UNION SELECT g.col, g.load_id FROM grid g JOIN ushare USING (col, v) WHERE abs(g.share - u) > 0.25)
SELECT col, kind, ref FROM vals UNION ALL SELECT DISTINCT col, 'load', CAST(load_id AS BIGINT) FROM odd
"""

#: Stand-ins by the usual rate of a product and of a load, over distinct combinations.
STAND_INS = r"""
combos AS (SELECT DISTINCT Product AS g, load_id AS p, Amount AS a, Quantity AS q, Category AS c FROM demo_sales),
rated AS (SELECT g, p, a, q, abs(a) / q AS r FROM (SELECT DISTINCT g, p, a, q, c FROM combos) WHERE g IS NOT NULL AND a <> 0 AND q > 0),
rate AS (SELECT g, median(r) AS rate FROM rated GROUP BY g),
rel AS (SELECT rated.*, r / rate AS rel FROM rated JOIN rate USING (g)),
off AS (SELECT p, median(rel) AS off FROM rel GROUP BY p),
fit AS (SELECT g, a, q, CASE WHEN rel / off BETWEEN 0.4 AND 2.5 THEN 1 ELSE 0 END AS fit FROM rel JOIN off USING (p)),
allfit AS (SELECT g, a, q, fit FROM fit UNION ALL SELECT g, a, q, 0 FROM combos WHERE g IS NOT NULL AND (a = 0 OR q <= 0)),
bad_a AS (SELECT a FROM (SELECT a, g, fit FROM fit UNION ALL SELECT a, g, 0 FROM combos WHERE g IS NOT NULL AND a = 0) GROUP BY a HAVING count(DISTINCT g) >= 2 AND avg(fit) < 0.2),
bad_q AS (SELECT q FROM (SELECT q, g, fit FROM fit UNION ALL SELECT q, g, 0 FROM combos WHERE g IS NOT NULL AND q <= 0) GROUP BY q HAVING count(DISTINCT g) >= 2 AND avg(fit) < 0.2),
bad_c AS (SELECT DISTINCT c FROM combos WHERE c IS NOT NULL AND (NOT regexp_matches(c, '[\p{L}\p{N}]') OR lower(trim(c)) IN ('n/a', 'na', '#n/a', 'n.a.', 'null', 'nil', 'none', 'nan', 'unknown', 'undefined', 'missing', 'not available', 'tbd', 'tba', 'unspecified')))
"""

P2_ROLLING = f"""
WITH {STAND_INS},
once AS (SELECT TransactionID, min_by(CustomerID, row_id) AS CustomerID, min_by(Date, row_id) AS Date, min_by(CASE WHEN Amount NOT IN (SELECT a FROM bad_a) THEN Amount END, row_id) AS Amount FROM demo_sales GROUP BY TransactionID),
daily AS (SELECT CustomerID, Date, coalesce(sum(Amount), 0) AS t, count(Amount) AS c FROM once WHERE CustomerID IS NOT NULL AND Date IS NOT NULL GROUP BY ALL),
days AS (SELECT CustomerID, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), (SELECT CAST(max(Date) AS TIMESTAMP) FROM demo_sales), INTERVAL 1 DAY)) AS DATE) AS Date FROM (SELECT CustomerID, min(Date) AS lo FROM daily GROUP BY ALL)),
dense AS (SELECT CustomerID, Date, coalesce(t, 0) AS t, coalesce(c, 0) AS c FROM days LEFT JOIN daily USING (CustomerID, Date))
SELECT CustomerID, Date,
  CAST(sum(t) OVER w7 AS BIGINT) AS total_7, CAST(sum(t) OVER w7 AS DOUBLE) / 7 AS avg_7, CAST(sum(c) OVER w7 AS BIGINT) AS rows_7,
  CAST(sum(t) OVER w30 AS BIGINT) AS total_30, CAST(sum(t) OVER w30 AS DOUBLE) / 30 AS avg_30, CAST(sum(c) OVER w30 AS BIGINT) AS rows_30
FROM dense
WINDOW w7 AS (PARTITION BY CustomerID ORDER BY Date ROWS 6 PRECEDING), w30 AS (PARTITION BY CustomerID ORDER BY Date ROWS 29 PRECEDING)
"""

_REP = r"lower(regexp_replace(SalesRep, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"

P3_FOUND = f"""
WITH k AS (SELECT 'CustomerID' AS col, CAST(CustomerID AS VARCHAR) AS key_value FROM demo_sales UNION ALL SELECT 'SalesRep', {_REP} FROM demo_sales)
SELECT col, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) > 0.03 * (SELECT count(*) FROM demo_sales)
"""

P3_TOTALS = f"""
WITH {STAND_INS},
k AS (
  SELECT 'CustomerID' AS col, CAST(CustomerID AS VARCHAR) AS key_value, TransactionID AS t, CASE WHEN Amount NOT IN (SELECT a FROM bad_a) THEN Amount END AS a FROM demo_sales
  UNION ALL SELECT 'SalesRep', {_REP}, TransactionID, CASE WHEN Amount NOT IN (SELECT a FROM bad_a) THEN Amount END FROM demo_sales),
s AS (SELECT col, key_value, t, count(*) AS n, max(a) AS a FROM k WHERE key_value IS NOT NULL GROUP BY ALL)
SELECT col, key_value, CAST(sum(n) AS BIGINT) AS rows, count(t) AS sales, CAST(sum(a) AS BIGINT) AS total_amount, min(a) AS min_amount, max(a) AS max_amount FROM s GROUP BY ALL
"""

P4_FOUND = f"""
WITH {STAND_INS}
SELECT row_id, 'Amount' AS col FROM demo_sales WHERE Amount IS NULL OR Amount IN (SELECT a FROM bad_a)
UNION ALL SELECT row_id, 'Quantity' FROM demo_sales WHERE Quantity IS NULL OR Quantity IN (SELECT q FROM bad_q)
UNION ALL SELECT row_id, 'Category' FROM demo_sales WHERE Category IS NULL OR Category IN (SELECT c FROM bad_c)
"""

_P7 = """
WITH p AS (SELECT CustomerID, min(loaded_at) AS arrived, min(deleted_at) AS gone FROM demo_customers WHERE CustomerID IS NOT NULL GROUP BY ALL),
o AS (
  SELECT s.row_id, s.Date, CASE WHEN p.CustomerID IS NULL THEN 'missing' WHEN arrived > s.loaded_at THEN 'late' WHEN gone <= s.loaded_at THEN 'deleted' END AS kind
  FROM demo_sales s LEFT JOIN p USING (CustomerID) WHERE s.CustomerID IS NOT NULL)
"""

SQL = {
    "p1_found": P1_FOUND,
    "p2_rolling": P2_ROLLING,
    "p3_found": P3_FOUND,
    "p3_totals": P3_TOTALS,
    "p4_found": P4_FOUND,
    "p7_found": _P7 + "SELECT row_id, kind FROM o WHERE kind IS NOT NULL",
    "p7_report": _P7 + "SELECT 'demo_sales' AS \"table\", CAST(date_trunc('month', Date) AS DATE) AS month, kind, count(*) AS rows FROM o WHERE kind IS NOT NULL GROUP BY ALL",
}

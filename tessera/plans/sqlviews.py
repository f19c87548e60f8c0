"""SQL text of the derived views, for oracle queries run by DuckDB on the raw
tables.  Kept next to the registry so both sides describe the same rows."""

SALES_CTE = """
sales AS (
  SELECT o.o_custkey AS customer_id,
         l.l_partkey AS product_id,
         CAST(l.l_shipdate AS DATE) AS sale_date,
         CAST(l.l_quantity AS DECIMAL(10,2)) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(CAST(l.l_quantity AS DECIMAL(10,2)) * CAST(p.p_retailprice AS DECIMAL(10,2)) AS DECIMAL(12,2)) AS total_amount,
         r.r_name AS region
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

RISK_CTE = """
risk AS (
  SELECT o.o_orderkey AS deal,
         p.p_brand AS book,
         c.c_name AS counterparty,
         c.c_mktsegment AS desk,
         l.l_returnflag AS measure,
         p.p_size AS measure_point,
         p.p_type AS risk_factor,
         o.o_orderpriority AS scenario,
         n.n_name AS currency,
         CAST(l.l_shipdate AS DATE) AS valuation_date,
         CASE WHEN l.l_linestatus = 'O' THEN -CAST(l.l_extendedprice AS DECIMAL(14,2))
              ELSE CAST(l.l_extendedprice AS DECIMAL(14,2)) END AS value
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def _with(cte: str, body: str) -> str:
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return "WITH " + cte + ",\n" + b[5:]
    return "WITH " + cte + "\n" + b


def with_sales(body: str) -> str:
    return _with(SALES_CTE, body)


def with_risk(body: str) -> str:
    return _with(RISK_CTE, body)

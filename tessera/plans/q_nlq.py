"""Registered prompt/template queries over the data-derived prompt workload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.operators import relational as R
from tessera.operators.phrase_table import match_phrase_table
from tessera.plans import nl_answer as N
from tessera.plans.compiler import answer_requests
from tessera.plans.q_text import hash_vectors_sql
from tessera.plans.registry import portable, query
from tessera.plans.sqlviews import SALES_CTE, with_sales
from tessera.session import spread
from tessera.sources.writes import write_staged
from tessera.tables import load

ASOF = dt.date(2001, 12, 31)

# ---------------------------------------------------------------------------
# SQL building blocks for the oracle
# ---------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]::VARCHAR[]"


WORKLOAD_SQL = """
wl AS (
  SELECT o_orderkey AS prompt_id,
    CASE o_orderkey % 7
      WHEN 0 THEN 'top ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ' customers by revenue in ' || CAST(year(o_orderdate) AS VARCHAR)
      WHEN 1 THEN 'show total sales for each region in ' || CAST(year(o_orderdate) AS VARCHAR)
      WHEN 2 THEN 'top ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ' products by revenue between '
                  || strftime(o_orderdate, '%Y-%m-%d') || ' and ' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d')
      WHEN 3 THEN 'total revenue on ' || strftime(o_orderdate, '%Y-%m-%d')
      WHEN 4 THEN 'sales for {region=' || ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][o_orderkey % 5 + 1]
                  || '} {year = ' || CAST(year(o_orderdate) AS VARCHAR) || '} {min_revenue='
                  || CAST(o_orderkey % 50 * 100 AS VARCHAR) || '.5}'
      WHEN 5 THEN 'list all sales for customer ' || CAST(o_custkey AS VARCHAR)
      ELSE CASE o_orderkey % 2
        WHEN 0 THEN 'show all by sale_id ' || CAST(o_orderkey AS VARCHAR) || ' and customer_id ' || CAST(o_custkey AS VARCHAR)
                    || ' , sale_date ' || strftime(o_orderdate, '%Y-%m-%d')
        ELSE 'show sales by region for last year' END END AS prompt
  FROM orders
  UNION ALL
  SELECT -(conv_id * 1000 + turn + 1), text FROM conversations WHERE role = 'user'
)"""


def _templates_sql() -> str:
    rows = []
    for i, t in enumerate(N.TEMPLATES):
        has_default = "true" if "limit" in t["defaults"] else "false"
        rows.append(f"({i}, {_q(t['name'])}, {_q(t['intent_text'])}, {_list(t['required'])}, {has_default})")
    return ("tpl AS (SELECT * FROM (VALUES " + ", ".join(rows)
            + ") t(template_id, name, intent_text, required, has_default))")


def _brace_sql() -> str:
    rows = [f"({i}, {_q(t['name'])}, {_q(t['intent_text'])}, {_q(t['sql'])})" for i, t in enumerate(N.BRACE_TEMPLATES)]
    return "btpl AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(template_id, name, intent_text, sql_template))"


def _mappings_sql() -> str:
    rows = [f"({i}, {_q(intent)}, {_q(ep)}, {_list(ps)})" for i, intent, ep, ps in N.API_MAPPINGS]
    return "amap AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(id, intent, endpoint, expected_params))"


def _hv(source: str, id_col: str, text_col: str, name: str) -> str:
    sql = hash_vectors_sql(source, id_col, text_col)
    return sql.replace("tok AS", f"{name}_tok AS").replace("FROM tok", f"FROM {name}_tok") \
              .replace("cnt AS", f"{name}_cnt AS").replace("FROM cnt", f"FROM {name}_cnt") \
              .replace("hv AS", f"{name} AS")


def _dense_topk(items: str, item_id: str, item_text: str, k: int) -> str:
    """Top-k items of a tiny item table for every workload prompt (all pairs
    scored, zero similarity included)."""
    return ",\n".join([
        WORKLOAD_SQL,
        _hv("wl", "prompt_id", "prompt", "qv"),
        _hv(items, item_id, item_text, "iv"),
        "qv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM qv GROUP BY id)",
        "iv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM iv GROUP BY id)",
        "dots AS (SELECT a.id AS query_id, b.id AS item_id, SUM(a.weight * b.weight) AS dp "
        "FROM qv a JOIN iv b ON a.bucket = b.bucket GROUP BY ALL)",
        "sims AS (SELECT qn.id AS query_id, inn.id AS item_id, "
        "ROUND(COALESCE(d.dp, 0) / (qn.nrm * inn.nrm + 1e-12), 9) AS sim "
        "FROM qv_n qn CROSS JOIN iv_n inn LEFT JOIN dots d ON d.query_id = qn.id AND d.item_id = inn.id)",
        f"topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) "
        f"AS rank FROM sims) WHERE rank <= {k})",
    ])


PARAMS_SQL = r"""
px AS (
  SELECT prompt_id, prompt,
    COALESCE(NULLIF(regexp_extract(lower(prompt), '\b(20\d{2})\b', 1), ''),
             CASE WHEN contains(lower(prompt), 'last year') THEN '2000'
                  WHEN contains(lower(prompt), 'this year') THEN '2001' END) AS year,
    TRY_CAST(NULLIF(regexp_extract(lower(prompt), '\btop\s+(\d+)', 1), '') AS INTEGER) AS limit_n,
    NULLIF(regexp_extract(lower(prompt), '(?:between|from)\s+(20\d{2}-\d{2}-\d{2})\s+(?:and|to)\s+(20\d{2}-\d{2}-\d{2})', 1), '') AS start_date,
    NULLIF(regexp_extract(lower(prompt), '(?:between|from)\s+(20\d{2}-\d{2}-\d{2})\s+(?:and|to)\s+(20\d{2}-\d{2}-\d{2})', 2), '') AS end_date,
    NULLIF(regexp_extract(lower(prompt), '\b(20\d{2}-\d{2}-\d{2})\b', 1), '') AS date
  FROM wl
)"""

NAMED_SQL = r"""
ex AS (SELECT prompt_id, regexp_extract_all(prompt, '\{(.*?)=(.*?)\}', 1) AS ns,
              regexp_extract_all(prompt, '\{(.*?)=(.*?)\}', 2) AS vs FROM wl),
u AS (SELECT prompt_id, unnest(ns) AS n, unnest(vs) AS v, unnest(generate_series(1, len(ns))) AS pos
      FROM ex WHERE len(ns) > 0),
np AS (SELECT prompt_id, name, value,
              CASE WHEN regexp_full_match(value, '[0-9]+') THEN 'int'
                   WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS kind
       FROM (SELECT prompt_id, trim(n) AS name, trim(v) AS value,
                    row_number() OVER (PARTITION BY prompt_id, trim(n) ORDER BY pos DESC) AS rk FROM u) WHERE rk = 1)"""


# ---------------------------------------------------------------------------
# Registered queries
# ---------------------------------------------------------------------------


def _workload(spark, d):
    return N.prompt_workload(spark, d)


@query("prompt_params", "WITH " + WORKLOAD_SQL + "," + PARAMS_SQL + """
SELECT prompt_id, year, limit_n, start_date, end_date, date FROM px""")
def q_prompt_params(spark, d):
    w = _workload(spark, d).withColumn("p", P.extract_params("prompt", ASOF.year))
    g = lambda k: F.try_element_at("p", F.lit(k))
    return w.select("prompt_id", g("year").alias("year"), g("limit").cast("int").alias("limit_n"),
                    g("start_date").alias("start_date"), g("end_date").alias("end_date"), g("date").alias("date"))


@query("named_params", "WITH " + WORKLOAD_SQL + "," + NAMED_SQL + """
SELECT prompt_id, name, value, kind FROM np""")
def q_named_params(spark, d):
    w = _workload(spark, d)
    return w.select("prompt_id", F.explode(P.named_param_entries("prompt")).alias("e")) \
            .select("prompt_id", "e.name", "e.value", "e.kind")


@query("template_bind", "WITH " + _brace_sql() + ",\n" + _dense_topk("btpl", "template_id", "intent_text", 1)
       + ",\n" + NAMED_SQL + r""",
names AS (SELECT prompt_id, list(lower(name)) AS keys FROM np GROUP BY prompt_id)
SELECT t.query_id AS prompt_id, b.name,
       regexp_replace(b.sql_template, '\{(.*?)\}', ':\1', 'g') AS bound_sql,
       array_to_string(list_filter(regexp_extract_all(b.sql_template, '\{(.*?)\}', 1),
                                   lambda p: NOT list_contains(nm.keys, lower(p))), ',') AS missing
FROM topk t JOIN btpl b ON b.template_id = t.item_id JOIN names nm ON nm.prompt_id = t.query_id""")
def q_template_bind(spark, d):
    """Prompts carrying ``{name=value}`` parameters, bound to their best
    ``{param}`` template."""
    w = _workload(spark, d).withColumn("np", P.named_params("prompt")).where(F.size("np") > 0)
    tpl = N.brace_template_table(spark)
    best = N.best_template(w.select("prompt_id", "prompt"), tpl)
    j = (best.join(w.select("prompt_id", "np"), "prompt_id")
             .join(F.broadcast(tpl.drop("embedding")), "template_id")
             .withColumn("b", P.bind_template("sql_template", F.col("np"))))
    return j.select("prompt_id", "name", F.col("b.sql").alias("bound_sql"),
                    F.array_join("b.missing", ",").alias("missing"))


_NAMED_WORKLOAD_SQL = WORKLOAD_SQL.replace("wl AS", "wl0 AS") + r""",
wl1 AS (
  SELECT prompt_id, prompt FROM wl0
  UNION ALL SELECT -o_orderkey - 1000000000000,
    'customers by total revenue {year=' || CAST(year(o_orderdate) AS VARCHAR) || '} {limit=' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '}'
  FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT conv_id * 1000 + turn + 1 + 1000000000000, text || ' {year=1998} {limit=2}' FROM conversations WHERE role = 'user'),
wl AS (SELECT prompt_id, prompt AS full_prompt, regexp_replace(prompt, '\{(.*?)=(.*?)\}', '\1', 'g') AS prompt FROM wl1
       WHERE len(regexp_extract_all(prompt, '\{(.*?)=(.*?)\}', 1)) > 0)"""

_NAMED_ANSWER_SQL = with_sales("""
WITH """ + _brace_sql() + ",\n" + _dense_topk("btpl", "template_id", "intent_text", 3).replace(WORKLOAD_SQL, _NAMED_WORKLOAD_SQL)
                               + ",\n" + NAMED_SQL.replace("prompt,", "full_prompt,") + r""",
vals AS (
  SELECT prompt_id, list(lower(name)) AS keys, max(CASE WHEN name = 'region' THEN value END) AS region,
         TRY_CAST(max(CASE WHEN name = 'year' THEN value END) AS INTEGER) AS year,
         TRY_CAST(max(CASE WHEN name = 'min_revenue' THEN value END) AS DOUBLE) AS least,
         TRY_CAST(max(CASE WHEN name = 'limit' THEN value END) AS INTEGER) AS lim
  FROM np GROUP BY prompt_id),
near AS (SELECT t.query_id AS prompt_id, max(t.sim) >= 0.52 AS matched, string_agg(b.name, ',' ORDER BY t.rank) AS suggestions
         FROM topk t JOIN btpl b ON b.template_id = t.item_id GROUP BY 1),
q AS (
  SELECT v.*, b.name AS template, n.matched, n.suggestions,
         list_filter(regexp_extract_all(b.sql_template, '\{(.*?)\}', 1), lambda p: NOT list_contains(v.keys, lower(p)))[1] AS missing
  FROM vals v JOIN topk t ON t.query_id = v.prompt_id AND t.rank = 1 JOIN btpl b ON b.template_id = t.item_id JOIN near n ON n.prompt_id = v.prompt_id),
cust AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rev DESC, customer_id) AS rk FROM (
  SELECT year(sale_date) AS year, customer_id, SUM(total_amount) AS rev FROM sales GROUP BY ALL))
SELECT prompt_id, template, 'ok' AS status,
       (SELECT count(*) FROM sales s WHERE s.region = q.region AND year(s.sale_date) = q.year AND CAST(s.total_amount AS DOUBLE) >= q.least) AS n_rows,
       (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM sales s WHERE s.region = q.region AND year(s.sale_date) = q.year AND CAST(s.total_amount AS DOUBLE) >= q.least) AS revenue,
       NULL::VARCHAR AS suggestions
FROM q WHERE matched AND missing IS NULL AND template = 'sales_by_region_year_min'
UNION ALL
SELECT prompt_id, template, 'ok', count(rk), CAST(SUM(rev) AS DOUBLE), NULL FROM q LEFT JOIN cust ON cust.year = q.year AND cust.rk <= q.lim
WHERE matched AND missing IS NULL AND template = 'top_customers' GROUP BY ALL
UNION ALL
SELECT prompt_id, template, 'missing: ' || missing, NULL, NULL, NULL FROM q WHERE matched AND missing IS NOT NULL
UNION ALL
SELECT prompt_id, NULL, 'no match', NULL, NULL, suggestions FROM q WHERE NOT matched""")


@query("nl_named", _NAMED_ANSWER_SQL)
def q_nl_named(spark, d):
    """Every ``{name=value}`` prompt answered from its bound template, or refused
    with suggestions."""
    return N.answer_named(spark, N.named_workload(spark, d), d)


@query("fill_defaults", "WITH " + _templates_sql() + ",\n" + _dense_topk("tpl", "template_id", "intent_text", 1)
       + ",\n" + PARAMS_SQL + """,
f AS (
  SELECT t.query_id AS prompt_id, tp.name, tp.required, px.year, px.start_date, px.end_date, px.date,
         COALESCE(CAST(px.limit_n AS VARCHAR), CASE WHEN tp.has_default THEN '10' END) AS lim
  FROM topk t JOIN tpl tp ON tp.template_id = t.item_id JOIN px ON px.prompt_id = t.query_id),
g AS (
  SELECT prompt_id, name,
         array_to_string(list_sort(list_filter(['date=' || date, 'end_date=' || end_date, 'limit=' || lim,
                                                'start_date=' || start_date, 'year=' || year], lambda x: x IS NOT NULL)), ';') AS params,
         array_to_string(list_filter(required, lambda r:
              (r = 'year' AND year IS NULL) OR (r = 'start_date' AND start_date IS NULL)
              OR (r = 'end_date' AND end_date IS NULL) OR (r = 'date' AND date IS NULL)), ',') AS missing
  FROM f)
SELECT prompt_id, name, params, missing, missing = '' AS ok FROM g""")
def q_fill_defaults(spark, d):
    w = _workload(spark, d)
    tpl = N.template_table(spark)
    best = N.best_template(w, tpl)
    j = (best.join(w.withColumn("p", P.extract_params("prompt", ASOF.year)), "prompt_id")
             .join(F.broadcast(tpl.drop("embedding")), "template_id")
             .withColumn("f", P.fill_defaults(F.col("p"), F.col("defaults"), F.col("required"))))
    kv = F.array_join(F.array_sort(F.transform(F.map_entries("f.params"),
                                               lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return j.select("prompt_id", "name", kv.alias("params"), F.array_join("f.missing", ",").alias("missing"),
                    F.col("f.ok").alias("ok"))


@query("match_suggest", "WITH " + _templates_sql() + ",\n" + _dense_topk("tpl", "template_id", "intent_text", 3) + """
SELECT t.query_id AS prompt_id, CAST(t.rank AS INTEGER) AS rank, tp.name, t.sim AS score,
       MAX(t.sim) OVER (PARTITION BY t.query_id) >= 0.52 AS matched
FROM topk t JOIN tpl tp ON tp.template_id = t.item_id""")
def q_match_suggest(spark, d):
    """Best template when it clears the threshold, else three suggestions."""
    w = _workload(spark, d)
    tpl = N.template_table(spark)
    m = N.match_templates(w, tpl, 3)
    return (m.join(F.broadcast(tpl.select(F.col("template_id").alias("item_id"), "name")), "item_id")
             .select(F.col("query_id").alias("prompt_id"), F.col("rank"), "name", "score", "matched"))


_RERANK_SQL = "WITH " + _mappings_sql() + ",\n" + _dense_topk("amap", "id", "intent", 3) + """,
rr AS (
  SELECT t.query_id AS prompt_id, a.endpoint, t.sim AS score, t.rank,
         len(list_filter(a.expected_params, lambda p: contains(lower(w.prompt), lower(p)))) AS hits
  FROM topk t JOIN amap a ON a.id = t.item_id JOIN wl w ON w.prompt_id = t.query_id),
chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY hits DESC, rank) AS new_rank FROM rr)
  WHERE new_rank = 1)"""


@query("rerank_params", _RERANK_SQL + """
SELECT prompt_id, endpoint, CAST(hits AS INTEGER) AS hits, score, CAST(rank AS INTEGER) AS first_rank FROM chosen""")
def q_rerank(spark, d):
    """Top-3 API mappings by similarity, re-ranked by parameter mentions."""
    w = _workload(spark, d)
    r = N.rerank(w, N.api_mapping_table(spark)).where(F.col("new_rank") == 1)
    return r.select(F.col("query_id").alias("prompt_id"), "endpoint", F.col("hits").cast("int").alias("hits"),
                    "score", F.col("rank").cast("int").alias("first_rank"))


@query("endpoint_lookup", _RERANK_SQL + """,
nq AS (SELECT * FROM (VALUES """ + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in N.NAMED_QUERIES) + """) t(endpoint_name, sql_text))
SELECT c.prompt_id, c.endpoint, CASE WHEN nq.sql_text IS NULL THEN 'missing' ELSE 'ok' END AS status, nq.sql_text
FROM chosen c LEFT JOIN nq ON nq.endpoint_name = c.endpoint""")
def q_endpoint_lookup(spark, d):
    """Chosen endpoint of every prompt looked up in the named-query table;
    an unknown endpoint yields an error row."""
    w = _workload(spark, d)
    r = N.rerank(w, N.api_mapping_table(spark)).where(F.col("new_rank") == 1)
    nq = F.broadcast(N.named_query_table(spark))
    j = r.join(nq, r.endpoint == nq.endpoint_name, "left")
    return j.select(F.col("query_id").alias("prompt_id"), "endpoint",
                    F.when(F.col("sql_text").isNull(), "missing").otherwise("ok").alias("status"), "sql_text")


@query("phrase_owner", r"""
WITH p AS (SELECT doc_id, regexp_extract(lower(text), '^[^ ]+ [^ ]+ [^ ]+ [^ ]+', 0) AS phrase FROM documents)
SELECT d.doc_id, MIN(p.doc_id) AS owner
FROM documents d LEFT JOIN p ON p.phrase <> '' AND contains(lower(d.text), p.phrase) GROUP BY d.doc_id""")
def q_phrase_owner(spark, d):
    """The first document whose opening four words stand anywhere in the text: a
    phrase table that grows with the documents."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    opening = docs.select(F.col("doc_id").alias("owner"),
                          F.regexp_extract(F.lower("text"), "^[^ ]+ [^ ]+ [^ ]+ [^ ]+", 0).alias("phrase"))
    return match_phrase_table(spread(docs), "text", opening.where("phrase <> ''"), "phrase", "owner", ["owner"]) \
        .select("doc_id", "owner")


@query("intent_contains", "WITH " + WORKLOAD_SQL + """,
it AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_q(p)}, {_q(s)})" for i, (p, s) in enumerate(N.INTENTS)) + """) t(ord, phrase, sql)),
m AS (SELECT w.prompt_id, arg_min(it.phrase, it.ord) AS phrase, arg_min(it.sql, it.ord) AS sql
      FROM wl w JOIN it ON contains(lower(w.prompt), it.phrase) GROUP BY w.prompt_id)
SELECT w.prompt_id, m.phrase, m.sql FROM wl w LEFT JOIN m ON m.prompt_id = w.prompt_id""")
def q_intent_contains(spark, d):
    """First declared intent phrase contained in each prompt (null when none)."""
    w = _workload(spark, d)
    m = R.match_phrases(w, "prompt", N.intent_table(spark), "phrase", "ord", ["phrase", "sql"])
    return m.select("prompt_id", "phrase", "sql")


@query("nl_answer", with_sales("""
SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue FROM sales
WHERE sale_date >= DATE '2000-01-01' AND sale_date < DATE '2001-01-01'
GROUP BY customer_id ORDER BY SUM(total_amount) DESC, customer_id LIMIT 3"""))
def q_nl_answer(spark, d):
    """Flagship: "top 3 customers by revenue in 2000" answered end to end."""
    return N.flagship(spark, d)


@query("named_query", with_sales("""
SELECT customer_id, product_id, CAST(sale_date AS VARCHAR) AS sale_date, CAST(quantity AS DOUBLE) AS quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount, region
FROM sales WHERE customer_id = 1157 AND sale_date = DATE '1997-07-25'"""))
def q_named_query(spark, d):
    """Endpoint ``customer_sales_july`` with bound parameters."""
    return portable(N.run_named(spark, d, "customer_sales_july", {"customer_id": 1157, "sale_date": "1997-07-25"}))


_BATCH_SQL = ("WITH " + _templates_sql() + ",\n" + _dense_topk("tpl", "template_id", "intent_text", 1) + ",\n"
              + PARAMS_SQL + ",\n" + SALES_CTE + """,
m AS (SELECT t.query_id AS prompt_id, tp.name, tp.required, tp.has_default, t.sim >= 0.52 AS matched
      FROM topk t JOIN tpl tp ON tp.template_id = t.item_id),
pp AS (
  SELECT m.prompt_id, m.name, TRY_CAST(px.year AS INTEGER) AS year,
         COALESCE(px.limit_n, CASE WHEN m.has_default THEN 10 END) AS lim,
         TRY_CAST(px.start_date AS DATE) AS d0, TRY_CAST(px.end_date AS DATE) AS d1, TRY_CAST(px.date AS DATE) AS day
  FROM m JOIN px ON px.prompt_id = m.prompt_id
  WHERE m.matched AND len(list_filter(m.required, lambda r:
        (r = 'year' AND px.year IS NULL) OR (r = 'start_date' AND px.start_date IS NULL)
        OR (r = 'end_date' AND px.end_date IS NULL) OR (r = 'date' AND px.date IS NULL))) = 0),
r0 AS (SELECT year(sale_date) AS year, customer_id, SUM(total_amount) AS rev FROM sales GROUP BY ALL),
a0 AS (SELECT pp.prompt_id, pp.name AS template, CAST(r.customer_id AS VARCHAR) AS answer_key,
              CAST(r.rev AS DOUBLE) AS total_revenue, CAST(r.rank AS INTEGER) AS rank
       FROM pp JOIN (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rev DESC, customer_id) AS rank FROM r0) r
         ON r.year = pp.year
       WHERE pp.name = 'top_customers_by_revenue_year' AND r.rank <= pp.lim),
r1 AS (SELECT year(sale_date) AS year, region, SUM(total_amount) AS rev FROM sales GROUP BY ALL),
a1 AS (SELECT pp.prompt_id, pp.name, r.region, CAST(r.rev AS DOUBLE), CAST(r.rank AS INTEGER)
       FROM pp JOIN (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rev DESC, region) AS rank FROM r1) r
         ON r.year = pp.year
       WHERE pp.name = 'sales_by_region_year'),
rg AS (SELECT DISTINCT d0, d1 FROM pp WHERE name = 'product_sales_between_dates' AND d0 IS NOT NULL AND d1 IS NOT NULL),
r2 AS (SELECT rg.d0, rg.d1, s.product_id, SUM(s.total_amount) AS rev
       FROM rg JOIN sales s ON s.sale_date BETWEEN rg.d0 AND rg.d1 GROUP BY ALL),
a2 AS (SELECT pp.prompt_id, pp.name, CAST(r.product_id AS VARCHAR), CAST(r.rev AS DOUBLE), CAST(r.rank AS INTEGER)
       FROM pp JOIN (SELECT *, row_number() OVER (PARTITION BY d0, d1 ORDER BY rev DESC, product_id) AS rank FROM r2) r
         ON r.d0 = pp.d0 AND r.d1 = pp.d1
       WHERE pp.name = 'product_sales_between_dates' AND r.rank <= pp.lim),
a3 AS (SELECT pp.prompt_id, pp.name, strftime(s.sale_date, '%Y-%m-%d'), CAST(SUM(s.total_amount) AS DOUBLE), 1
       FROM pp JOIN sales s ON s.sale_date = pp.day WHERE pp.name = 'daily_sales_on_date' GROUP BY ALL)
SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3""")


@query("nl_answer_batch", _BATCH_SQL)
def q_nl_answer_batch(spark, d):
    """Every prompt of the workload answered through its matched template,
    all at once (parameters as join keys, distinct requests answered once)."""
    return N.answer_batch(spark, N.prompt_workload(spark, d), d, ASOF)


@query("nl_compiled", _BATCH_SQL)
def q_nl_compiled(spark, d):
    """Every prompt of the workload answered through its matched template as the
    compiler reads it from the template table: no plan is written for any one of
    them."""
    templates = N.template_table(spark)
    found = N.resolved_prompts(spark, N.prompt_workload(spark, d), ASOF).where(F.col("matched") & F.col("ok"))
    found = found.select("prompt_id", F.col("name").alias("template"), "params")
    requests = spark.read.schema(found.schema).parquet(write_staged(found, spark, "compiled-requests"))
    rows = answer_requests(requests, templates.select("name", F.col("sql_template").alias("sql")), {"sales": R.sales_view(spark, d)})
    return rows.select("prompt_id", "template", F.col("answer")[0].alias("answer_key"), F.col("answer")[1].cast("double").alias("total_revenue"),
                       F.coalesce("rank", F.lit(1)).alias("rank"))


#: a template that only a row of the template table knows
ADDED = [("units_by_region_on_date",
          "SELECT region, SUM(quantity) AS units, COUNT(DISTINCT product_id) AS products FROM sales "
          "WHERE sale_date = to_date({date}, 'yyyy-MM-dd') AND quantity >= 10 GROUP BY region ORDER BY units DESC, region LIMIT 3")]


@query("nl_added", "WITH " + WORKLOAD_SQL + "," + PARAMS_SQL + ",\n" + SALES_CTE + """,
u AS (SELECT sale_date, region, SUM(quantity) AS units, COUNT(DISTINCT product_id) AS products FROM sales WHERE quantity >= 10 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY sale_date ORDER BY units DESC, region) AS rank FROM u)
SELECT px.prompt_id, CAST(k.rank AS INTEGER) AS rank, k.region, CAST(k.units AS DOUBLE) AS units, k.products
FROM px JOIN k ON k.sale_date = TRY_CAST(px.date AS DATE) WHERE k.rank <= 3""")
def q_nl_added(spark, d):
    """Every prompt with a date answered by a template added as a row."""
    asked = _workload(spark, d).select("prompt_id", P.extract_params("prompt", ASOF.year).alias("params")) \
        .where(F.try_element_at("params", F.lit("date")).isNotNull()).withColumn("template", F.lit(ADDED[0][0]))
    requests = spark.read.schema(asked.schema).parquet(write_staged(asked, spark, "added-requests"))
    templates = spark.createDataFrame(ADDED, "name string, sql string")
    rows = answer_requests(requests, templates, {"sales": R.sales_view(spark, d)})
    return rows.select("prompt_id", "rank", F.col("answer")[0].alias("region"), F.col("answer")[1].cast("double").alias("units"),
                       F.col("answer")[2].cast("long").alias("products"))

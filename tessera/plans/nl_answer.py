"""Prompt → template → parameters → bound SQL → rows.

Templates, intents, API mappings and named queries are small configuration
tables built in code (``createDataFrame``).  Prompts are a table too: the
matching, parameter extraction, defaults and binding of a whole prompt table
run as one Spark job; executing a bound statement is one ``spark.sql(sql,
args=…)`` per distinct request (values are bound, never pasted).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import params as P
from tessera.functions import vectors as V
from tessera.operators import relational as R
from tessera.operators import search as SR
from tessera.session import spread
from tessera.sources.writes import write_staged
from tessera.tables import load

# Threshold for the hashed bag-of-words embedder (the 0.52 of the original
# belongs to a sentence-transformer model; thresholds are per embedder).
HASH_MATCH_THRESHOLD = 0.52
DEFAULT_LIMIT = 10

# The parametrised query templates (intent text, Spark SQL with
# named parameters, required / optional parameters and defaults).
TEMPLATES = [
    {
        "name": "top_customers_by_revenue_year",
        "intent_text": "Get the top N customers by total revenue in a given year",
        "sql": "SELECT customer_id, SUM(total_amount) AS total_revenue FROM sales "
               "WHERE sale_date >= make_date(CAST(:year AS INT), 1, 1) "
               "AND sale_date < make_date(CAST(:year AS INT) + 1, 1, 1) "
               "GROUP BY customer_id ORDER BY total_revenue DESC, customer_id LIMIT :limit",
        "required": ["year"], "optional": ["limit"], "defaults": {"limit": str(DEFAULT_LIMIT)},
    },
    {
        "name": "sales_by_region_year",
        "intent_text": "Show total sales for each region in a given year",
        "sql": "SELECT region, SUM(total_amount) AS total_revenue FROM sales "
               "WHERE sale_date >= make_date(CAST(:year AS INT), 1, 1) "
               "AND sale_date < make_date(CAST(:year AS INT) + 1, 1, 1) "
               "GROUP BY region ORDER BY total_revenue DESC",
        "required": ["year"], "optional": [], "defaults": {},
    },
    {
        "name": "product_sales_between_dates",
        "intent_text": "Show top products by revenue between a start and end date",
        "sql": "SELECT product_id, SUM(total_amount) AS total_revenue FROM sales "
               "WHERE sale_date BETWEEN to_date(:start_date, 'yyyy-MM-dd') AND to_date(:end_date, 'yyyy-MM-dd') "
               "GROUP BY product_id ORDER BY total_revenue DESC, product_id LIMIT :limit",
        "required": ["start_date", "end_date"], "optional": ["limit"],
        "defaults": {"limit": str(DEFAULT_LIMIT)},
    },
    {
        "name": "daily_sales_on_date",
        "intent_text": "Show total revenue on a specific date",
        "sql": "SELECT sale_date, SUM(total_amount) AS total_revenue FROM sales "
               "WHERE sale_date = to_date(:date, 'yyyy-MM-dd') GROUP BY sale_date",
        "required": ["date"], "optional": [], "defaults": {},
    },
]

# Templates with {param} placeholders (bound by name).
BRACE_TEMPLATES = [
    {
        "name": "sales_by_region_year_min",
        "intent_text": "Get sales for a specific region and year with minimum revenue",
        "sql": "SELECT * FROM sales WHERE region = {region} AND date_format(sale_date, 'yyyy') = {year} "
               "AND total_amount >= {min_revenue}",
    },
    {
        "name": "top_customers",
        "intent_text": "Top N customers by total revenue in a given year",
        "sql": "SELECT customer_id, SUM(total_amount) AS total_revenue FROM sales "
               "WHERE date_format(sale_date, 'yyyy') = {year} GROUP BY customer_id "
               "ORDER BY total_revenue DESC, customer_id LIMIT {limit}",
    },
]

# Substring intents, first declared wins.
INTENTS = [
    ("list all employees", "SELECT * FROM customer"),
    ("list all sales", "SELECT * FROM sales"),
    ("top 5 sales by amount", "SELECT * FROM sales ORDER BY total_amount DESC LIMIT 5"),
    ("employee count", "SELECT COUNT(*) AS employee_count FROM customer"),
]

# API intent mappings (intent, endpoint, expected parameters).
API_MAPPINGS = [
    (1, "show all by customer id and specific date", "customer_sales", ["customer_id", "sale_date"]),
    (2, "Show all customer sales", "all_customer_sales", []),
    (3, "Show all products", "all_products", []),
    (4, "get sales by customer id , specific date and sale id", "customer_sales_by_id",
     ["customer_id", "sale_date", "sale_id"]),
]

# Named parametrised queries by endpoint.  The sales star has no
# sale id, so the last one keys on the product instead.
NAMED_QUERIES = [
    ("customer_sales_july",
     "SELECT * FROM sales WHERE customer_id = {customer_id} AND sale_date = to_date({sale_date}, 'yyyy-MM-dd')"),
    ("all_customer_sales", "SELECT * FROM sales"),
    ("all_products", "SELECT * FROM products"),
    ("customer_sales_by_id",
     "SELECT * FROM sales WHERE customer_id = {customer_id} AND sale_date = to_date({sale_date}, 'yyyy-MM-dd') "
     "AND product_id = {product_id}"),
]

# TPC-H region names, used to phrase generated prompts.
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


# ---------------------------------------------------------------------------
# Configuration tables
# ---------------------------------------------------------------------------


def template_table(spark: SparkSession) -> DataFrame:
    schema = ("template_id int, name string, intent_text string, sql_template string, "
              "required array<string>, optional array<string>, defaults map<string,string>")
    rows = [(i, t["name"], t["intent_text"], t["sql"], t["required"], t["optional"], t["defaults"])
            for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, schema).withColumn("embedding", V.hash_embed("intent_text"))


def brace_template_table(spark: SparkSession) -> DataFrame:
    rows = [(i, t["name"], t["intent_text"], t["sql"]) for i, t in enumerate(BRACE_TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, name string, intent_text string, sql_template string") \
                .withColumn("embedding", V.hash_embed("intent_text"))


def intent_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(INTENTS)],
                                 "ord int, phrase string, sql string")


def api_mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(API_MAPPINGS, "id int, intent string, endpoint string, expected_params array<string>") \
                .withColumn("embedding", V.hash_embed("intent"))


def named_query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMED_QUERIES, "endpoint_name string, sql_text string")


# ---------------------------------------------------------------------------
# Prompt workload derived from the data
# ---------------------------------------------------------------------------


def prompt_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts phrased from every order (seven phrasings chosen by the order
    key) plus the user turns of the conversations.  ``prompt_id`` is the
    order key, or ``-(conv_id*1000+turn+1)`` for conversation turns."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    y = F.year("o_orderdate").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    day30 = F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd")
    n = (k % 9 + 1).cast("string")
    region = F.element_at(F.array(*[F.lit(r) for r in REGION_NAMES]), (k % 5 + 1).cast("int"))
    kind = k % 7
    text = (F.when(kind == 0, F.concat(F.lit("top "), n, F.lit(" customers by revenue in "), y))
             .when(kind == 1, F.concat(F.lit("show total sales for each region in "), y))
             .when(kind == 2, F.concat(F.lit("top "), n, F.lit(" products by revenue between "), day,
                                       F.lit(" and "), day30))
             .when(kind == 3, F.concat(F.lit("total revenue on "), day))
             .when(kind == 4, F.concat(F.lit("sales for {region="), region, F.lit("} {year = "), y,
                                       F.lit("} {min_revenue="), (k % 50 * 100).cast("string"), F.lit(".5"),
                                       F.lit("}")))
             .when(kind == 5, F.concat(F.lit("list all sales for customer "), F.col("o_custkey").cast("string")))
             .when(k % 2 == 0, F.concat(F.lit("show all by sale_id "), k.cast("string"), F.lit(" and customer_id "),
                                        F.col("o_custkey").cast("string"), F.lit(" , sale_date "), day))
             .otherwise(F.lit("show sales by region for last year")))
    orders_p = spread(o).select(k.alias("prompt_id"), text.alias("prompt"))
    c = load(spark, sf_dir, "conversations").where(F.col("role") == "user")
    conv_p = c.select((-(F.col("conv_id") * 1000 + F.col("turn") + 1)).alias("prompt_id"), F.col("text").alias("prompt"))
    return orders_p.unionByName(conv_p)


# ---------------------------------------------------------------------------
# Matching
# ---------------------------------------------------------------------------


def match_templates(prompts: DataFrame, templates: DataFrame, k: int = 3,
                    threshold: float = HASH_MATCH_THRESHOLD) -> DataFrame:
    """Top-``k`` templates per prompt; ``matched`` when the best similarity
    reaches the threshold, otherwise the ``k`` suggestions stand."""
    pv = prompts.select("prompt_id", V.hash_embed("prompt").alias("vec"))
    hits = SR.knn(pv, templates, k, "prompt_id", "vec", "template_id", "embedding", small_items=64, embedded=True)
    return hits.withColumn("matched", F.col("best_score") >= threshold)


def best_template(prompts: DataFrame, templates: DataFrame) -> DataFrame:
    pv = prompts.select("prompt_id", V.hash_embed("prompt").alias("vec"))
    return SR.knn(pv, templates, 1, "prompt_id", "vec", "template_id", "embedding", small_items=64, embedded=True) \
             .select(F.col("query_id").alias("prompt_id"), F.col("item_id").alias("template_id"), "score")


def rerank(prompts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Top-3 mappings by similarity, then a stable re-rank by how many of the
    expected parameter names the prompt mentions."""
    pv = prompts.select("prompt_id", "prompt", V.hash_embed("prompt").alias("vec"))
    hits = SR.knn(pv, mappings, 3, "prompt_id", "vec", "id", "embedding", small_items=64, embedded=True)
    m = F.broadcast(mappings.select(F.col("id").alias("item_id"), "endpoint", "expected_params"))
    scored = (hits.join(m, "item_id").join(pv.select(F.col("prompt_id").alias("query_id"), "prompt"), "query_id")
                  .withColumn("hits", P.param_hits("prompt", F.col("expected_params"))))
    w = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), F.col("rank"))
    return scored.withColumn("new_rank", F.row_number().over(w))


# ---------------------------------------------------------------------------
# One prompt end to end
# ---------------------------------------------------------------------------


class NoMatch(Exception):
    def __init__(self, suggestions):
        super().__init__("no template matched")
        self.suggestions = suggestions


def answer(spark: SparkSession, prompt: str, sf_dir: str, asof: dt.date | None = None,
           threshold: float = HASH_MATCH_THRESHOLD) -> DataFrame:
    """Answer one prompt over the sales star.  Raises :class:`NoMatch` with
    up to three suggestions (and their parameter names) when no template
    reaches the threshold or required parameters are missing."""
    asof = asof or dt.date.today()
    R.register_sales(spark, sf_dir)
    templates = template_table(spark)
    p = spark.createDataFrame([(0, prompt)], "prompt_id long, prompt string")
    top = match_templates(p, templates, 3, threshold)
    ex = p.select(F.col("prompt_id").alias("query_id"), P.extract_params("prompt", asof.year).alias("params"))
    plan = (top.join(F.broadcast(templates.drop("embedding")), top.item_id == templates.template_id)
               .join(ex, "query_id")
               .select("rank", "score", "matched", "name", "intent_text", "sql_template",
                       P.fill_defaults(F.col("params"), F.col("defaults"), F.col("required")).alias("f"))
               .orderBy("rank").collect())
    best = plan[0] if plan else None
    if best is None or not best["matched"] or not best["f"]["ok"]:
        raise NoMatch([(r["intent_text"], list(r["f"]["missing"])) for r in plan])
    args = {}
    for key, v in best["f"]["params"].items():
        args[key] = int(v) if key == "limit" else v
    return spark.sql(best["sql_template"], args=args)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"top 3 customers by revenue in 2000" over the sales star."""
    return answer(spark, "top 3 customers by revenue in 2000", sf_dir,
                  asof=dt.date(2001, 12, 31)).select(
        "customer_id", F.col("total_revenue").cast("double").alias("total_revenue"))


def run_named(spark: SparkSession, sf_dir: str, endpoint: str, params: dict) -> DataFrame:
    """Named parametrised query: look the endpoint up, bind ``{p}`` → ``:p``,
    run with bound arguments.  Unknown endpoint or missing parameter raise."""
    R.register_sales(spark, sf_dir)
    load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                                       F.col("p_type").alias("category")).createOrReplaceTempView("products")
    q = named_query_table(spark).where(F.col("endpoint_name") == endpoint)
    pm = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))]) if params \
        else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    rows = q.select(P.bind_template("sql_text", pm).alias("b")).limit(1).collect()
    if not rows:
        raise KeyError(f"No SQL found for endpoint '{endpoint}'")
    b = rows[0]["b"]
    if b["missing"]:
        raise KeyError(f"Missing parameter: {b['missing'][0]}")
    return spark.sql(b["sql"], args={k.lower(): v for k, v in params.items()})


# ---------------------------------------------------------------------------
# A whole table of prompts, answered relationally
# ---------------------------------------------------------------------------

ANSWER_SCHEMA = "prompt_id long, template string, answer_key string, total_revenue double, rank int"


def resolved_prompts(spark: SparkSession, prompts: DataFrame, asof: dt.date,
                     threshold: float = HASH_MATCH_THRESHOLD) -> DataFrame:
    """Best template, match flag and filled parameters of every prompt:
    ``prompt_id, template_id, name, matched, ok, params``."""
    templates = template_table(spark)
    best = match_templates(prompts, templates, 1, threshold).select(
        F.col("query_id").alias("prompt_id"), F.col("item_id").cast("int").alias("template_id"), "matched")
    tpl = F.broadcast(templates.select("template_id", "name", "required", "defaults"))
    p = prompts.select("prompt_id", P.extract_params("prompt", asof.year).alias("params"))
    j = best.join(p, "prompt_id").join(tpl, "template_id")
    f = P.fill_defaults(F.col("params"), F.col("defaults"), F.col("required"))
    return j.select("prompt_id", "template_id", "name", "matched", f["ok"].alias("ok"), f["params"].alias("params"))


def answer_batch(spark: SparkSession, prompts: DataFrame, sf_dir: str, asof: dt.date,
                 threshold: float = HASH_MATCH_THRESHOLD) -> DataFrame:
    """Rows every matched prompt would get from its template, for the whole
    prompt table at once.

    Each template is a relational plan over the sales star with the prompt
    parameters as join keys: revenue per (year, customer) ranked per year
    (partial group limit), per (year, region), per distinct date range and
    product (each distinct range is answered once, then joined back to its
    prompts), and per day.  Prompts that match no template, or miss a
    required parameter, get no rows (their suggestions come from
    :func:`match_templates`).
    """
    r = resolved_prompts(spark, prompts, asof, threshold).where(F.col("matched") & F.col("ok"))
    g = lambda k: F.try_element_at("params", F.lit(k))
    r = r.select("prompt_id", "name", g("year").try_cast("int").alias("year"),
                 g("limit").try_cast("int").alias("lim"), F.try_to_date(g("start_date")).alias("d0"),
                 F.try_to_date(g("end_date")).alias("d1"), F.try_to_date(g("date")).alias("day"))
    # prompts are matched once: the bounds and the four template plans read the written rows
    r = spark.read.schema(r.schema).parquet(write_staged(r, spark, "resolved-prompts"))
    # the group-limit sizes must be constants: one small aggregation gives all bounds
    is0 = F.col("name") == "top_customers_by_revenue_year"
    is2 = F.col("name") == "product_sales_between_dates"
    b = r.agg(F.max(F.when(is0, F.col("lim"))).alias("l0"), F.max(F.when(is2, F.col("lim"))).alias("l2")).first()
    # one pass over the star: revenue per (year, customer), (year, region),
    # (day, product) and (day) as grouping sets; every template reads its set
    s = R.sales_view(spark, sf_dir).select("customer_id", "product_id", "region", "sale_date", "total_amount") \
         .withColumn("year", F.year("sale_date"))
    keys = ["year", "customer_id", "region", "sale_date", "product_id"]
    g = s.groupingSets([["year", "customer_id"], ["year", "region"], ["sale_date", "product_id"], ["sale_date"]],
                       *keys).agg(F.sum("total_amount").alias("rev"), F.grouping_id().alias("gid"))
    # written once to the shared checkpoint folder: the four template plans
    # read it instead of each re-running the star (their filters would
    # otherwise be pushed below the aggregate and defeat exchange reuse)
    g = g.checkpoint(eager=True)

    def gset(*cols):
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols)
        return g.where(F.col("gid") == bits).select(*cols, "rev")

    out = []

    # top customers by revenue in a year
    t0 = r.where((F.col("name") == "top_customers_by_revenue_year") & F.col("year").isNotNull()
                 & (F.col("lim") > 0))
    lim0 = b[0]
    if lim0:
        rev = gset("year", "customer_id").join(t0.select("year").distinct(), "year", "left_semi")
        top = R.rank_within(rev, ["year"], [F.col("rev").desc(), F.col("customer_id")], lim0)
        out.append(t0.join(top, "year").where(F.col("rank") <= F.col("lim")).select(
            "prompt_id", F.col("name").alias("template"), F.col("customer_id").cast("string").alias("answer_key"),
            F.col("rev").cast("double").alias("total_revenue"), "rank"))

    # total sales per region in a year
    t1 = r.where((F.col("name") == "sales_by_region_year") & F.col("year").isNotNull())
    rev1 = gset("year", "region").join(t1.select("year").distinct(), "year", "left_semi")
    w1 = Window.partitionBy("year").orderBy(F.col("rev").desc(), F.col("region"))
    out.append(t1.join(rev1.withColumn("rank", F.row_number().over(w1)), "year").select(
        "prompt_id", F.col("name").alias("template"), F.col("region").alias("answer_key"),
        F.col("rev").cast("double").alias("total_revenue"), "rank"))

    # top products between two dates: each distinct range once
    t2 = r.where((F.col("name") == "product_sales_between_dates") & F.col("d0").isNotNull()
                 & F.col("d1").isNotNull() & (F.col("lim") > 0))
    lim2 = (b[1],)
    if lim2[0]:
        ranges = t2.select("d0", "d1").distinct().where(F.col("d0") <= F.col("d1"))
        days = ranges.select("d0", "d1", F.explode(F.sequence("d0", "d1")).alias("sale_date"))
        daily = gset("sale_date", "product_id")
        per_range = (days.join(daily, "sale_date").groupBy("d0", "d1", "product_id")
                         .agg(F.sum("rev").alias("rev")))
        top2 = R.rank_within(per_range, ["d0", "d1"], [F.col("rev").desc(), F.col("product_id")], lim2[0])
        out.append(t2.join(top2, ["d0", "d1"]).where(F.col("rank") <= F.col("lim")).select(
            "prompt_id", F.col("name").alias("template"), F.col("product_id").cast("string").alias("answer_key"),
            F.col("rev").cast("double").alias("total_revenue"), "rank"))

    # total revenue on a day
    t3 = r.where((F.col("name") == "daily_sales_on_date") & F.col("day").isNotNull())
    days3 = t3.select(F.col("day").alias("sale_date")).distinct()
    rev3 = gset("sale_date").join(days3, "sale_date", "left_semi")
    out.append(t3.join(rev3, t3.day == rev3.sale_date).select(
        "prompt_id", F.col("name").alias("template"), F.date_format("sale_date", "yyyy-MM-dd").alias("answer_key"),
        F.col("rev").cast("double").alias("total_revenue"), F.lit(1).alias("rank")))

    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def named_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with ``{name=value}`` parameters: those of ``prompt_workload``,
    one for every seventh order that asks for its year's customers, and the
    user turns of the conversations with parameters that suit no intent."""
    base = prompt_workload(spark, sf_dir)
    o = load(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    k = F.col("o_orderkey")
    asked = o.select((-k - 10**12).alias("prompt_id"), F.format_string(
        "customers by total revenue {year=%d} {limit=%d}", F.year("o_orderdate"), k % 9 + 1).alias("prompt"))
    turns = load(spark, sf_dir, "conversations").where(F.col("role") == "user")
    other = turns.select((F.col("conv_id") * 1000 + F.col("turn") + 1 + 10**12).alias("prompt_id"),
                         F.concat("text", F.lit(" {year=1998} {limit=2}")).alias("prompt"))
    named = base.unionByName(asked).unionByName(other)
    return named.where(F.size(P.named_params("prompt")) > 0)


def answer_named(spark: SparkSession, prompts: DataFrame, sf_dir: str,
                 threshold: float = HASH_MATCH_THRESHOLD) -> DataFrame:
    """Prompts with ``{name=value}`` parameters, answered: the closest brace
    template is bound by name, and each different bound request runs once, as a
    join of the requests with the sales star.

    The intent is the prompt with each parameter's name in place of the pair (values say
    nothing about it).  Returns per prompt: ``prompt_id``, ``template``,
    ``status`` (``ok``, ``missing: <name>`` for the first unbound parameter, or
    ``no match`` where no template reaches ``threshold``), ``n_rows`` and
    ``revenue`` of the rows that the request selects, and ``suggestions``: for an
    unmatched prompt the closest templates, nearest first, else null.  Prompts
    without any parameter are left out."""
    templates = brace_template_table(spark)
    named = prompts.select("prompt_id", P.named_params("prompt").alias("params"), "prompt").where(F.size("params") > 0)
    tpl = F.broadcast(templates.select("template_id", "name", "sql_template"))
    intent = named.select("prompt_id", F.regexp_replace("prompt", P.NAMED_RE, "$1").alias("prompt"))
    hits = match_templates(intent, templates, 3, threshold).join(tpl, F.col("item_id") == F.col("template_id"))
    near = F.array_sort(F.collect_list(F.struct("rank", "name", "sql_template")))
    found = hits.groupBy(F.col("query_id").alias("prompt_id")).agg(F.first("matched").alias("matched"), near.alias("near"))
    value = lambda k: F.try_element_at("params", F.lit(k))
    bound = named.join(found, "prompt_id").withColumn("b", P.bind_template(F.col("near")[0]["sql_template"], F.col("params")))
    r = bound.select("prompt_id", "matched", F.when(F.col("matched"), F.col("near")[0]["name"]).alias("template"),
                     F.when(~F.col("matched"), F.array_join("near.name", ",")).alias("suggestions"),
                     F.get(F.col("b.missing"), 0).alias("missing"),
                     value("region").alias("region"), value("year").try_cast("int").alias("year"),
                     value("min_revenue").try_cast("double").alias("least"), value("limit").try_cast("int").alias("lim"))
    # prompts are matched once; all that follows reads the written rows
    r = spark.read.schema(r.schema).parquet(write_staged(r, spark, "named-requests"))
    ok = r.where("matched AND missing IS NULL")
    # the star is read once, for the years that are asked for
    s = R.sales_view(spark, sf_dir).select("region", F.year("sale_date").alias("year"), "customer_id", "total_amount") \
        .join(ok.select("year").distinct(), "year", "left_semi")
    s = spark.read.schema(s.schema).parquet(write_staged(s, spark, "named-sales"))
    # rows of a region and year from a least amount on: counted per distinct request
    ranged = ok.where("template = 'sales_by_region_year_min'")
    rows = ranged.select("region", "year", "least").distinct().join(s, ["region", "year"]) \
        .where(F.col("total_amount").cast("double") >= F.col("least")) \
        .groupBy("region", "year", "least").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_amount").cast("double").alias("revenue"))
    none = F.lit(None)
    first = ranged.join(rows, ["region", "year", "least"], "left") \
        .select("prompt_id", "template", F.lit("ok").alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "revenue", "suggestions")
    # the first customers of a year by revenue; the bound of a group limit must be a constant
    asked = ok.where("template = 'top_customers'")
    most = asked.agg(F.max("lim")).first()[0] or 0
    per = s.groupBy("year", "customer_id").agg(F.sum("total_amount").alias("rev"))
    top = R.rank_within(per, ["year"], [F.col("rev").desc(), F.col("customer_id")], most)
    total = asked.select("year", "lim").distinct().join(top, "year").where("rank <= lim") \
        .groupBy("year", "lim").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rev").cast("double").alias("revenue"))
    second = asked.join(total, ["year", "lim"], "left") \
        .select("prompt_id", "template", F.lit("ok").alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "revenue", "suggestions")
    bad = r.where("NOT matched OR missing IS NOT NULL").select(
        "prompt_id", "template", F.when(~F.col("matched"), "no match").otherwise(F.concat(F.lit("missing: "), "missing")).alias("status"),
        none.cast("long").alias("n_rows"), none.cast("double").alias("revenue"), "suggestions")
    return first.unionByName(second).unionByName(bad)

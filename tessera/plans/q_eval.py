"""Registered question-generation, prompt-batch and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import evaluate as E
from tessera.operators import search as SR
from tessera.operators.relational import union_all
from tessera.functions import vectors as V
from tessera.plans import index_build as IB
from tessera.plans import questions as Q
from tessera.plans.q_catalog import CATALOG_SCHEMA
from tessera.plans.q_search import _SPARSE_SIM, _rename_hv, chunk_vectors, user_prompts
from tessera.plans.q_text import hash_vectors_sql, smart_chunks_sql
from tessera.plans.registry import query
from tessera.plans.sqlviews import with_sales
from tessera.tables import load, register_views

_TABLES_IN = ", ".join(f"'{t}'" for t in IB.CATALOG_TABLES)

_FILLED = " UNION ALL ".join(f"SELECT '{t}' AS t FROM {t} HAVING count(*) > 0" for t in IB.CATALOG_TABLES)

COLS_SQL = f"""
tc AS (SELECT table_name, list(column_name ORDER BY ordinal_position) AS col_list
       FROM information_schema.columns WHERE table_name IN (SELECT t FROM ({_FILLED})) GROUP BY table_name)"""


def _tpl_values() -> str:
    return "tp AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{t}')" for i, t in enumerate(Q.QUESTION_TEMPLATES)) + ") t(tpl_ix, tpl))"


QUESTIONS_SQL = COLS_SQL + ", " + _tpl_values() + """,
qs AS (
  SELECT CAST((dense_rank() OVER (ORDER BY tc.table_name) - 1) * 5 + tp.tpl_ix AS BIGINT) AS question_id,
         tc.table_name,
         replace(replace(replace(tp.tpl, '{table}', tc.table_name), '{cols}', array_to_string(tc.col_list[1:4], ', ')),
                 '{first_col}', COALESCE(tc.col_list[1], '1')) AS question,
         CAST(to_json(tc.col_list) AS VARCHAR) AS column_list, tc.col_list
  FROM tc, tp)"""


@query("gen_questions", "WITH " + QUESTIONS_SQL + " SELECT question_id, table_name, question, column_list FROM qs")
def q_gen_questions(spark, d):
    """Five template questions per catalog table."""
    return Q.generate_questions(Q.table_columns(spark, d))


@query("gen_ground_sql", "WITH " + QUESTIONS_SQL + """
SELECT question_id, CASE
  WHEN contains(question, 'How many') THEN 'SELECT COUNT(*) AS CNT FROM ' || table_name
  WHEN contains(lower(question), 'top 10') THEN 'SELECT ' || array_to_string(col_list[1:4], ', ') || ' FROM ' || table_name
       || ' ORDER BY ' || col_list[1] || ' LIMIT 10'
  WHEN contains(lower(question), 'not null') THEN 'SELECT ' || array_to_string(col_list[1:4], ', ') || ' FROM ' || table_name
       || ' WHERE ' || col_list[1] || ' IS NOT NULL'
  WHEN contains(lower(question), 'grouped by') THEN 'SELECT ' || col_list[1] || ', COUNT(*) AS CNT FROM ' || table_name
       || ' GROUP BY ' || col_list[1]
  ELSE 'SELECT ' || array_to_string(col_list[1:4], ', ') || ' FROM ' || table_name END AS ground_sql
FROM qs""")
def q_gen_ground(spark, d):
    return Q.ground_sql(Q.generate_questions(Q.table_columns(spark, d))).select("question_id", "ground_sql")


PAIRS_SQL = COLS_SQL + """,
pc AS (SELECT table_name, unnest(col_list) AS col, unnest(generate_series(0, len(col_list) - 1)) AS ord FROM tc),
pr AS (
  SELECT table_name, ord, 'Show me all ' || col || ' from ' || table_name AS question,
         'SELECT ' || col || ' FROM TPCH.' || table_name AS sql_template FROM pc
  UNION ALL
  SELECT table_name, 100000, 'Show me ' || col_list[1] || ' where ' || col_list[2] || ' = ?',
         'SELECT ' || col_list[1] || ' FROM TPCH.' || table_name || ' WHERE ' || col_list[2] || ' = :1'
  FROM tc WHERE len(col_list) >= 2
  UNION ALL
  SELECT table_name, 100001, 'Count ' || col_list[1] || ' grouped by ' || col_list[2],
         'SELECT ' || col_list[2] || ', COUNT(' || col_list[1] || ') FROM TPCH.' || table_name || ' GROUP BY ' || col_list[2]
  FROM tc WHERE len(col_list) >= 2),
pairs AS (SELECT table_name, question, sql_template,
                 CAST(row_number() OVER (ORDER BY table_name, ord) AS BIGINT) AS training_id FROM pr)"""


@query("gen_pairs", "WITH " + PAIRS_SQL + " SELECT table_name, question, sql_template, training_id FROM pairs")
def q_gen_pairs(spark, d):
    return Q.generate_pairs(Q.table_columns(spark, d))


@query("catalog_filter", """
SELECT c.table_name, c.column_name, CASE WHEN p.n > 0 AND p.n = p.k THEN 'N' ELSE 'Y' END AS nullable
FROM information_schema.columns c JOIN (""" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count({c}) AS k FROM {t}"
    for t, cols in (("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
                    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")),
                    ("documents", ("doc_id", "text", "lang", "source", "n_chars")))
    for c in cols) + """) p ON p.t = c.table_name AND p.c = c.column_name
WHERE c.data_type <> 'DOUBLE' AND c.data_type NOT LIKE 'TIMESTAMP%'""")
def q_catalog_filter(spark, d):
    """Catalog columns of an allow-list of tables, floating-point and timestamp
    columns excluded, with nullability measured from the rows."""
    allowed = ("orders", "lineitem", "documents")
    cols = C.measured_columns(spark, IB.frames(spark, d, (*IB.CATALOG_TABLES, "documents")))
    return (cols.where(F.col("table_name").isin(*allowed)
                       & ~F.col("data_type").isin("DOUBLE", "TIMESTAMP", "TIMESTAMP_NTZ"))
                .select("table_name", "column_name", "nullable"))


def _synonym_sql(source: str) -> str:
    """DuckDB form of the ordered, capped cartesian expansion over ``source``
    (qid, q): variant v picks choice (v // P_j) % r_j for word j."""
    from tessera.functions.sqltext import SYNONYMS
    case = " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in SYNONYMS.items())
    return f"""
sw AS (SELECT qid, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS words FROM {source}),
so AS (SELECT qid, list_transform(words, lambda x: [x] || CASE trim(lower(x), '?,.') {case} ELSE []::VARCHAR[] END) AS opts
       FROM sw),
sr AS (SELECT qid, opts, list_transform(opts, lambda o: len(o)) AS radix FROM so),
sn AS (SELECT qid, opts, radix,
              list_transform(radix, lambda r, j: list_reduce([1] || list_slice(radix, j + 1, len(radix)),
                                                               lambda a, b: least(5, a * b))) AS suf,
              least(5, list_reduce([1] || radix, lambda a, b: least(5, a * b))) AS n FROM sr),
sv AS (SELECT qid, opts, suf, unnest(generate_series(1, n - 1)) AS v FROM sn WHERE n > 1),
syn AS (SELECT qid * 10 + v AS synonym_id, qid AS question_id,
               array_to_string(list_transform(opts, lambda o, j: o[((v // suf[j]) % len(o)) + 1]), ' ') AS synonym_text
        FROM sv)"""


@query("synonyms", "WITH " + QUESTIONS_SQL + """,
src AS (SELECT question_id AS qid, question AS q FROM qs
        UNION ALL SELECT -(conv_id * 1000 + turn + 1), text FROM conversations WHERE role = 'user'),""" + _synonym_sql("src")
       + " SELECT synonym_id, question_id, synonym_text FROM syn")
def q_synonyms(spark, d):
    """Dictionary synonym variants of generated questions and user turns."""
    qs = Q.generate_questions(Q.table_columns(spark, d)).select("question_id", "question")
    turns = user_prompts(spark, d).select((-(F.col("prompt_id") + 1)).alias("question_id"),
                                          F.col("prompt").alias("question"))
    return Q.synonym_rows(qs.unionByName(turns), "question_id", "question")


@query("union_texts", "WITH " + QUESTIONS_SQL + """,
src AS (SELECT question_id AS qid, question AS q FROM qs),""" + _synonym_sql("src") + """
SELECT question_id, question AS text, CAST(NULL AS BIGINT) AS synonym_id, CAST(NULL AS BIGINT) AS of_question FROM qs
UNION ALL SELECT NULL, synonym_text, synonym_id, question_id FROM syn""")
def q_union_texts(spark, d):
    qs = Q.generate_questions(Q.table_columns(spark, d))
    return Q.union_texts(qs, Q.synonym_rows(qs, "question_id", "question"))


def _fewshot_block() -> str:
    return "".join(f"Input: {i}\n\nOutput:\n{o}\n\n---\n\n" for _, i, o in sorted(Q.FEWSHOT_EXAMPLES))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("fewshot_prompt", "SELECT -(conv_id * 1000 + turn + 1) AS prompt_id, "
       + _sql_str(Q.FEWSHOT_INSTRUCTIONS + _fewshot_block() + "Only output the SQL for this Input:\n\nInput: ")
       + " || text || " + _sql_str("\n\nOutput:\n") + " AS prompt_text FROM conversations WHERE role = 'user'")
def q_fewshot(spark, d):
    p = user_prompts(spark, d).withColumn("prompt_id", -(F.col("prompt_id") + 1))
    return Q.fewshot_prompts(spark, p, "prompt").select("prompt_id", "prompt_text")


def _rag_hits(spark, d):
    prompts = user_prompts(spark, d).select("prompt_id", "prompt", V.hash_embed("prompt").alias("vec"))
    chunks = chunk_vectors(spark, d)
    hits = SR.threshold(SR.knn(prompts, chunks, 5, "prompt_id", "vec", "chunk_uid", "vec"), max_distance=0.8)
    return prompts, chunks, hits.select(F.col("query_id").alias("prompt_id"), F.col("item_id").alias("chunk_uid"),
                                        "rank")


@query("rag_prompt", "WITH RECURSIVE " + smart_chunks_sql() + ","
       + "prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user'),"
       + "chunk_src AS (SELECT doc_id * 1000000 + chunk_ix AS chunk_uid, content FROM chunks),"
       + _rename_hv(hash_vectors_sql("prompts", "prompt_id", "text"), "qv")
       + "," + _rename_hv(hash_vectors_sql("chunk_src", "chunk_uid", "content"), "cv")
       + "," + _SPARSE_SIM.format(q="qv", i="cv") + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM sims)
        WHERE rank <= 5 AND 1 - sim < 0.8),
ctx AS (SELECT t.query_id AS prompt_id, string_agg(cs.content, chr(10) || chr(10) ORDER BY t.rank) AS context,
               COUNT(*) AS n_chunks
        FROM top t JOIN chunk_src cs ON cs.chunk_uid = t.item_id GROUP BY t.query_id)
SELECT p.prompt_id, COALESCE(c.n_chunks, 0) AS n_chunks,
       """ + _sql_str(Q.RAG_TEMPLATE.split("{context}")[0]) + """ || COALESCE(c.context, '') || """
       + _sql_str(Q.RAG_TEMPLATE.split("{context}")[1].split("{question}")[0]) + """ || p.text || """
       + _sql_str(Q.RAG_TEMPLATE.split("{question}")[1]) + """ AS prompt_text
FROM prompts p LEFT JOIN ctx c ON c.prompt_id = p.prompt_id""")
def q_rag_prompt(spark, d):
    """Answer prompts: top-5 retrieved chunks (rank order) + the question."""
    prompts, chunks, hits = _rag_hits(spark, d)
    return Q.rag_prompts(prompts.select("prompt_id", "prompt"), hits, chunks)


@query("data_context", with_sales("""
WITH r AS (SELECT customer_id, product_id, strftime(sale_date, '%Y-%m-%d') AS sale_date,
              CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
              CAST(total_amount AS DOUBLE) AS total_amount, region FROM sales),
j AS (SELECT *, to_json({'customer_id': customer_id, 'product_id': product_id, 'sale_date': sale_date,
                         'quantity': quantity, 'unit_price': unit_price, 'total_amount': total_amount,
                         'region': region}) AS j FROM r),
top AS (SELECT * FROM j ORDER BY customer_id, product_id, sale_date, total_amount, region, j LIMIT 50)
SELECT 'Schema:' || chr(10) || '- customer_id (bigint)' || chr(10) || '- product_id (bigint)' || chr(10)
       || '- sale_date (string)' || chr(10) || '- quantity (double)' || chr(10) || '- unit_price (double)' || chr(10)
       || '- total_amount (double)' || chr(10) || '- region (string)' || chr(10) || chr(10) || 'Rows:' || chr(10)
       || string_agg(j, chr(10) ORDER BY customer_id, product_id, sale_date, total_amount, region, j) AS context
FROM top"""))
def q_data_context(spark, d):
    """Schema lines and the first 50 sales rows as JSON (model context)."""
    from tessera.operators.relational import sales_view
    from tessera.plans.registry import portable
    s = portable(sales_view(spark, d))
    return Q.data_context(s, 50, ["customer_id", "product_id", "sale_date", "total_amount", "region"])


def _hits_sql() -> str:
    from tessera.plans.q_nlq import _hv
    return ("WITH " + PAIRS_SQL + ",\n"
            + "up AS (SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user'),\n"
            + _hv("up", "prompt_id", "text", "qv") + ",\n" + _hv("pairs", "training_id", "question", "iv") + """,
qv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM qv GROUP BY id),
iv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM iv GROUP BY id),
dots AS (SELECT a.id AS query_id, b.id AS item_id, SUM(a.weight * b.weight) AS dp FROM qv a JOIN iv b ON a.bucket = b.bucket GROUP BY ALL),
sims AS (SELECT qn.id AS query_id, inn.id AS item_id, ROUND(COALESCE(d.dp, 0) / (qn.nrm * inn.nrm + 1e-12), 9) AS sim
         FROM qv_n qn CROSS JOIN iv_n inn LEFT JOIN dots d ON d.query_id = qn.id AND d.item_id = inn.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM sims)
        WHERE rank <= 3)
SELECT t.query_id AS prompt_id, CAST(t.rank AS INTEGER) AS rank, p.question, p.sql_template, t.sim AS score
FROM top t JOIN pairs p ON p.training_id = t.item_id""")


@query("hits_with_sql", _hits_sql())
def q_hits_with_sql(spark, d):
    """Top-3 training questions per user prompt with their SQL (one join)."""
    pairs = Q.generate_pairs(Q.table_columns(spark, d))
    prompts = user_prompts(spark, d).select("prompt_id", V.hash_embed("prompt").alias("vec"))
    tv = pairs.select("training_id", V.hash_embed("question").alias("vec"))
    hits = SR.knn(prompts, tv, 3, "prompt_id", "vec", "training_id", "vec", small_items=20_000, embedded=True)
    return hits.join(F.broadcast(pairs.select(F.col("training_id").alias("item_id"), "question", "sql_template")),
                     "item_id").select(F.col("query_id").alias("prompt_id"), F.col("rank").cast("int").alias("rank"),
                                       "question", "sql_template", "score")


def _safe_exec_sql() -> str:
    """What each generated statement returns, worked out per table."""
    first = {t: cols[0][0] for t, cols in CATALOG_SCHEMA.items()}
    sizes = " UNION ALL ".join(
        f"SELECT '{t}' AS t, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS groups FROM {t}"
        for t, c in first.items())
    return "WITH " + QUESTIONS_SQL + f""",
sz AS ({sizes}),
g AS (
  SELECT table_name, col_list, least(4, len(col_list)) AS k, array_to_string(col_list[1:4], ', ') AS four, question, n, present, groups
  FROM qs JOIN sz ON sz.t = qs.table_name)
SELECT CASE WHEN contains(question, 'How many') THEN 'SELECT COUNT(*) AS CNT FROM ' || table_name
            WHEN contains(question, 'top 10') THEN 'SELECT ' || four || ' FROM ' || table_name || ' ORDER BY ' || col_list[1] || ' LIMIT 10'
            WHEN contains(question, 'not null') THEN 'SELECT ' || four || ' FROM ' || table_name || ' WHERE ' || col_list[1] || ' IS NOT NULL'
            WHEN contains(question, 'grouped by') THEN 'SELECT ' || col_list[1] || ', COUNT(*) AS CNT FROM ' || table_name || ' GROUP BY ' || col_list[1]
            ELSE 'SELECT ' || four || ' FROM ' || table_name END AS sql_text,
       true AS ok, CAST(CASE WHEN contains(question, 'How many') THEN 1 WHEN contains(question, 'grouped by') THEN 2 ELSE k END AS INTEGER) AS n_cols,
       CAST(CASE WHEN contains(question, 'How many') THEN 1 WHEN contains(question, 'top 10') THEN least(10, n)
            WHEN contains(question, 'not null') THEN least(1000, present) WHEN contains(question, 'grouped by') THEN least(1000, groups)
            ELSE least(1000, n) END AS BIGINT) AS n_rows, false AS has_error
FROM g
UNION ALL SELECT 'SELECT no_such_column FROM ' || t, false, 0, 0, true FROM sz"""


@query("safe_exec", _safe_exec_sql())
def q_safe_exec(spark, d):
    """Ground SQL of every generated question, at most 1000 rows shown, and one
    statement per table that fails."""
    register_views(spark, d, IB.CATALOG_TABLES)
    qs = Q.ground_sql(Q.generate_questions(Q.table_columns(spark, d)))
    bad = F.concat(F.lit("SELECT no_such_column FROM "), F.col("table_name"))
    texts = qs.select(F.col("ground_sql").alias("sql_text")).unionByName(qs.select(bad.alias("sql_text")))
    return E.execute_all(spark, texts, "sql_text", 1000) \
            .select("sql_text", "ok", "n_cols", "n_rows", F.col("error").isNotNull().alias("has_error"))


@query("eval_cases")
def q_eval_cases(spark, d):
    """Evaluation run: questions and synonyms, ground SQL vs retrieved SQL."""
    register_views(spark, d, IB.CATALOG_TABLES)
    qs = Q.ground_sql(Q.generate_questions(Q.table_columns(spark, d)))
    syn = Q.synonym_rows(qs, "question_id", "question")
    pairs = Q.generate_pairs(Q.table_columns(spark, d))
    cand = Q.rag_candidates(qs, pairs).withColumn("llm_sql", F.regexp_replace("llm_sql", r"TPCH\.", ""))
    return Q.run_evaluation(spark, qs, syn, cand).drop("exec_ms_ground", "exec_ms_llm")


_CASES_SQL = """
cases AS (
  SELECT d.doc_id AS id, d.source AS run_name, d.doc_id % 50 AS question_id,
         CASE WHEN l.quality = 1 THEN 'Y' ELSE 'N' END AS same_sample,
         CASE WHEN l.toxic = 0 THEN 'Y' ELSE 'N' END AS same_shape,
         CASE WHEN l.quality IS NOT NULL THEN 'Y' ELSE 'N' END AS llm_ok,
         CASE WHEN l.quality IS NULL THEN 'ORA-00942: no label for document ' || CAST(d.doc_id AS VARCHAR) END AS error_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("eval_run_metrics", "WITH " + _CASES_SQL + """
SELECT run_name AS name, COUNT(*) AS n_cases,
       ROUND(AVG(CASE WHEN same_sample = 'Y' THEN 1 ELSE 0 END), 6) AS exact_match,
       ROUND(AVG(CASE WHEN same_shape = 'Y' THEN 1 ELSE 0 END), 6) AS shape_match,
       ROUND(AVG(CASE WHEN llm_ok = 'Y' THEN 1 ELSE 0 END), 6) AS llm_success
FROM cases GROUP BY run_name""")
def q_run_metrics(spark, d):
    cases, runs = Q.eval_cases_from_data(spark, d)
    return E.run_metrics(cases, runs).drop("eval_run_id")


@query("eval_trouble", "WITH " + _CASES_SQL + """
SELECT question_id, ROUND(AVG(CASE WHEN same_sample = 'Y' THEN 1 ELSE 0 END), 6) AS match_rate, COUNT(*) AS attempts
FROM cases GROUP BY question_id HAVING AVG(CASE WHEN same_sample = 'Y' THEN 1 ELSE 0 END) < 0.5""")
def q_trouble(spark, d):
    cases, _ = Q.eval_cases_from_data(spark, d)
    return E.trouble_spots(cases, 0.5)


@query("case_view", "WITH " + _CASES_SQL + """
SELECT id, question_id, same_sample, llm_ok, substr(error_text, 1, 120) AS error_snippet
FROM cases ORDER BY id DESC LIMIT 100""")
def q_case_view(spark, d):
    cases, _ = Q.eval_cases_from_data(spark, d)
    return E.case_view(cases, 100, 120).select("id", "question_id", "same_sample", "llm_ok", "error_snippet")


_COMPARED = {
    # name: (left, right) as (columns, filter, order)
    "alias": (("l_orderkey, l_linenumber AS n", "l_returnflag = 'R'", "l_orderkey, l_linenumber"),
              ("l_orderkey, l_linenumber AS total", "l_returnflag = 'R'", "l_orderkey, l_linenumber")),
    "order": (("l_orderkey, l_linenumber", "l_returnflag = 'R'", "l_orderkey, l_linenumber"),
              ("l_orderkey, l_linenumber", "l_returnflag = 'R'", "l_orderkey DESC, l_linenumber DESC")),
    "rows": (("l_orderkey, l_linenumber", "l_returnflag = 'R'", "l_orderkey, l_linenumber"),
             ("l_orderkey, l_linenumber", "l_linestatus = 'O'", "l_orderkey, l_linenumber")),
    "late": (("l_orderkey, l_linenumber", "l_orderkey > 0", "l_orderkey, l_linenumber"),
             ("l_orderkey, CASE WHEN l_orderkey < (SELECT max(l_orderkey) FROM lineitem) THEN l_linenumber END", "l_orderkey > 0", "l_orderkey, l_linenumber")),
    "shape": (("l_orderkey", "l_returnflag = 'R'", "l_orderkey"), ("l_orderkey, l_linenumber", "l_returnflag = 'R'", "l_orderkey, l_linenumber")),
}


def _compared_sql() -> str:
    parts = []
    for name, sides in _COMPARED.items():
        (ca, wa, oa), (cb, wb, ob) = sides
        if ca.count(",") != cb.split("CASE")[0].count(","):
            parts.append(f"SELECT '{name}' AS pair, false AS same_shape, false AS same_sample, NULL::BIGINT AS only_left, "
                         "NULL::BIGINT AS only_right, false AS same_multiset")
            continue
        a, b = f"SELECT {ca} FROM lineitem WHERE {wa}", f"SELECT {cb} FROM lineitem WHERE {wb}"
        tops = [f"(SELECT list(row(x, y)) FROM (SELECT * FROM ({q} ORDER BY {o} LIMIT 10) t(x, y)))" for q, o in ((a, oa), (b, ob))]
        left, right = f"(SELECT count(*) FROM ({a} EXCEPT ALL {b}))", f"(SELECT count(*) FROM ({b} EXCEPT ALL {a}))"
        parts.append(f"SELECT '{name}' AS pair, true AS same_shape, {tops[0]} = {tops[1]} AS same_sample, {left} AS only_left, "
                     f"{right} AS only_right, {left} = 0 AND {right} = 0 AS same_multiset")
    return "\nUNION ALL ".join(parts)


@query("compare_results", _compared_sql())
def q_compare_results(spark, d):
    """Pairs of results compared by position: other names, another order, other
    rows, a difference after the first rows, another number of columns."""
    register_views(spark, d, ("lineitem",))
    out = []
    for name, sides in _COMPARED.items():
        a, b = (spark.sql(f"SELECT {c} FROM lineitem WHERE {w} ORDER BY {o}") for c, w, o in sides)
        out.append(E.compare_results(a, b).select(F.lit(name).alias("pair"), "*"))
    return union_all(*out)


def _candidate_sql() -> str:
    from tessera.plans.q_nlq import _hv, _q
    rows = ", ".join(f"({i}, {_q(a)}, {_q(b)})" for i, a, b in Q.CANDIDATE_EXAMPLES)
    head, rest = Q.CANDIDATE_TEMPLATE.split("{question}")
    mid, tail = rest.split("{candidate_sql}")
    return ("WITH ex AS (SELECT * FROM (VALUES " + rows + ") t(id, input, sql)),\n"
            + "up AS (SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user'),\n"
            + _hv("up", "prompt_id", "text", "qv") + ",\n" + _hv("ex", "id", "input", "iv") + """,
qv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM qv GROUP BY id),
iv_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM iv GROUP BY id),
dots AS (SELECT a.id AS query_id, b.id AS item_id, SUM(a.weight * b.weight) AS dp FROM qv a JOIN iv b ON a.bucket = b.bucket GROUP BY ALL),
sims AS (SELECT qn.id AS query_id, inn.id AS item_id, ROUND(COALESCE(d.dp, 0) / (qn.nrm * inn.nrm + 1e-12), 9) AS sim
         FROM qv_n qn CROSS JOIN iv_n inn LEFT JOIN dots d ON d.query_id = qn.id AND d.item_id = inn.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rk FROM sims)
         WHERE rk = 1)
SELECT b.query_id AS prompt_id, CAST(b.item_id AS BIGINT) AS example_id, b.sim AS score,
       """ + _sql_str(head) + " || u.text || " + _sql_str(mid) + " || ex.sql || " + _sql_str(tail) + """ AS prompt_text
FROM best b JOIN up u ON u.prompt_id = b.query_id JOIN ex ON ex.id = b.item_id""")


@query("candidate_prompt", _candidate_sql())
def q_candidate_prompt(spark, d):
    """Candidate-SQL prompts: each user turn with the SQL of its closest example."""
    return Q.candidate_prompts(spark, user_prompts(spark, d), "prompt")

"""Question and prompt batches, and the evaluation run.

Questions are generated from the catalog (one row per table × template, via
``explode`` of the template list — no join), ground SQL is chosen by wording
rules, synonyms come from the dictionary expansion, and an evaluation run
executes every distinct ground/candidate statement once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import sqltext as S
from tessera.functions import vectors as V
from tessera.operators import catalog as C
from tessera.operators import evaluate as E
from tessera.operators import search as SR
from tessera.operators.relational import union_all
from tessera.plans import index_build as IB
from tessera.tables import load

# Question templates per table.
QUESTION_TEMPLATES = [
    "List all {table} with their {cols}.",
    "How many {table} are there?",
    "Show the top 10 {table} ordered by {first_col}.",
    "Find {table} where {first_col} is not null.",
    "Show {table} grouped by {first_col} with counts.",
]

# Few-shot examples (input, output SQL) in id order.
FEWSHOT_EXAMPLES = [
    (1, "Get total sales amount per region.", "SELECT region, SUM(total_amount) FROM sales GROUP BY region"),
    (2, "Find all sales records for product_id 101 sold in January 2025.",
     "SELECT * FROM sales WHERE product_id = 101 AND sale_date BETWEEN DATE '2025-01-01' AND DATE '2025-01-31'"),
    (3, "List the top 3 products by total sales amount.",
     "SELECT product_id, SUM(total_amount) FROM sales GROUP BY product_id ORDER BY SUM(total_amount) DESC LIMIT 3"),
    (4, "Get total sales for customer_id 55 in 2023.",
     "SELECT SUM(total_amount) FROM sales WHERE customer_id = 55 AND sale_date BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'"),
    (5, "List all distinct products.", "SELECT DISTINCT product_id FROM products"),
    (6, "List all unique product identifiers.", "SELECT DISTINCT product_id FROM products"),
    (7, "List all products", "SELECT * FROM products"),
]

FEWSHOT_INSTRUCTIONS = ("You are an expert SQL generator. Given an input question, write one read-only "
                        "Spark SQL query over the table sales(customer_id, product_id, sale_date, quantity, "
                        "unit_price, total_amount, region).\n\n### Examples:\n")

# Examples with candidate SQL (input, sql), in id order.
CANDIDATE_EXAMPLES = [
    (1, "Get total sales per region", "SELECT region, SUM(total_amount) FROM sales GROUP BY region"),
    (2, "Show total revenue for customer 101 in 2023",
     "SELECT SUM(total_amount) FROM sales WHERE customer_id = 101 AND sale_date BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'"),
    (3, "List all sales in January 2024",
     "SELECT * FROM sales WHERE sale_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
]

# Prompt templates ({question}, {candidate_sql}, {context} are filled per row).
CANDIDATE_TEMPLATE = ("\nYou are an expert Spark SQL assistant.\n\nGiven a user question and a candidate SQL query, "
                      "return **only the final corrected Spark SQL query** if needed.\n\n- Do not include explanations.\n"
                      "- Do not format the query with markdown.\n- Do not use triple backticks.\n"
                      "- Just return the raw SQL.\n\n### User Question:\n{question}\n\n### Candidate SQL:\n"
                      "{candidate_sql}\n\n### Final SQL:\n")

RAG_TEMPLATE = ("\nYou are a helpful assistant. Use the following context to answer the question.\n\n"
                "Context:\n{context}\n\nQuestion:\n{question}\n\nAnswer:\n")


def table_columns(spark: SparkSession, sf_dir: str, names=IB.CATALOG_TABLES) -> DataFrame:
    """``table_name, col_list`` (ordered column names) of every catalog table
    that has rows (measured): nothing can be asked of an empty one."""
    fr = IB.frames(spark, sf_dir, names)
    filled = C.table_counts(fr).where("num_rows > 0").select("table_name")
    cols = C.columns_of(spark, fr).join(filled, "table_name", "left_semi")
    return cols.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_id", "column_name"))),
                                                      lambda s: s["column_name"]).alias("col_list"))


def generate_questions(tables: DataFrame) -> DataFrame:
    """Five questions per table.  ``question_id`` is deterministic:
    table order × 5 + template index."""
    cols4 = F.array_join(F.slice("col_list", 1, 4), ", ")
    first = F.coalesce(F.element_at("col_list", 1), F.lit("1"))
    tpl = F.posexplode(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES])).alias("tpl_ix", "tpl")
    x = tables.select("table_name", "col_list", tpl)
    q = F.replace(F.replace(F.replace(F.col("tpl"), F.lit("{table}"), F.col("table_name")),
                            F.lit("{cols}"), cols4), F.lit("{first_col}"), first)
    w = F.dense_rank().over(Window.orderBy("table_name")) - 1
    return x.select((w * 5 + F.col("tpl_ix")).cast("long").alias("question_id"), "table_name",
                    q.alias("question"), F.to_json("col_list").alias("column_list"))


def ground_sql(questions: DataFrame) -> DataFrame:
    """Ground-truth SQL by question wording (first rule that applies)."""
    cols = S.safe_json_list("column_list")
    c4 = F.when(F.size(cols) > 0, F.array_join(F.slice(cols, 1, 4), ", ")).otherwise(F.lit("*"))
    first = F.coalesce(F.element_at(cols, 1), F.lit("1"))
    t = F.col("table_name")
    lq = F.lower("question")
    sql = (F.when(F.col("question").contains("How many"), F.concat(F.lit("SELECT COUNT(*) AS CNT FROM "), t))
            .when(lq.contains("top 10"), F.concat(F.lit("SELECT "), c4, F.lit(" FROM "), t, F.lit(" ORDER BY "),
                                                  F.split(c4, ",")[0], F.lit(" LIMIT 10")))
            .when(lq.contains("not null"), F.concat(F.lit("SELECT "), c4, F.lit(" FROM "), t, F.lit(" WHERE "),
                                                    first, F.lit(" IS NOT NULL")))
            .when(lq.contains("grouped by"), F.concat(F.lit("SELECT "), first, F.lit(", COUNT(*) AS CNT FROM "), t,
                                                      F.lit(" GROUP BY "), first))
            .otherwise(F.concat(F.lit("SELECT "), c4, F.lit(" FROM "), t)))
    return questions.withColumn("ground_sql", sql)


def generate_pairs(tables: DataFrame, schema: str = "TPCH") -> DataFrame:
    """Column questions with SQL: one per column, one filter and one
    group-by per table with at least two columns."""
    per_col = tables.select("table_name", F.posexplode("col_list").alias("pos", "col")).select(
        "table_name", F.col("pos").cast("int").alias("ord"),
        F.concat(F.lit("Show me all "), F.col("col"), F.lit(" from "), F.col("table_name")).alias("question"),
        F.concat(F.lit("SELECT "), F.col("col"), F.lit(f" FROM {schema}."), F.col("table_name")).alias("sql_template"))
    two = tables.where(F.size("col_list") >= 2)
    c0, c1 = F.element_at("col_list", 1), F.element_at("col_list", 2)
    filt = two.select("table_name", F.lit(100000).alias("ord"),
                      F.concat(F.lit("Show me "), c0, F.lit(" where "), c1, F.lit(" = ?")).alias("question"),
                      F.concat(F.lit("SELECT "), c0, F.lit(f" FROM {schema}."), F.col("table_name"), F.lit(" WHERE "),
                               c1, F.lit(" = :1")).alias("sql_template"))
    grp = two.select("table_name", F.lit(100001).alias("ord"),
                     F.concat(F.lit("Count "), c0, F.lit(" grouped by "), c1).alias("question"),
                     F.concat(F.lit("SELECT "), c1, F.lit(", COUNT("), c0, F.lit(f") FROM {schema}."),
                              F.col("table_name"), F.lit(" GROUP BY "), c1).alias("sql_template"))
    pairs = union_all(per_col, filt, grp)
    w = Window.orderBy("table_name", "ord")
    return pairs.withColumn("training_id", F.row_number().over(w).cast("long")).drop("ord")


def fewshot_prompts(spark: SparkSession, prompts: DataFrame, text_col: str = "prompt") -> DataFrame:
    """Instructions + examples in id order + the input, for every prompt."""
    ex = spark.createDataFrame(FEWSHOT_EXAMPLES, "id int, example_input string, example_output string")
    block = ex.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "example_input",
                                                                                   "example_output"))),
                                            lambda s: F.concat(F.lit("Input: "), s["example_input"],
                                                               F.lit("\n\nOutput:\n"), s["example_output"],
                                                               F.lit("\n\n---\n\n"))), "").alias("b"))
    return prompts.withColumn("prompt_text", F.concat(
        F.lit(FEWSHOT_INSTRUCTIONS), block.scalar(),
        F.lit("Only output the SQL for this Input:\n\nInput: "), F.col(text_col), F.lit("\n\nOutput:\n")))


def rag_prompts(prompts: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks in rank order joined by a blank line, wrapped in the
    answer template.  ``hits``: prompt_id, chunk_uid, rank."""
    ctx = (hits.join(chunks.select("chunk_uid", "content"), "chunk_uid")
               .groupBy("prompt_id")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))),
                                             lambda s: s["content"]), "\n\n").alias("context"),
                    F.count(F.lit(1)).alias("n_chunks")))
    p = prompts.join(ctx, "prompt_id", "left")
    text = F.replace(F.replace(F.lit(RAG_TEMPLATE), F.lit("{context}"), F.coalesce("context", F.lit(""))),
                     F.lit("{question}"), F.col("prompt"))
    return p.select("prompt_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), text.alias("prompt_text"))


def candidate_prompts(spark: SparkSession, prompts: DataFrame, text_col: str = "prompt") -> DataFrame:
    """Prompt with the SQL of the most similar example as the candidate
    (best match over a small, broadcast example table)."""
    ex = spark.createDataFrame(CANDIDATE_EXAMPLES, "id long, input string, sql string") \
              .withColumn("vec", V.hash_embed("input"))
    pv = prompts.select("prompt_id", V.hash_embed(text_col).alias("vec"))
    best = SR.knn(pv, ex, 1, "prompt_id", "vec", "id", "vec", small_items=1000, embedded=True)
    j = (prompts.join(best.select(F.col("query_id").alias("prompt_id"), F.col("item_id").alias("id"), "score"),
                      "prompt_id")
                .join(F.broadcast(ex.select("id", "sql")), "id"))
    text = F.replace(F.replace(F.lit(CANDIDATE_TEMPLATE), F.lit("{question}"), F.col(text_col)),
                     F.lit("{candidate_sql}"), F.col("sql"))
    return j.select("prompt_id", F.col("id").alias("example_id"), "score", text.alias("prompt_text"))


def data_context(df: DataFrame, n: int = 50, order: list[str] | None = None) -> DataFrame:
    """Schema lines plus the first ``n`` rows (by ``order``, then the row
    text) as JSON lines — one row.  The row order is made explicit with
    ``array_sort`` (``collect_list`` alone keeps no order)."""
    keys = order or df.columns[:1]
    schema = "\n".join(f"- {f.name} ({f.dataType.simpleString()})" for f in df.schema.fields)
    j = F.to_json(F.struct(*df.columns))
    rows = df.select(*keys, j.alias("j")).orderBy(*keys, "j").limit(n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*keys, "j"))), lambda s: s["j"])
    return rows.agg(F.concat(F.lit("Schema:\n" + schema + "\n\nRows:\n"),
                             F.array_join(ordered, "\n")).alias("context"))


def synonym_rows(questions: DataFrame, id_col: str, text_col: str, max_variants: int = 5) -> DataFrame:
    """Synonym variants (the original excluded) with ids ``question_id*10+k``."""
    v = questions.select(id_col, F.posexplode(S.expand_synonyms(text_col, max_variants)).alias("k", "synonym_text"))
    return v.where(F.col("k") > 0).select((F.col(id_col) * 10 + F.col("k")).alias("synonym_id"),
                                          F.col(id_col).alias("question_id"), "synonym_text")


def union_texts(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Question and synonym texts in one frame (one of the two ids null)."""
    q = questions.select("question_id", F.col("question").alias("text"))
    s = synonyms.select(F.col("synonym_id"), F.col("question_id").alias("of_question"),
                        F.col("synonym_text").alias("text"))
    return q.unionByName(s, allowMissingColumns=True)


def rag_candidates(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate SQL per question: the SQL of the most similar training
    question (retrieval stands in for a model call)."""
    qv = questions.select("question_id", V.hash_embed("question").alias("vec"))
    tv = pairs.select("training_id", V.hash_embed("question").alias("vec"))
    best = SR.knn(qv, tv, 1, "question_id", "vec", "training_id", "vec", small_items=20_000, embedded=True)
    return (best.join(pairs.select(F.col("training_id").alias("item_id"), "sql_template"), "item_id")
                .select(F.col("query_id").alias("question_id"), F.col("sql_template").alias("llm_sql")))


def run_evaluation(spark: SparkSession, questions: DataFrame, synonyms: DataFrame, candidates: DataFrame,
                   cap: int = 1000, compat: bool = False) -> DataFrame:
    """One case per question and per synonym: ground SQL (from the question)
    and candidate SQL (from ``candidates``: question_id, [synonym_id], llm_sql)
    executed once per distinct statement, then compared."""
    base = questions.select("question_id", "ground_sql").join(
        synonyms.select("question_id", "synonym_id"), "question_id", "left")
    qrows = questions.select("question_id", F.lit(None).cast("long").alias("synonym_id"), "ground_sql")
    srows = base.where(F.col("synonym_id").isNotNull()).select("question_id", "synonym_id", "ground_sql")
    cases = qrows.unionByName(srows)
    cand_cols = ["question_id"] + (["synonym_id"] if "synonym_id" in candidates.columns else [])
    cases = cases.join(candidates, cand_cols, "left")
    stmts = cases.select(F.col("ground_sql").alias("sql_text")).unionByName(
        cases.select(F.col("llm_sql").alias("sql_text")))
    sig = E.execute_all(spark, stmts, "sql_text", cap)
    g = sig.select(*[F.col(c).alias(f"g_{c}") for c in sig.columns])
    c = sig.select(*[F.col(c).alias(f"c_{c}") for c in sig.columns])
    j = (cases.join(g, cases.ground_sql == g.g_sql_text, "left")
              .join(c, cases.llm_sql == c.c_sql_text, "left"))
    shape, sample, multi = E.compare_signatures("g", "c", compat)
    err = F.concat_ws(" | ", F.col("g_error"), F.col("c_error"))
    return j.select("question_id", "synonym_id", "ground_sql", "llm_sql",
                    F.when(F.col("ground_sql").isNull(), "no_ground")
                     .when(F.col("g_ok"), "Y").otherwise("N").alias("ground_ok"),
                    F.when(F.col("c_ok"), "Y").otherwise("N").alias("llm_ok"),
                    shape, sample, multi, F.substring(err, 1, 4000).alias("error_text"),
                    F.col("g_exec_ms").alias("exec_ms_ground"), F.col("c_exec_ms").alias("exec_ms_llm"))


def eval_cases_from_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases derived from documents ⟕ labels: run = source,
    question = doc_id % 50, exact match = quality 1, shape match = toxic 0,
    model success = the document has a label."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    lab = load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    runs = d.select(F.col("source").alias("name")).distinct().select(
        F.xxhash64("name").alias("id"), "name")
    cases = j.select(F.col("doc_id").alias("id"), F.xxhash64("source").alias("eval_run_id"),
                     (F.col("doc_id") % 50).alias("question_id"),
                     F.when(F.col("quality") == 1, "Y").otherwise("N").alias("same_sample"),
                     F.when(F.col("toxic") == 0, "Y").otherwise("N").alias("same_shape"),
                     F.when(F.col("quality").isNotNull(), "Y").otherwise("N").alias("llm_ok"),
                     F.when(F.col("quality").isNull(), F.concat(F.lit("ORA-00942: no label for document "),
                                                                F.col("doc_id").cast("string")))
                      .alias("error_text"))
    return cases, runs

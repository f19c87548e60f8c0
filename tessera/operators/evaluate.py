"""Evaluation of candidate SQL against ground truth.

Each distinct statement is executed once (one Spark job per statement; the
number of statements is bounded by the question set, not by the data) and
reduced *on the executors* to a small signature: column count, row count,
first rows in the order of the result (values by position), and an order-free
multiset hash of all rows.  Only signatures reach the driver; cases are then compared
as a DataFrame join.
"""

from __future__ import annotations

import time
import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

SIGNATURE_SCHEMA = ("sql_text string, ok boolean, n_cols int, n_rows long, sample array<string>, "
                    "mhash long, error string, exec_ms long")

#: estimated bytes of the files that one part of counted rows is read from (a few
#: hundred thousand rows of two numbers), most parts, and estimates that mean nothing
PART_BYTES, MOST_PARTS, UNKNOWN_BYTES = 512 << 10, 10_000, 1 << 50


def capped(spark: SparkSession, sql: str, cap: int = 1000) -> DataFrame:
    """``SELECT * FROM (<sql>) LIMIT cap`` (trailing semicolons removed)."""
    body = sql.strip().rstrip(";")
    return spark.sql(f"SELECT * FROM ({body}) q LIMIT {int(cap)}")


def positional(df: DataFrame):
    """A row's values as JSON by position, nulls kept: names don't matter."""
    cells = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """One row: the first ``n`` rows in the result's own order, as an array.
    At most ``n`` rows per task are read on the way."""
    return df.limit(n).select(positional(df).alias("r")).coalesce(1).agg(F.collect_list("r").alias("s"))


def signature(df: DataFrame, sample_n: int = 10) -> tuple[int, int, list[str], int]:
    """(columns, rows, first ``sample_n`` rows in the order of the result,
    multiset hash of all rows).  Rows and hash are of the whole result, not of
    a capped one, so results that differ late differ here."""
    agg = df.select(positional(df).alias("r")).agg(
        F.count(F.lit(1)).alias("n"),
        # order-free multiset hash; each term < 2^31 so the sum cannot overflow
        F.coalesce(F.sum(F.pmod(F.xxhash64("r"), F.lit(2147483647))), F.lit(0)).alias("h")).first()
    return len(df.columns), agg["n"], list(first_rows(df, sample_n).first()["s"]), agg["h"]


def safe_exec(spark: SparkSession, sql: str, cap: int = 1000, sample_n: int = 10) -> tuple:
    """Run one query; never raises, and runs nothing but queries.  Returns the signature tuple of
    :data:`SIGNATURE_SCHEMA` (errors cut to 4000 characters); ``n_rows`` is
    what a user sees, at most ``cap``."""
    t0 = time.time()
    try:
        if parse_statement(spark, sql.strip().rstrip(";"))[1] == "write":
            raise PermissionError("only queries are run")
        n_cols, n_rows, sample, h = signature(spark.sql(sql.strip().rstrip(";")), sample_n)
        return (sql, True, n_cols, min(n_rows, cap), sample, h, None, int((time.time() - t0) * 1000))
    except Exception as e:  # noqa: BLE001 - any failure is a result here
        return (sql, False, 0, 0, [], 0, str(e)[:4000], int((time.time() - t0) * 1000))


#: functions that run code of any kind
_RUNS_CODE = {"reflect", "java_method", "try_reflect"}
PARSED_SCHEMA = "sql_text string, kind string, relations array<string>, columns array<string>"


def parse_statement(spark: SparkSession, sql: str) -> tuple[str, str, list[str], list[str]]:
    """One statement as Spark's parser reads it: ``kind`` (``read``, ``write``
    for anything that is more than a query, ``error``), the relations it names
    (without its own CTEs) and its columns, both sorted.  Nothing runs."""
    jvm = spark._jvm
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    commands = [jvm.java.lang.Class.forName(logical + c) for c in ("Command", "ParsedStatement")]
    subquery = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # noqa: BLE001 - whatever the parser refuses
        return sql, "error", [], []
    kind, relations, columns, own = "read", set(), set(), set()

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e) -> None:
        nonlocal kind
        name = e.getClass().getSimpleName()
        if name == "UnresolvedAttribute":
            columns.add(".".join(items(e.nameParts())).lower())
        elif name == "UnresolvedFunction" and items(e.nameParts())[-1].lower() in _RUNS_CODE:
            kind = "write"
        elif subquery.isInstance(e):
            node(e.plan())
        for c in items(e.children()):
            expression(c)

    def node(p) -> None:
        nonlocal kind
        name = p.getClass().getSimpleName()
        if any(c.isInstance(p) for c in commands) or name == "ScriptTransformation":
            kind = "write"
        if name == "UnresolvedRelation":
            relations.add(".".join(items(p.multipartIdentifier())).lower())
        if name == "InsertIntoStatement":
            node(p.table())
        if name == "UnresolvedWith":
            for cte in items(p.cteRelations()):
                own.add(cte._1().lower())
                node(cte._2())
        for e in items(p.expressions()):
            expression(e)
        for c in items(p.children()):
            node(c)

    node(plan)
    return sql, kind, sorted(relations - own), sorted(columns)


def parse_statements(spark: SparkSession, statements: DataFrame, col: str = "sql_text") -> DataFrame:
    """``parse_statement`` of every distinct non-null statement.  The parser is
    the driver's; a thousand results at a time go to the shared folder."""
    distinct = statements.select(F.col(col).alias("sql_text")).where("sql_text IS NOT NULL").distinct().orderBy("sql_text")
    texts = (r[0] for r in distinct.toLocalIterator())
    path = scratch_path(spark, f"parsed-{uuid.uuid4().hex}")
    spark.createDataFrame([], PARSED_SCHEMA).write.parquet(path)
    while part := list(islice(texts, 1000)):
        spark.createDataFrame([parse_statement(spark, t) for t in part], PARSED_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(PARSED_SCHEMA).parquet(path)


def execute_all(spark: SparkSession, statements: DataFrame, col: str = "sql_text", cap: int = 1000,
                concurrency: int = 8) -> DataFrame:
    """Signatures of every distinct non-null statement of ``statements``.

    Statements run as concurrent Spark jobs (driver threads submitting to
    the same scheduler), each reduced to its signature on the executors.  The
    signatures of a thousand statements at a time go to the shared folder."""
    from concurrent.futures import ThreadPoolExecutor

    distinct = statements.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    texts = (r[0] for r in distinct.toLocalIterator())  # a partition of statements at a time
    path = scratch_path(spark, f"signatures-{uuid.uuid4().hex}")
    spark.createDataFrame([], SIGNATURE_SCHEMA).write.parquet(path)
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        while part := list(islice(texts, 1000)):
            sigs = list(pool.map(lambda t: safe_exec(spark, t, cap), part))
            spark.createDataFrame(sigs, SIGNATURE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SIGNATURE_SCHEMA).parquet(path)


def compare_signatures(g: str = "g", c: str = "c", compat: bool = False):
    """Columns ``same_shape``, ``same_sample``, ``same_multiset`` from ground
    (``g_*``) and candidate (``c_*``) signature columns.  A side that failed
    or is missing never matches (D5) unless ``compat`` reproduces the
    original (empty equals empty)."""
    gok = F.coalesce(F.col(f"{g}_ok"), F.lit(False))
    cok = F.coalesce(F.col(f"{c}_ok"), F.lit(False))
    both = gok & cok if not compat else F.lit(True)
    gcols = F.coalesce(F.col(f"{g}_n_cols"), F.lit(0))
    ccols = F.coalesce(F.col(f"{c}_n_cols"), F.lit(0))
    shape = both & (gcols == ccols)
    empty = F.array().cast("array<string>")
    sample = shape & (F.coalesce(F.col(f"{g}_sample"), empty) == F.coalesce(F.col(f"{c}_sample"), empty))
    multi = shape & (F.coalesce(F.col(f"{g}_n_rows"), F.lit(0)) == F.coalesce(F.col(f"{c}_n_rows"), F.lit(0))) \
        & (F.coalesce(F.col(f"{g}_mhash"), F.lit(0)) == F.coalesce(F.col(f"{c}_mhash"), F.lit(0)))
    yn = lambda b: F.when(b, "Y").otherwise("N")
    return yn(shape).alias("same_shape"), yn(sample).alias("same_sample"), yn(multi).alias("same_multiset")


def count_parts(*results: DataFrame) -> int | None:
    """Parts in which rows are counted, so that a part stays of one size however
    large the results are; None where the session's number of parts does.
    Decided from the size estimates of the plans alone: nothing runs."""
    size = max(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in results)
    parts = min(MOST_PARTS, -(-size // PART_BYTES))
    usual = int(results[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts if size < UNKNOWN_BYTES and parts > usual else None


def compare_results(a: DataFrame, b: DataFrame, sample_n: int = 10) -> DataFrame:
    """Direct comparison of two result frames by position: same column count,
    same first rows in the order of each result, multiset difference both ways
    (rows as text, so column names and null fields don't matter)."""
    same_shape = len(a.columns) == len(b.columns)
    # each side is counted by itself: so Spark drops a result's own order, which
    # would sort all of it; the counts of both meet where they were made
    parts = count_parts(a, b)
    ra, rb = (df.select(positional(df).alias("r")) for df in (a, b))
    if parts:
        ra, rb = ra.repartition(parts, "r"), rb.repartition(parts, "r")
    ra, rb = (r.groupBy("r").agg(F.count(F.lit(1)).alias("n")) for r in (ra, rb))
    sides = ra.unionByName(rb.select("r", (-F.col("n")).alias("n"))).groupBy("r").agg(F.sum("n").alias("n"))
    left = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0))
    right = F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0))
    sample = first_rows(a, sample_n).scalar() == first_rows(b, sample_n).scalar()
    shape = F.lit(same_shape)
    return sides.agg(left.alias("l"), right.alias("r")).select(
        shape.alias("same_shape"), (shape & sample).alias("same_sample"),
        F.when(shape, F.col("l")).alias("only_left"), F.when(shape, F.col("r")).alias("only_right"),
        (shape & (F.col("l") == 0) & (F.col("r") == 0)).alias("same_multiset"))


def run_metrics(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: cases, exact-match, shape-match and model-success rates."""
    rate = lambda c: F.avg(F.when(F.col(c) == "Y", 1).otherwise(0)).cast("double")
    return (cases.join(runs, cases.eval_run_id == runs.id)
                 .groupBy("eval_run_id", "name")
                 .agg(F.count(F.lit(1)).alias("n_cases"), F.round(rate("same_sample"), 6).alias("exact_match"),
                      F.round(rate("same_shape"), 6).alias("shape_match"),
                      F.round(rate("llm_ok"), 6).alias("llm_success")))


def trouble_spots(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Questions whose match rate is below ``threshold`` (worst first)."""
    g = cases.groupBy("question_id").agg(
        F.round(F.avg(F.when(F.col("same_sample") == "Y", 1).otherwise(0)), 6).alias("match_rate"),
        F.count(F.lit(1)).alias("attempts"))
    return g.where(F.col("match_rate") < threshold).orderBy("match_rate", "question_id")


def case_view(cases: DataFrame, n: int = 100, snippet: int = 120) -> DataFrame:
    """Latest ``n`` cases with an error snippet."""
    return (cases.orderBy(F.col("id").desc()).limit(n)
                 .withColumn("error_snippet", F.substring("error_text", 1, snippet)))

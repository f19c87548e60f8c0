"""Registered text queries: hashing, chunking, token stats, hashed embeddings,
model-output parsing, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sqltext as S
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators.evaluate import parse_statements
from tessera.plans.registry import query
from tessera.session import spread
from tessera.tables import load

# DuckDB form of the sentence-aware chunker (350 tokens → 1400 characters, cut
# at the last ". " more than 100 characters into the window, no overlap).
# Whitespace strip covers the characters that occur in the test corpora.
_WS = "' ' || chr(10) || chr(9) || chr(13)"


def smart_chunks_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                     width: int = 1400) -> str:
    return f"""
chunk_state(doc_id, t, n, i, s, e) AS (
  SELECT {id_col}, {text_col}, length({text_col}), 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM {table} WHERE {text_col} IS NOT NULL AND length({text_col}) > 0
  UNION ALL
  SELECT doc_id, t, n, cut, i, cut FROM (
    SELECT doc_id, t, n, i,
           CASE WHEN p = 0 OR (i + len - 1 - p) <= i + 100 THEN en ELSE i + len - 1 - p END AS cut
    FROM (SELECT doc_id, t, n, i, en, en - i AS len,
                 strpos(reverse(substr(t, i + 1, en - i)), ' .') AS p
          FROM (SELECT doc_id, t, n, i, least(n, i + {width}) AS en FROM chunk_state WHERE i < n) a) b) c
),
chunk_raw AS (
  SELECT doc_id, s, substr(t, s + 1, e - s) AS raw FROM chunk_state WHERE s IS NOT NULL
),
chunks AS (
  SELECT doc_id,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_ix,
         CAST(s + length(raw) - length(ltrim(raw, {_WS})) AS INTEGER) AS chunk_start,
         trim(raw, {_WS}) AS content
  FROM chunk_raw WHERE length(trim(raw, {_WS})) > 0
)"""


def hash_vectors_sql(source: str, id_col: str, text_col: str, dim: int = V.HASH_DIM) -> str:
    """Sparse rows (id, bucket, weight) of the hashed bag-of-words embedding,
    weights rounded to float32 exactly as stored by Spark."""
    return f"""
tok AS (
  SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS w
  FROM {source}
),
cnt AS (
  SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket, COUNT(*) AS c
  FROM tok WHERE length(w) > 0 GROUP BY ALL
),
hv AS (
  SELECT id, bucket, CAST(CAST(c / sqrt(SUM(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS weight
  FROM cnt
)"""


@query("doc_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def q_doc_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", X.content_hash("text").alias("hash"))


@query("smart_chunks", "WITH RECURSIVE " + smart_chunks_sql() + """
SELECT doc_id, chunk_ix, chunk_start, content, CAST(floor(length(content) / 4) AS INTEGER) AS tokens FROM chunks""")
def q_smart_chunks(spark, d):
    return X.smart_chunks(load(spark, d, "documents"), "text", 350, 40, True, ("doc_id",))


@query("chunk_stats", "WITH RECURSIVE " + smart_chunks_sql() + """
SELECT doc_id, COUNT(*) AS n_chunks, CAST(SUM(floor(length(content) / 4)) AS BIGINT) AS tokens,
       CAST(MAX(length(content)) AS INTEGER) AS max_chars
FROM chunks GROUP BY doc_id""")
def q_chunk_stats(spark, d):
    ch = X.smart_chunks(load(spark, d, "documents"), "text", 350, 40, True, ("doc_id",))
    return ch.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"),
                                    F.max(F.length("content")).alias("max_chars"))


@query("word_chunks", r"""
WITH RECURSIVE wd AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
lens AS (SELECT doc_id, list_transform(ws, lambda x: length(x) + 1) AS ls FROM wd WHERE len(ws) > 0),
walk(doc_id, ls, n, i, size, chunk) AS (
  SELECT doc_id, ls, len(ls), 1, ls[1], CASE WHEN ls[1] > 512 THEN 1 ELSE 0 END FROM lens
  UNION ALL
  SELECT doc_id, ls, n, i + 1,
         CASE WHEN size + ls[i + 1] > 512 THEN ls[i + 1] ELSE size + ls[i + 1] END,
         CASE WHEN size + ls[i + 1] > 512 THEN chunk + 1 ELSE chunk END
  FROM walk WHERE i < n),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM wd),
packed AS (SELECT k.doc_id, k.chunk, string_agg(x.w, ' ' ORDER BY x.i) AS content
           FROM walk k JOIN words x ON x.doc_id = k.doc_id AND x.i = k.i GROUP BY k.doc_id, k.chunk),
lead AS (SELECT doc_id, 0 AS chunk, '' AS content FROM lens WHERE ls[1] > 512)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_ix, content, CAST(length(content) AS INTEGER) AS n_chars
FROM (SELECT * FROM packed UNION ALL SELECT * FROM lead)""")
def q_word_chunks(spark, d):
    """Greedy 512-character word packing of every document."""
    return X.word_chunks(load(spark, d, "documents"), "text", 512, ("doc_id",)) \
            .withColumn("n_chars", F.length("content"))


@query("page_text")
def q_page_text(spark, d):
    """Visible text of every page."""
    return X.page_text(load(spark, d, "pages")).select("page_id", "url", "text")


@query("hash_embed", "WITH " + hash_vectors_sql("documents", "doc_id", "text") + """
SELECT id AS doc_id, bucket, ROUND(weight, 6) AS weight FROM hv""")
def q_hash_embed(spark, d):
    docs = spread(load(spark, d, "documents")).select("doc_id", V.hash_embed("text").alias("vec"))
    return (docs.select("doc_id", F.posexplode("vec").alias("bucket", "w"))
                .where(F.col("w") != 0)
                .select("doc_id", F.col("bucket").cast("int").alias("bucket"),
                        F.round(F.col("w").cast("double"), 6).alias("weight")))


@query("l2_norm", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3.0) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nn FROM v),
u AS (SELECT vec_id, list_transform(e, lambda x: CAST(x / nn AS FLOAT)) AS e FROM n)
SELECT vec_id, ROUND(sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
       ROUND(CAST(e[1] AS DOUBLE), 6) AS first_value
FROM u""")
def q_l2_norm(spark, d):
    e = load(spark, d, "embeddings")
    scaled = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3.0).alias("e"))
    u = scaled.select("vec_id", V.l2_normalize("e").alias("e"))
    return u.select("vec_id", F.round(V.norm("e"), 6).alias("norm"),
                    F.round(F.col("e")[0].cast("double"), 6).alias("first_value"))


@query("parse_list", """
WITH e AS (
  SELECT event_id, event_id % 4 AS kind,
         [event_type, 'u' || CAST(user_id AS VARCHAR), 'e' || CAST(event_id AS VARCHAR), 'a', 'b', 'c'] AS items FROM events),
x AS (
  SELECT event_id, CASE kind WHEN 0 THEN items[1:5] WHEN 1 THEN items[1:5] WHEN 2 THEN items[1:1] ELSE items[1:3] END AS items FROM e)
SELECT event_id, CAST(unnest(range(0, len(items))) AS INTEGER) AS item_ix, unnest(items) AS item FROM x""")
def q_parse_list(spark, d):
    """Model list output built from the events: a JSON list of six (capped at
    five), bulleted lines with blank ones between, a single line, and lines that
    only start like JSON."""
    items = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")),
                    F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("a"), F.lit("b"), F.lit("c"))
    kind = F.col("event_id") % 4
    bullets = F.concat(F.lit("\n- "), F.array_join(items, " \n \t\n• "), F.lit("\n"))
    text = F.when(kind == 0, F.to_json(items)).when(kind == 1, bullets).when(kind == 2, F.element_at(items, 1)) \
        .otherwise(F.array_join(F.slice(items, 1, 3), "\n"))
    e = load(spark, d, "events").select("event_id", text.alias("text"))
    return e.select("event_id", F.posexplode(S.parse_list("text", 5)).alias("item_ix", "item")) \
            .withColumn("item_ix", F.col("item_ix").cast("int"))


@query("json_list", """
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 7 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_items FROM events""")
def q_json_list(spark, d):
    """JSON list text built from the events: lists of 0 to 6 items, a list of
    objects, an object, and text that isn't JSON."""
    n = (F.col("event_id") % 7).cast("int")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.to_json(F.array_repeat(F.col("event_type"), n))) \
        .when(kind == 1, F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))) \
        .when(kind == 2, F.col("props")).otherwise(F.concat(F.lit("["), "event_type"))
    e = load(spark, d, "events").select("event_id", text.alias("text"))
    return e.select("event_id", F.size(S.safe_json_list("text")).alias("n_items"))


@query("clean_sql", """
SELECT event_id, CASE event_id % 5 WHEN 3 THEN 'no statement for ' || event_type
  ELSE 'SELECT * FROM events WHERE event_id = ' || CAST(event_id AS VARCHAR) END AS sql_text FROM events""")
def q_clean_sql(spark, d):
    """Model answers built from the events: a fenced statement after a sentence,
    a labelled one, a fence without a language, an answer without a statement,
    and a bare statement."""
    sql = F.concat(F.lit("SELECT * FROM events WHERE event_id = "), F.col("event_id").cast("string"))
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.concat(F.lit("Here it is:\n```sql\n"), sql, F.lit("\n```\n"))) \
        .when(kind == 1, F.concat(F.lit("sql "), sql)).when(kind == 2, F.concat(F.lit("```\n"), sql, F.lit("```"))) \
        .when(kind == 3, F.concat(F.lit(" no statement for "), "event_type")).otherwise(F.concat(F.lit("  "), sql, F.lit("\n")))
    return load(spark, d, "events").select("event_id", text.alias("text")).select("event_id", S.clean_sql("text").alias("sql_text"))


@query("sql_allowed", r"""
WITH a AS (SELECT conv_id, turn, upper(regexp_replace(regexp_replace(text,
    '''(?:[^''\\]|\\[\s\S])*''|"(?:[^"\\]|\\[\s\S])*"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS t FROM conversations)
SELECT conv_id, turn,
       COALESCE(regexp_matches(t, '^(SELECT|WITH)([^\p{L}\p{N}_]|$)') AND NOT contains(regexp_replace(t, ';[\s;]*$', ''), ';')
         AND NOT regexp_matches(t, '(^|[^\p{L}\p{N}_])(INSERT\s+(INTO|OVERWRITE|TABLE)|MERGE\s+INTO|DELETE\s+FROM|UPDATE\s+\S+\s+SET)([^\p{L}\p{N}_]|$)'), false) AS allowed
FROM a""")
def q_sql_allowed(spark, d):
    c = load(spark, d, "conversations")
    return c.select("conv_id", "turn", S.is_allowed_sql("text").alias("allowed"))


@query("parse_object", """
SELECT event_id, event_id % 3 <> 2 AS ok,
       CASE WHEN event_id % 3 <> 2 THEN '{"k":"' || json_extract_string(props, '$.k') || '"}' END AS value
FROM events""")
def q_parse_object(spark, d):
    """Model object output: fences removed, JSON parsed, error flag when bad
    (the JSON ``props`` of the events, bare, fenced, and broken)."""
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))) \
        .otherwise(F.concat(F.lit("Sure: "), "props"))
    e = load(spark, d, "events").select("event_id", text.alias("text"))
    return e.select("event_id", S.parse_object("text").alias("obj")).select(
        "event_id", F.col("obj.ok").alias("ok"), F.to_json("obj.value").alias("value"))


#: statements about a role, and what each is: a query or not, and the tables it reads
_STATEMENTS = [
    ("SELECT '{}; DROP TABLE t' AS a FROM sales", "read", "sales"), ("SELECTED '{}'", "error", ""),
    ("WITH c AS (SELECT '{}' AS a) INSERT INTO t SELECT a FROM c", "write", "t"), ("/* {} ; */ select turn from conversations;", "read", "conversations"),
    ("SELECT '{}'; DROP TABLE t", "error", ""), ("-- DELETE FROM t\nSELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE '{}' = lang", "read", "documents,labels"),
    ("DELETE FROM t WHERE role = '{}'", "write", "t"), ("WITH c AS (SELECT '{}' AS a) SELECT a, (SELECT max(x) FROM part) AS m FROM c", "read", "part"),
    ("select `a;b`, '{}' from nation", "read", "nation"), ("SELECT reflect('java.lang.System', 'exit', '{}') FROM region", "write", "region"),
]


@query("sql_gate", "WITH s(k, sql, kind, tables) AS (VALUES " + ", ".join(
    f"({i}, '{q.replace(chr(39), chr(39) * 2)}', '{kind}', '{t}')" for i, (q, kind, t) in enumerate(_STATEMENTS)) + """)
SELECT conv_id, turn, replace(sql, '{}', role) AS sql_text, kind, tables, kind = 'read' OR k = 9 AS looks_allowed
FROM conversations JOIN s ON k = (conv_id * 7 + turn) % 10""")
def q_sql_gate(spark, d):
    """Statements judged by the parser, each distinct text once, beside the
    lexical gate."""
    k = (F.col("conv_id") * 7 + F.col("turn")) % 10
    texts = F.element_at(F.array(*[F.lit(q) for q, _, _ in _STATEMENTS]), (k + 1).cast("int"))
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.replace(texts, F.lit("{}"), F.col("role")).alias("sql_text"))
    stripped = rows.withColumn("bare", F.regexp_replace("sql_text", ";[\\s;]*$", ""))
    parsed = parse_statements(spark, stripped, "bare").withColumnRenamed("sql_text", "bare")
    return stripped.join(parsed, "bare").select("conv_id", "turn", "sql_text", "kind", F.array_join("relations", ",").alias("tables"),
                                                S.is_allowed_sql("sql_text").alias("looks_allowed"))

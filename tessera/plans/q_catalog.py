"""Registered catalog-profiling and document-building queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import catalog as C
from tessera.operators.relational import union_all
from tessera.plans import index_build as IB
from tessera.plans.registry import attach_oracle, query
from tessera.session import scratch_path
from tessera.sources import merge as MG
from tessera.sources.writes import append_new_docs, upsert
from tessera.tables import load

# The lineitem columns, in schema order, and the ones profiled
# (text and integer columns).
LINEITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINEITEM_PROFILED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")


def _comments_values() -> str:
    rows = []
    for t, c, d in IB.COMMENTS:
        rows.append("('{}', {}, {})".format(t, "NULL" if c is None else f"'{c}'",
                                             "NULL" if d is None else "'" + d.replace("'", "''") + "'"))
    return "cm AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(table_name, column_name, comments))"


def _counts_sql() -> str:
    return "cnt AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS num_rows FROM {t}" for t in IB.CATALOG_TABLES) + ")"


@query("table_stats", "WITH " + _counts_sql() + " SELECT 'TPCH' AS owner, table_name, num_rows FROM cnt")
def q_table_stats(spark, d):
    return C.table_counts(IB.frames(spark, d))


@query("join_left", "WITH " + _counts_sql() + ", " + _comments_values() + """
SELECT c.table_name, c.num_rows, cm.comments AS table_comment
FROM cnt c LEFT JOIN (SELECT * FROM cm WHERE column_name IS NULL) cm ON cm.table_name = c.table_name""")
def q_join_left(spark, d):
    """Tables (row counts measured) ⟕ table comments on (owner, table_name)."""
    t = C.catalog_tables(C.table_counts(IB.frames(spark, d)), IB.comments_table(spark))
    return t.select("table_name", "num_rows", "table_comment")


def _profile_sql(table: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null, COUNT(DISTINCT {c}) AS n_distinct FROM {table}"
        for c in cols)


@query("join_using3", "WITH " + _comments_values() + ", prof AS (" + _profile_sql("lineitem", LINEITEM_COLUMNS) + """),
cols AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i + 1})" for i, c in enumerate(LINEITEM_COLUMNS)) + """) t(column_name, column_id))
SELECT 'lineitem' AS table_name, c.column_name, CAST(c.column_id AS INTEGER) AS column_id, cm.comments,
       p.n_null, p.n_distinct
FROM cols c JOIN prof p USING (column_name)
LEFT JOIN (SELECT * FROM cm WHERE table_name = 'lineitem') cm USING (column_name)""")
def q_join_using3(spark, d):
    """Column metadata ⟕ comments USING (owner, table_name, column_name),
    joined with the measured column profile on the same three keys."""
    li = load(spark, d, "lineitem")
    cols = C.catalog_columns(C.columns_of(spark, {"lineitem": li}), IB.comments_table(spark))
    prof = C.column_profile(li, "lineitem")
    j = cols.join(prof, ["owner", "table_name", "column_name"])
    return j.select("table_name", "column_name", "column_id", "comments", "n_null", "n_distinct")


@query("join_inner2", "WITH " + _counts_sql() + """,
cols AS (SELECT table_name AS tbl, column_name FROM information_schema.columns
         WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in IB.CATALOG_TABLES) + """))
SELECT c.table_name, c.num_rows, CAST(COUNT(*) AS BIGINT) AS n_columns
FROM cnt c JOIN cols k ON c.table_name = k.tbl GROUP BY c.table_name, c.num_rows""")
def q_join_inner2(spark, d):
    """tables ⋈ columns on differently named keys (table_name = tbl)."""
    fr = IB.frames(spark, d)
    t = C.table_counts(fr)
    cols = C.columns_of(spark, fr).select(F.col("table_name").alias("tbl"), "column_name")
    j = t.join(cols, t.table_name == cols.tbl)
    return j.groupBy("table_name", "num_rows").agg(F.count(F.lit(1)).alias("n_columns"))


@query("top_values", "WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM lineitem" for c in LINEITEM_PROFILED) + """),
c AS (SELECT column_name, value, COUNT(*) AS cnt FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT column_name, value, cnt, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank FROM c) WHERE rank <= 50""")
def q_top_values(spark, d):
    """Top-50 values per text/integer column of lineitem, one pass."""
    return C.top_values(load(spark, d, "lineitem"), 50)


@query("infer_keys", "WITH " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n, COUNT({c}) AS n_non_null, COUNT(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    .join(["s AS (", ")"]) + """
SELECT 'orders' AS table_name, column_name, n, n_non_null, n_distinct, n_non_null = n AND n_distinct = n AS is_unique FROM s""")
def q_infer_keys(spark, d):
    """Key candidates of orders: complete and distinct columns."""
    return C.infer_keys(load(spark, d, "orders"), "orders")


#: candidates with orphans: not every document has a label, nor every order an event
_BROKEN_FKS = (("documents", "doc_id", "labels", "doc_id"), ("orders", "o_orderkey", "events", "event_id"))


@query("infer_fk", " UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, "
    f"(SELECT COUNT(*) FROM {c} WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)) AS orphans"
    for c, cc, p, pc in (*IB.FK_CANDIDATES, *_BROKEN_FKS)))
def q_infer_fk(spark, d):
    """Inclusion test of every candidate foreign key (0 orphans → holds), and
    of two that don't hold."""
    fr = IB.frames(spark, d, (*IB.CATALOG_TABLES, "documents", "labels", "events"))
    parts = [C.infer_fk(fr[c], cc, fr[p], pc).select(F.lit(c).alias("child_table"), F.lit(cc).alias("child_column"),
                                                      F.lit(p).alias("parent_table"), "orphans")
             for c, cc, p, pc in (*IB.FK_CANDIDATES, *_BROKEN_FKS)]
    return union_all(*parts)


#: key-eligible columns of the tables that are searched for inclusions, by kind
_IND_COLUMNS = {
    "number": {"region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey", "supplier": "s_suppkey s_nationkey",
               "part": "p_partkey p_size", "orders": "o_orderkey o_custkey", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber",
               "documents": "doc_id n_chars", "labels": "doc_id quality toxic"},
    "text": {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type",
             "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "documents": "text lang source"},
}
_IND_CELLS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"
    for kind, tables in _IND_COLUMNS.items() for t, cols in tables.items() for c in cols.split())


@query("inclusion_deps", f"""
WITH v AS MATERIALIZED ({_IND_CELLS}),
d AS (SELECT kind, t, c, COUNT(*) AS nv, SUM(n) AS present FROM v GROUP BY ALL),
p AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, COUNT(*) AS shared FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, x.nv AS n_values, y.nv AS parent_values, y.nv = y.present AS parent_unique
FROM p JOIN d x ON x.t = ct AND x.c = cc JOIN d y ON y.t = pt AND y.c = pc WHERE shared = x.nv""")
def q_inclusion_deps(spark, d):
    """All inclusion dependencies between the key-eligible columns of nine tables."""
    return C.inclusion_dependencies(IB.frames(spark, d, (*IB.CATALOG_TABLES, "documents", "labels")))


# The schemas of the indexed tables (column, Spark type name),
# in column order, as read by the catalog snapshot.
CATALOG_SCHEMA = {
    "region": [("r_regionkey", "INT"), ("r_name", "STRING")],
    "nation": [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"),
                 ("c_mktsegment", "STRING")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "STRING"), ("s_nationkey", "INT"), ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INT"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "STRING"),
               ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP_NTZ"), ("o_orderpriority", "STRING")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"), ("l_linenumber", "INT"),
                 ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"),
                 ("l_tax", "DOUBLE"), ("l_returnflag", "STRING"), ("l_linestatus", "STRING"),
                 ("l_shipdate", "TIMESTAMP_NTZ")],
}

_TYPE_MAP = """CASE WHEN data_type = 'INTEGER' THEN 'INT' WHEN data_type = 'VARCHAR' THEN 'STRING'
                WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP_NTZ' ELSE data_type END"""

_NULLS_SQL = "nl AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count({c}) AS k FROM {t}" for t, cols in CATALOG_SCHEMA.items() for c, _ in cols) + ")"

_CATCOLS_SQL = _comments_values() + ",\n" + _NULLS_SQL + f""",
ic AS (SELECT table_name, column_name, {_TYPE_MAP} AS data_type, CAST(ordinal_position AS INTEGER) AS column_id
       FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in IB.CATALOG_TABLES) + """)),
cc AS (SELECT 'TPCH' AS owner, ic.table_name, ic.column_name, ic.data_type, CAST(NULL AS INTEGER) AS data_length,
              CAST(NULL AS INTEGER) AS data_precision,
              CASE WHEN ic.data_type IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 0 END AS data_scale,
              CASE WHEN nl.n > 0 AND nl.n = nl.k THEN 'N' ELSE 'Y' END AS nullable, ic.column_id, cm.comments
       FROM ic JOIN nl ON nl.t = ic.table_name AND nl.c = ic.column_name
       LEFT JOIN cm ON cm.table_name = ic.table_name AND cm.column_name = ic.column_name)"""


@query("catalog_columns", "WITH " + _CATCOLS_SQL + " SELECT * FROM cc")
def q_catalog_columns(spark, d):
    """Catalog snapshot: column metadata with comments for every indexed table."""
    return IB.snapshot(spark, d)["columns"]


@query("table_cards")
def q_table_cards(spark, d):
    """One card per table: rows, comment, typed columns with top values, keys."""
    s = IB.snapshot(spark, d)
    return C.table_cards(s["tables"], s["columns"], s["constraints"], s["indexes"], s["samples"])


@query("column_docs")
def q_column_docs(spark, d):
    s = IB.snapshot(spark, d)
    return union_all(C.column_docs(s["columns"]).select("table_name", F.col("doc").alias("body")),
                     C.view_cards(s["views"]).select("table_name", "body"),
                     C.rel_cards(s["constraints"]).select("table_name", "body"))


@query("ddl_docs", "WITH " + _CATCOLS_SQL + """
SELECT owner, table_name, 'TABLE' AS object_type,
       'CREATE TABLE ' || owner || '.' || table_name || ' (' || chr(10)
       || string_agg('  ' || column_name || ' ' || data_type || CASE WHEN nullable = 'N' THEN ' NOT NULL' ELSE '' END,
                  ',' || chr(10) ORDER BY column_id) || chr(10) || ')' AS ddl
FROM cc GROUP BY owner, table_name""")
def q_ddl_docs(spark, d):
    return C.ddl_docs(IB.snapshot(spark, d)["columns"])


@query("schema_context", "WITH " + _CATCOLS_SQL + """
SELECT owner, table_name,
       string_agg('- ' || column_name || ' (' || data_type || '): ' || COALESCE(comments, 'No description'),
                  chr(10) ORDER BY column_id) AS context
FROM cc WHERE table_name IN (SELECT t FROM nl WHERE n > 0) GROUP BY owner, table_name""")
def q_schema_context(spark, d):
    """Context lines of every table that has rows (measured)."""
    s = IB.snapshot(spark, d)
    filled = s["tables"].where("num_rows > 0").select("owner", "table_name")
    return C.schema_context(s["columns"].join(filled, ["owner", "table_name"], "left_semi"))


@query("ddl_excerpt")
def q_ddl_excerpt(spark, d):
    """DDL of one table and the first-20 excerpt of the owner."""
    ddl = C.ddl_docs(IB.snapshot(spark, d)["columns"])
    return C.ddl_excerpt(ddl, "tpch", "lineitem").withColumn("scope", F.lit("lineitem")).unionByName(
        C.ddl_excerpt(ddl, "tpch").withColumn("scope", F.lit("owner")))


@query("union_docs")
def q_union_docs(spark, d):
    """TABLE, VIEW and REL documents of the catalog, unioned."""
    docs = IB.documents(spark, IB.snapshot(spark, d))
    return docs.select("doc_type", "source_name", "title", X.content_hash("body").alias("hash"),
                       F.length("body").alias("n_chars"))


@query("index_build")
def q_index_build(spark, d):
    """Catalog documents deduplicated, chunked and embedded."""
    return IB.build_index(spark, d).select("doc_id", "doc_type", "source_name", "chunk_ix", "tokens",
                                           F.size("embedding").alias("dim"))


@query("dedupe_docs", """
WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents),
f AS (SELECT min(doc_id) AS doc_id, h FROM b GROUP BY h)
SELECT doc_id, h AS hash FROM f WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def q_dedupe_docs(spark, d):
    """Insert-if-absent by content hash: all documents offered to a store that
    already holds the English ones; one row per new hash."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    store = load(spark, d, "documents").where(F.col("lang") == "en").select(X.content_hash("text").alias("hash"))
    return append_new_docs(store, docs).select("doc_id", "hash")


@query("upsert_by_key", """
WITH upd AS (SELECT d.doc_id, d.text || ' [quality=' || CAST(l.quality AS VARCHAR) || ']' AS text
             FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM upd)
      UNION ALL SELECT doc_id, text FROM upd)
SELECT doc_id, sha256(text) AS hash FROM t""")
def q_upsert(spark, d):
    """Documents upserted by ``doc_id`` with their labelled revisions."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    lab = load(spark, d, "labels")
    upd = docs.join(lab, "doc_id").select(
        "doc_id", F.concat("text", F.lit(" [quality="), F.col("quality").cast("string"), F.lit("]")).alias("text"))
    return upsert(docs, upd, "doc_id").select("doc_id", X.content_hash("text").alias("hash"))


@query("merge_commits", """
WITH upd AS (SELECT d.doc_id, d.text || ' [quality=' || CAST(l.quality AS VARCHAR) || ']' AS text
             FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM upd)
      UNION ALL SELECT doc_id, text FROM upd)
SELECT doc_id, sha256(text) AS hash FROM t WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT -1 - doc_id, sha256(text) FROM documents""")
def q_merge_commits(spark, d):
    """A keyed table of the documents after three commits: labelled revisions
    merged, toxic documents deleted, every document added under a new key; earlier
    versions are removed after each."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    lab = load(spark, d, "labels")
    path = scratch_path(spark, f"merge-{uuid.uuid4().hex[:12]}")
    MG.create(docs, path, "doc_id")
    MG.merge(docs.join(lab, "doc_id").select(
        "doc_id", F.concat("text", F.lit(" [quality="), F.col("quality").cast("string"), F.lit("]")).alias("text")), path)
    MG.vacuum(spark, path)
    MG.delete(lab.where("toxic = 1").select("doc_id"), path)
    MG.vacuum(spark, path)
    MG.insert_absent(docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"), path)
    MG.vacuum(spark, path)
    return MG.read(spark, path).select("doc_id", X.content_hash("text").alias("hash"))


# ---------------------------------------------------------------------------
# SQL form of the catalog documents (table, view and relationship cards)
# ---------------------------------------------------------------------------

_PROFILED_TYPES = ("INT", "BIGINT", "STRING")


def _cards_ctes() -> str:
    top = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1, 2, 3"
        for t, cols in CATALOG_SCHEMA.items() for c, ty in cols if ty in _PROFILED_TYPES)
    uq = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c FROM (SELECT COUNT(*) AS n, COUNT({c}) AS nn, COUNT(DISTINCT {c}) AS d FROM {t}) "
        f"WHERE n > 0 AND nn = n AND d = n"
        for t, cols in CATALOG_SCHEMA.items() for c, ty in cols if ty in _PROFILED_TYPES)
    fk = " UNION ALL ".join(
        f"SELECT '{c}' AS t, '{cc}' AS c, '{p}' AS parent FROM (SELECT COUNT(*) AS o FROM {c} WHERE {cc} IS NOT NULL "
        f"AND {cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)) WHERE o = 0"
        for c, cc, p, pc in IB.FK_CANDIDATES)
    return _counts_sql() + ",\n" + _CATCOLS_SQL + f""",
tv AS ({top}),
top5 AS (SELECT t, c, string_agg(v || '×' || CAST(n AS VARCHAR), ', ' ORDER BY rk) AS top
         FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY n DESC, v) AS rk FROM tv) WHERE rk <= 5
         GROUP BY t, c),
uq AS ({uq}),
fk AS ({fk}),
coltext AS (
  SELECT cc.table_name, string_agg('- ' || cc.column_name || ' ' || cc.data_type || ' NULLABLE=' || cc.nullable
         || CASE WHEN cc.comments IS NOT NULL AND cc.comments <> '' THEN ' — ' || cc.comments ELSE '' END
         || CASE WHEN top5.top IS NOT NULL THEN ' | top values: ' || top5.top ELSE '' END,
         chr(10) ORDER BY cc.column_id) AS col_text
  FROM cc LEFT JOIN top5 ON top5.t = cc.table_name AND top5.c = cc.column_name GROUP BY cc.table_name),
pk AS (SELECT t, string_agg('- PK_' || upper(t) || ' (' || c || ')', chr(10) ORDER BY c) AS pk FROM uq GROUP BY t),
fkl AS (SELECT t, string_agg('- FK_' || upper(t) || '_' || upper(c) || ' (' || c || ') → ref PK_' || upper(parent),
                             chr(10) ORDER BY 'FK_' || upper(t) || '_' || upper(c)) AS fk,
               string_agg('- FK_' || upper(t) || '_' || upper(c) || ': ' || t || '.' || c || ' → PK_' || upper(parent),
                          chr(10) ORDER BY 'FK_' || upper(t) || '_' || upper(c)) AS rel
        FROM fk GROUP BY t),
cards AS (
  SELECT 'TPCH' AS owner, cnt.table_name, 'Table ' || cnt.table_name || ' (owner TPCH)' AS title,
         concat_ws(chr(10), 'Table: ' || cnt.table_name || ' (Owner: TPCH)', 'Rows (stats): ' || CAST(cnt.num_rows AS VARCHAR),
                   'Comment: ' || COALESCE(NULLIF(tc.comments, ''), '—'), 'Columns:', ct.col_text,
                   CASE WHEN pk.pk IS NOT NULL THEN 'Primary keys:' || chr(10) || pk.pk END,
                   CASE WHEN fkl.fk IS NOT NULL THEN 'Foreign keys:' || chr(10) || fkl.fk END) AS body
  FROM cnt LEFT JOIN (SELECT * FROM cm WHERE column_name IS NULL) tc ON tc.table_name = cnt.table_name
  LEFT JOIN coltext ct ON ct.table_name = cnt.table_name LEFT JOIN pk ON pk.t = cnt.table_name
  LEFT JOIN fkl ON fkl.t = cnt.table_name),
views AS (SELECT * FROM (VALUES ('SALES', 'Sales star: one row per order line', {_sqlq(IB.sqlviews.SALES_CTE.strip())}),
                                ('RISK_SENSITIVITIES', NULL, {_sqlq(IB.sqlviews.RISK_CTE.strip())})) v(view_name, view_comment, view_text)),
docs AS (
  SELECT 'TABLE' AS doc_type, table_name AS source_name, title, body FROM cards
  UNION ALL
  SELECT 'VIEW', view_name, 'View ' || view_name || ' (owner TPCH)',
         'View: ' || view_name || chr(10) || 'Comment: ' || COALESCE(NULLIF(view_comment, ''), '—') || chr(10)
         || 'SQL:' || chr(10) || view_text FROM views
  UNION ALL
  SELECT 'REL', t, 'Relationships for ' || t, 'Relationships for ' || t || ':' || chr(10) || rel FROM fkl)"""


def _sqlq(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Oracles of the card-based queries (defined above) use the SQL form of the cards.
from tessera.plans.q_text import smart_chunks_sql  # noqa: E402

attach_oracle("table_cards", "WITH " + _cards_ctes() + " SELECT owner, table_name, title, body FROM cards")
attach_oracle("union_docs", "WITH " + _cards_ctes() + """
SELECT doc_type, source_name, title, sha256(body) AS hash, CAST(length(body) AS INTEGER) AS n_chars FROM docs""")
attach_oracle("index_build", "WITH RECURSIVE " + _cards_ctes() + """,
docs2 AS (SELECT sha256(body) AS doc_id, doc_type, source_name, body FROM docs),""" + smart_chunks_sql("docs2", "doc_id", "body") + """
SELECT c.doc_id, d.doc_type, d.source_name, c.chunk_ix, CAST(floor(length(c.content) / 4) AS INTEGER) AS tokens,
       256 AS dim
FROM chunks c JOIN docs2 d ON d.doc_id = c.doc_id""")
attach_oracle("column_docs", "WITH " + _cards_ctes() + """
SELECT table_name, table_name || '.' || column_name || ': ' || data_type
       || CASE WHEN comments IS NOT NULL THEN ' — ' || comments ELSE '' END AS body FROM cc
UNION ALL SELECT view_name, 'View: ' || view_name || chr(10) || 'Comment: ' || COALESCE(NULLIF(view_comment, ''), '—')
       || chr(10) || 'SQL:' || chr(10) || view_text FROM views
UNION ALL SELECT t, 'Relationships for ' || t || ':' || chr(10) || rel FROM fkl""")

_DDL_SQL = """
ddl AS (SELECT owner, table_name, 'CREATE TABLE ' || owner || '.' || table_name || ' (' || chr(10)
               || string_agg('  ' || column_name || ' ' || data_type || CASE WHEN nullable = 'N' THEN ' NOT NULL' ELSE '' END,
                  ',' || chr(10) ORDER BY column_id) || chr(10) || ')' AS ddl
        FROM cc GROUP BY owner, table_name)"""

attach_oracle("ddl_excerpt", "WITH " + _CATCOLS_SQL + "," + _DDL_SQL + """
SELECT COALESCE(string_agg(ddl, chr(10) ORDER BY table_name), '') AS excerpt, 'lineitem' AS scope
FROM ddl WHERE upper(owner) = 'TPCH' AND upper(table_name) = 'LINEITEM'
UNION ALL
SELECT COALESCE(string_agg(ddl, chr(10) ORDER BY table_name), ''), 'owner'
FROM (SELECT * FROM ddl WHERE upper(owner) = 'TPCH' ORDER BY table_name LIMIT 20)""")

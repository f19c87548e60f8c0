"""Text functions: expected values worked out from the original rules."""

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import sqltext as S


def test_smart_chunk_fixture_boundaries():
    text = "aaaa bbbb. " * 200
    bounds = X.smart_chunk_bounds(text, 350, 40, compat=True)
    # raw windows start at 0, 1395, 2198; the last chunk is ". " stripped to "."
    assert [b[0] for b in bounds] == [0, 1395, 2198]
    assert text[bounds[-1][0]:bounds[-1][1]] == "."


def test_smart_chunk_empty_and_properties():
    assert X.smart_chunk_bounds("", 350, 40) == []
    text = ("Word " * 50 + ". ") * 60
    b = X.smart_chunk_bounds(text, 350, 40, compat=True)
    # compat chunks are substrings, in order, non-overlapping
    assert all(b[i][1] <= b[i + 1][0] for i in range(len(b) - 1))
    assert all(text[s:e] == text[s:e].strip() for s, e in b)
    # overlap mode advances and overlaps the previous chunk
    b2 = X.smart_chunk_bounds(text, 350, 40, compat=False)
    assert len(b2) >= len(b)
    assert all(b2[i + 1][0] > b2[i][0] for i in range(len(b2) - 1))


def test_smart_chunks_dataframe(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb. " * 200), (2, ""), (3, None)], "doc_id long, text string")
    rows = X.smart_chunks(df).orderBy("doc_id", "chunk_ix").collect()
    assert [(r.doc_id, r.chunk_ix, r.chunk_start) for r in rows] == [(1, 0, 0), (1, 1, 1395), (1, 2, 2198)]
    assert rows[2].content == "." and rows[0].tokens == len(rows[0].content) // 4


def test_word_chunk_rules():
    assert X.word_chunk("x" * 600) == ["", "x" * 600]
    assert X.word_chunk("") == []
    words = " ".join(["abc"] * 300)
    chunks = X.word_chunk(words, 512)
    assert all(len(c) <= 511 for c in chunks)
    assert " ".join(chunks).split() == words.split()


def test_visible_text():
    html = ("<html><head><title>t</title></head><body><!-- c --><p>a <b>b</b></p>"
            "<script>x</script></body></html>")
    assert X.visible_text(html) == "a\nb"


def test_parse_list_and_json_list(spark):
    df = spark.createDataFrame([('["a","b"]',), ("- a\n• b",), ("1\n2\n3\n4\n5\n6\n7",)], "t string")
    got = [r.l for r in df.select(S.parse_list("t").alias("l")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["1", "2", "3", "4", "5"]]
    j = spark.createDataFrame([('["x"]',), ("{bad",), (None,)], "t string")
    assert [r.n for r in j.select(F.size(S.safe_json_list("t")).alias("n")).collect()] == [1, 0, 0]


def test_sql_gate_and_cleanup(spark):
    df = spark.createDataFrame([("select 1",), (" WITH x AS (SELECT 1) SELECT * FROM x",), ("delete from t",),
                                ("",), ("SELECT 1; DROP TABLE t",), ("SELECT 1;",)], "t string")
    assert [r.a for r in df.select(S.is_allowed_sql("t").alias("a")).collect()] == \
        [True, True, False, False, False, True]
    fenced = spark.createDataFrame([("Here:\n```sql\nSELECT a FROM t\n```",), ("sql SELECT 2",)], "t string")
    assert [r.s for r in fenced.select(S.clean_sql("t").alias("s")).collect()] == ["SELECT a FROM t", "SELECT 2"]


def test_synonyms(spark):
    df = spark.createDataFrame([("Show all orders",), ("nothing here",)], "q string")
    got = [r.v for r in df.select(S.expand_synonyms("q", 5).alias("v")).collect()]
    assert got[0] == ["Show all orders", "Show all purchases", "Show all transactions", "Show all sales",
                      "list all orders"]
    assert got[1] == ["nothing here"]


def test_parse_object(spark):
    df = spark.createDataFrame([('```json\n{"a": "1"}\n```',), ("{bad",)], "t string")
    rows = df.select(S.parse_object("t").alias("o")).collect()
    assert rows[0].o.ok and rows[0].o.value == {"a": "1"}
    assert not rows[1].o.ok


def test_sql_gate_reads_past_literals_and_comments(spark):
    texts = [("SELECTED a FROM t", False), ("SELECT ';' AS a", True), ("SELECT `;` FROM t -- ; DROP", True), ("/* DELETE FROM t; */ WITH c AS (SELECT 1) SELECT * FROM c;;", True),
             ("WITH c AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM c", False), ("SELECT 'insert into' AS a", True), ("SELECT 1 ; SELECT 2", False), (None, False),
             ("SELECT 'it\\'s; fine'", True), ("SELECT '" + "x" * 100_000 + ";'", True), ("SELECT * FROM t WHERE a = 'open ; SELECT", False)]
    df = spark.createDataFrame(texts, "t string, want boolean")
    assert df.where(S.is_allowed_sql("t") != F.col("want")).collect() == []


def test_statements_by_the_parser(spark):
    from tessera.operators import evaluate as E

    def kind(sql):
        return E.parse_statement(spark, sql)[1:]

    assert kind("WITH c AS (SELECT a FROM t) SELECT c.a, (SELECT max(b) FROM u) FROM c WHERE a IN (SELECT z FROM v)") == ("read", ["t", "u", "v"], ["a", "b", "c.a", "z"])
    assert kind("CREATE TABLE x (a INT)")[0] == kind("SET a = 1")[0] == kind("SHOW TABLES")[0] == "write"
    assert kind("SELECT TRANSFORM(a) USING 'cat' AS b FROM t")[0] == "write"
    assert kind("nonsense")[0] == kind("")[0] == "error"
    got = E.safe_exec(spark, "CREATE TABLE never_made (a INT)")
    assert got[1] is False and "only queries" in got[6] and not spark.catalog.tableExists("never_made")

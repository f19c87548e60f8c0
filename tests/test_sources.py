"""Readers, sinks and table maintenance."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import ndjson as J
from tessera.sources import querylog as L
from tessera.sources import readers as RD
from tessera.sources import writes as W

# Three records in the request-log format (header, intent, SQL), preceded by a
# separator, as the writer produces them.
LOG = ("\n---\n[2025-08-20 11:58:54] IP: 127.0.0.1, UA: curl/8.7.1, Model: llama3\n"
       "Intent: list all sales\nSQL: SELECT * FROM sales\n"
       "\n---\n[2025-08-20 12:01:02] IP: 127.0.0.1, UA: Mozilla/5.0 (X11, Linux), Model: llama3\n"
       "Intent: list all sales\nSQL: SELECT * FROM sales\n"
       "\n---\n[2025-08-20 13:06:29] IP: 10.0.0.2, UA: curl/8.7.1, Model: mistral\n"
       "Prompt: employee count\nGenerated SQL: SELECT COUNT(*) AS employee_count FROM employees\n")


def test_ndjson_split(spark):
    lines = spark.createDataFrame([('{"a":1}',), ('[{"a":2},{"a":3}]',), ("5",), ('{"_narration":"n"}',),
                                   ("{bad",), ("   ",)], "value string")
    rows, narr, err = J.parse_ndjson(lines)
    got = sorted(json.loads(r.json).get("a", json.loads(r.json).get("data")) for r in rows.collect())
    assert got == [1, 2, 3, 5]
    assert [r.narration for r in narr.collect()] == ["n"]
    assert [r.line for r in err.collect()] == ["{bad"]


def test_ndjson_and_csv_lines(spark):
    import datetime as dt
    from decimal import Decimal
    df = spark.createDataFrame([(1, dt.date(2025, 7, 1), Decimal("2.50"), 'say "hi"', None)],
                               "id long, d date, amt decimal(10,2), s string, n string")
    assert J.ndjson_lines(df).first().value == '{"id":1,"d":"2025-07-01","amt":2.5,"s":"say \\"hi\\"","n":null}'
    assert J.csv_lines(df).first().value == '1,"2025-07-01",2.50,"say \\"hi\\"",""'
    assert J.csv_header(df) == "id,d,amt,s,n"


def test_query_log_reader(spark):
    d = tempfile.mkdtemp(prefix="qlog-")
    with open(os.path.join(d, "requests.log"), "w") as f:
        f.write(LOG)
    log = L.read_query_log(spark, d).orderBy("ts").collect()
    assert len(log) == 3
    assert log[0].intent == "list all sales" and log[0].sql == "SELECT * FROM sales"
    assert log[1].user_agent == "Mozilla/5.0 (X11, Linux)"
    assert log[2].intent == "employee count" and log[2].model == "mistral"
    usage = {(r.intent, r.model): r.requests for r in L.log_usage(L.read_query_log(spark, d)).collect()}
    assert usage[("list all sales", "llama3")] == 2


def test_source_registry(spark, sf):
    reg = RD.demo_registry(spark, sf)
    assert RD.load_source(spark, reg, "parquet").count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
    for bad in ("mongo", "nothing"):
        try:
            RD.load_source(spark, reg, bad)
            raise AssertionError("expected an error")
        except RD.SourceError:
            pass


def test_upsert_and_dedupe(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted((r.k, r.v) for r in W.upsert(t, u, "k").collect()) == [(1, "a"), (2, "B"), (3, "C")]
    store = spark.createDataFrame([("x",)], "text string").select(F.sha2("text", 256).alias("hash"))
    docs = spark.createDataFrame([(5, "x"), (7, "y"), (6, "y")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in W.append_new_docs(store, docs).collect()] == [(6, "y")]


def test_replace_slice_and_staged_write(spark):
    base = tempfile.mkdtemp(prefix="slice-") + "/t"
    spark.createDataFrame([("A", 1), ("B", 2)], "owner string, v int").write.partitionBy("owner").parquet(base)
    W.replace_slice(spark.createDataFrame([("A", 9)], "owner string, v int"), base, "owner")
    got = sorted((r.owner, r.v) for r in spark.read.parquet(base).collect())
    assert got == [("A", 9), ("B", 2)]
    p = W.write_staged(spark.range(3), spark, "staged")
    assert spark.read.parquet(p).count() == 3


class _FakeReader:
    """Records the options a JDBC read would use (no database here)."""

    def __init__(self):
        self.fmt, self.opts = None, {}

    def format(self, f):
        self.fmt = f
        return self

    def options(self, **kw):
        self.opts.update(kw)
        return self

    def option(self, k, v):
        self.opts[k] = v
        return self

    def load(self):
        return ("loaded", self.fmt, dict(self.opts))


class _FakeSpark:
    def __init__(self):
        self.read = _FakeReader()


def test_jdbc_reader_options():
    got = RD.read_jdbc(_FakeSpark(), {"url": "jdbc:x://h/db", "user": "u"}, query="SELECT * FROM sales")
    assert got == ("loaded", "jdbc", {"url": "jdbc:x://h/db", "user": "u", "query": "SELECT * FROM sales"})
    got = RD.read_jdbc(_FakeSpark(), {"url": "jdbc:x://h/db"}, query="SELECT * FROM sales",
                       partition_column="sale_id", lower=1, upper=1000, num_partitions=16)
    opts = got[2]
    assert opts["dbtable"] == "(SELECT * FROM sales) q" and opts["partitionColumn"] == "sale_id"
    assert (opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("1", "1000", "16")


def test_csv_and_ndjson_writers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    base = tempfile.mkdtemp(prefix="sinks-")
    J.to_csv(df, base + "/csv")
    back = spark.read.csv(base + "/csv", header=True, escape="\\")
    assert back.columns == ["id", "s"] and back.count() == df.count()
    assert {r.value for r in spark.read.text(base + "/csv").collect()} == {"id,s", '1,"a"', '2,""'}
    J.to_csv(df.where("id > 5"), base + "/none")
    assert spark.read.csv(base + "/none", header=True).columns == ["id", "s"]
    J.to_ndjson(df, base + "/nd")
    assert sorted(r.value for r in spark.read.text(base + "/nd").collect()) == ['{"id":1,"s":"a"}', '{"id":2,"s":null}']


def test_ndjson_keeps_nulls_and_fractions(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) a, 1 b, TIMESTAMP'2024-01-01 00:00:00.123456' t, TIMESTAMP'2024-01-01 00:00:00' u")
    assert J.ndjson_lines(df).first().value == '{"a":null,"b":1,"t":"2024-01-01T00:00:00.123456","u":"2024-01-01T00:00:00"}'

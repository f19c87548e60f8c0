"""NDJSON and CSV: reader with row/narration/error split, line sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_ndjson(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split JSON lines into (rows, narration, errors).

    * a line holding an array contributes one row per element;
    * an object is one row; an object with ``_narration`` goes to narration;
    * a scalar ``s`` becomes the row ``{"data": s}``;
    * a line that is not JSON is an error row (the original stopped reading
      the batch there); blank lines are skipped.
    Rows are returned as ``json`` text (``VARIANT`` rendered by ``to_json``)
    plus ``row`` (the variant itself) so callers can ``variant_get`` fields.
    """
    parsed = lines.where(F.length(F.trim(F.col(col))) > 0).select(*keep, F.col(col).alias("line"), F.try_parse_json(F.col(col)).alias("v"))
    kind = F.schema_of_variant("v")
    narr = F.when(kind.startswith("OBJECT"), F.try_variant_get("v", "$._narration", "string"))
    items = F.try_variant_get("v", "$", "array<variant>")
    scalar = F.parse_json(F.to_json(F.named_struct(F.lit("data"), F.col("v"))))
    # one pass: each line carries its kind and the array of its rows
    lines_of = parsed.select(
        *keep, "line",
        F.when(F.col("v").isNull(), "error").when(narr.isNotNull(), "narration").otherwise("row").alias("kind"),
        narr.alias("narration"),
        F.when(items.isNotNull(), items).when(kind.startswith("OBJECT"), F.array("v")).otherwise(F.array(scalar)).alias("rows"))
    errors = lines_of.where("kind = 'error'").select(*keep, "line")
    narration = lines_of.where("kind = 'narration'").select(*keep, "narration")
    rows = lines_of.where("kind = 'row'").select(*keep, F.explode("rows").alias("row"))
    return rows.withColumn("json", F.to_json("row")), narration, errors


def read_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_ndjson(spark.read.text(path), "value")


def ndjson_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row: dates and timestamps as ISO-8601 text (a fraction
    of a second is written where there is one), decimals as floats, null fields
    kept, everything else as is."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            exact = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            c = F.when(exact.endswith(".000000"), whole).otherwise(exact)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def to_ndjson(df: DataFrame, path: str) -> None:
    ndjson_lines(df).write.mode("errorifexists").text(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """CSV body lines: strings JSON-quoted (``\\"`` escapes), numbers bare,
    null → ``""``; columns in frame order."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                                   T.DoubleType, T.DecimalType, T.BooleanType)):
            cell = c.cast("string")
        else:
            cell = F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
        cells.append(F.when(c.isNull(), F.lit('""')).otherwise(cell))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV files that any reader opens with ``header=True``: every part file
    starts with the header line, so parts are written by all tasks at once."""
    body = csv_lines(df)
    header = csv_header(df)

    def with_header(batches):
        first = True
        for b in batches:
            lines = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [header, *lines] if first else lines})
            first = False
        if first:
            yield pa.RecordBatch.from_pydict({"value": [header]})

    body.mapInArrow(with_header, "value string").write.mode("errorifexists").text(path)

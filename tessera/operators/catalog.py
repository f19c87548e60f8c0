"""Catalog profiling and document building.

A catalog snapshot is a set of small DataFrames keyed by ``(owner,
table_name)``: tables (with row counts measured from the data), columns
(from each table's schema), constraints, indexes and views.  Value profiles
come from one count per value of each column; every per-table text (cards, DDL,
schema context) is assembled with ``collect_list`` of that table's column
rows — bounded by the number of columns, never by the number of data rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.tables import load

OWNER = "TPCH"

# Formats of the catalog documents ({name} = a column value).
MISSING = "—"
CARD_TITLE = "Table {table} (owner {owner})"
CARD_HEADER = "Table: {table} (Owner: {owner})"
CARD_ROWS = "Rows (stats): {rows}"
CARD_COMMENT = "Comment: {comment}"
CARD_COLUMNS = "Columns:"
COLUMN_LINE = "- {name} {type} NULLABLE={nullable}"
COLUMN_COMMENT = " — {comment}"
COLUMN_TOP = " | top values: {top}"
TOP_ITEM = "{value}×{count}"
PK_HEADER = "Primary keys:"
PK_LINE = "- {name} ({column})"
FK_HEADER = "Foreign keys:"
FK_LINE = "- {name} ({column}) → ref {ref}"
IX_HEADER = "Indexes:"
IX_LINE = "- {name} on ({columns})"
VIEW_TITLE = "View {view} (owner {owner})"
VIEW_BODY = "View: {view}\nComment: {comment}\nSQL:\n{sql}"
REL_TITLE = "Relationships for {table}"
REL_HEADER = "Relationships for {table}:"
REL_LINE = "- {name}: {table}.{column} → {ref}"
CONTEXT_LINE = "- {column} ({type}): {description}"
NO_DESCRIPTION = "No description"


def fmt(template: str, **values) -> F.Column:
    """``concat`` of a fixed format with its ``{name}`` placeholders filled
    by the given columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if i % 2 == 1 or p])

COLUMN_SCHEMA = ("owner string, table_name string, column_name string, data_type string, "
                 "data_length int, data_precision int, data_scale int, nullable string, column_id int")
CONSTRAINT_SCHEMA = ("owner string, table_name string, constraint_name string, constraint_type string, "
                     "column_name string, position int, r_constraint_name string")
INDEX_SCHEMA = "owner string, table_name string, index_name string, column_name string, column_position int"
COMMENT_SCHEMA = "owner string, table_name string, column_name string, comments string"


def _type_info(dt: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """(type name, length, precision, scale) in catalog terms."""
    if isinstance(dt, T.DecimalType):
        return "DECIMAL", None, dt.precision, dt.scale
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return dt.simpleString().upper(), None, None, 0
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return dt.simpleString().upper(), None, None, None
    if isinstance(dt, T.StringType):
        return "STRING", None, None, None
    return dt.simpleString().upper(), None, None, None


def columns_of(spark: SparkSession, frames: dict[str, DataFrame], owner: str = OWNER) -> DataFrame:
    """Column metadata from the schemas (driver-side metadata, no data read)."""
    rows = []
    for t, df in frames.items():
        for pos, f in enumerate(df.schema.fields, start=1):
            name, length, prec, scale = _type_info(f.dataType)
            rows.append((owner, t, f.name, name, length, prec, scale, "Y" if f.nullable else "N", pos))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def measured_columns(spark: SparkSession, frames: dict[str, DataFrame], owner: str = OWNER) -> DataFrame:
    """:func:`columns_of` with ``nullable`` measured from the rows: ``N`` where
    a table has rows and none is null.  One scan and one aggregate row per
    table, all in one lazy plan."""
    parts = []
    for t, df in frames.items():
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("present")) for i, c in enumerate(df.columns)])
        parts.append(counts.select("n", F.explode(pairs).alias("p")).select(
            F.lit(t).alias("table_name"), "p.column_name", ((F.col("n") > 0) & (F.col("n") == F.col("p.present"))).alias("full")))
    full = reduce(lambda a, b: a.unionByName(b), parts)
    cols = columns_of(spark, frames, owner)
    return cols.join(full, ["table_name", "column_name"], "left") \
        .withColumn("nullable", F.when(F.col("full"), "N").otherwise("Y")).select(*cols.columns)


def table_counts(frames: dict[str, DataFrame], owner: str = OWNER) -> DataFrame:
    """Row count of every table, measured: one aggregate per table, unioned
    into a single job."""
    parts = [df.agg(F.count(F.lit(1)).alias("num_rows"))
               .select(F.lit(owner).alias("owner"), F.lit(t).alias("table_name"), "num_rows")
             for t, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def catalog_tables(counts: DataFrame, comments: DataFrame) -> DataFrame:
    """tables ⟕ table comments on (owner, table_name)."""
    tc = comments.where(F.col("column_name").isNull()).select("owner", "table_name",
                                                             F.col("comments").alias("table_comment"))
    return counts.join(tc, ["owner", "table_name"], "left")


def catalog_columns(cols: DataFrame, comments: DataFrame) -> DataFrame:
    """columns ⟕ column comments USING (owner, table_name, column_name)."""
    cc = comments.where(F.col("column_name").isNotNull())
    return cols.join(cc, ["owner", "table_name", "column_name"], "left")


# ---------------------------------------------------------------------------
# Value profiles
# ---------------------------------------------------------------------------


def profiled_columns(df: DataFrame) -> list[str]:
    """Text columns and integer-scale number columns."""
    ok = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ok) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0):
            out.append(f.name)
    return out


def value_counts(df: DataFrame, column: str, text: bool = False) -> DataFrame:
    """``value`` and ``rows`` for every value of a column (as text if asked),
    null among them: a scan of that column and a partial count per value before
    the shuffle.  Top values, key test and inclusion test of a column begin with
    this same plan, so that Spark scans, counts and shuffles it once."""
    value = F.col(column).cast("string") if text else F.col(column)
    return df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


def top_values(df: DataFrame, limit: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Top-``limit`` values with counts for every profiled column, nulls
    excluded, ties by value text.  Each column has its :func:`value_counts`;
    their per-column ``row_number() <= limit`` is planned with a partial group
    limit."""
    cols = columns or profiled_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, cnt long, rank int")
    plain = profiled_columns(df)
    counts = [value_counts(df, c, text=c not in plain).select(F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), F.col("rows").alias("cnt"))
              for c in cols]
    # null is ranked last and left out afterwards: a condition before the counts would give them another plan
    w = Window.partitionBy("column_name").orderBy(F.col("value").isNull(), F.col("cnt").desc(), F.col("value"))
    return reduce(lambda a, b: a.unionByName(b), counts).withColumn("rank", F.row_number().over(w)) \
        .where((F.col("rank") <= limit) & F.col("value").isNotNull())


def column_profile(df: DataFrame, table: str, owner: str = OWNER) -> DataFrame:
    """Null count and distinct count of every column (one aggregation)."""
    aggs = []
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n__{c}"), F.count_distinct(F.col(c)).alias(f"d__{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `n__{c}`, `d__{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, n_null, n_distinct)") \
               .select(F.lit(owner).alias("owner"), F.lit(table).alias("table_name"), "column_name",
                       "n_null", "n_distinct")


# ---------------------------------------------------------------------------
# Key evidence (lake tables declare no constraints)
# ---------------------------------------------------------------------------


def infer_keys(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Columns whose values are all present and distinct (key candidates).

    Each column is grouped on its own: a scan of that column, a partial count
    per value before the shuffle, and one row out.  No row is multiplied by the
    number of columns, and the test is exact at every size."""
    def one(c: str) -> DataFrame:
        present = F.col("value").isNotNull()
        groups = value_counts(df, c)
        return groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(present, F.col("rows"))), F.lit(0)).alias("n_non_null"),
                          F.count(F.when(present, 1)).alias("n_distinct")) \
            .select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "n", "n_non_null", "n_distinct",
                    ((F.col("n_non_null") == F.col("n")) & (F.col("n_distinct") == F.col("n"))).alias("is_unique"))

    return reduce(lambda a, b: a.unionByName(b), map(one, columns or df.columns))


def key_eligible(df: DataFrame) -> list[str]:
    """Columns that can serve as keys: integers, strings, dates, integral
    decimals (floating-point and timestamp columns are not keys)."""
    ok = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, ok) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0)]


def key_candidates(frames: dict[str, DataFrame]) -> DataFrame:
    """Unique-and-complete key-eligible columns of every table that has rows:
    ``table_name, column_name``.  Lazy; one exact method at every size."""
    spark = next(iter(frames.values())).sparkSession
    found = [infer_keys(df, t, cols) for t, df in frames.items() if (cols := key_eligible(df))]
    if not found:
        return spark.createDataFrame([], "table_name string, column_name string")
    return reduce(lambda a, b: a.unionByName(b), found).where("is_unique AND n > 0").select("table_name", "column_name")


def infer_fk(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Inclusion test: how many non-null child rows have no parent (0 → the
    foreign key holds).  Child keys are counted first (map-side combine, so a
    hot key is one row), then joined with the distinct parent keys.  Rows without
    a parent are told apart after the join: Spark would put an anti-join before
    the counts, where it meets every row of the child."""
    parents = parent.select(F.col(parent_col).alias("value")).distinct().withColumn("found", F.lit(True))
    orphan = F.col("value").isNotNull() & F.col("found").isNull()
    return value_counts(child, child_col).join(parents, "value", "left") \
        .agg(F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("orphans"))


#: columns whose membership one long holds
WORD = 63


def _value_kind(t: T.DataType) -> str:
    return "text" if isinstance(t, T.StringType) else "date" if isinstance(t, T.DateType) else "number"


def inclusion_dependencies(frames: dict[str, DataFrame]) -> DataFrame:
    """Every pair of columns where the first one's values all stand in the second:
    ``child_table, child_column, parent_table, parent_column``, ``n_values`` and
    ``parent_values`` (distinct) and ``parent_unique``.  Nobody lists candidates.

    All key-eligible columns of all tables are inverted in one pass: each value
    (numbers, texts and dates apart; texts by their MD5) gets the set of columns that have it, as
    a bit mask that is combined before the shuffle, so a hot value is one row per
    task.  Values with the same set are one row from there on.  A column's
    parents are what the sets of all its values have in common: another bit
    mask, combined the same way.  No pair is tested on its own.

    Nulls are no values; a column without values is in no pair; a column is not
    its own parent; equal columns are each other's.  An empty catalog gives an
    empty result."""
    columns = [(t, f.name, _value_kind(f.dataType)) for t, df in frames.items() for f in df.schema.fields if f.name in key_eligible(df)]
    schema = "child_table string, child_column string, parent_table string, parent_column string, n_values long, parent_values long, parent_unique boolean"
    if not columns:
        return SparkSession.active().createDataFrame([], schema)
    spark = next(iter(frames.values())).sparkSession
    number = {(t, c): i for i, (t, c, _) in enumerate(columns)}
    words = [f"w{i}" for i in range(-(-len(columns) // WORD))]

    def bits(i: int) -> list:
        return [F.lit(1 << i % WORD if i // WORD == w else 0).cast("long").alias(words[w]) for w in range(len(words))]

    cells, counts = [], []
    for t, df in frames.items():
        own = [(c, kind) for tt, c, kind in columns if tt == t]
        if not own:
            continue
        value = lambda c, kind: F.md5(F.col(f"`{c}`")) if kind == "text" else F.col(f"`{c}`").cast("string")
        cells.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(kind).alias("kind"), value(c, kind).alias("value"), *bits(number[t, c])) for c, kind in own])).alias("x")).select("x.*"))
        counts.append(df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{number[t, c]}") for c, _ in own])
                      .select(F.explode(F.array(*[F.struct(F.lit(number[t, c]).alias("column"), F.col(f"n{number[t, c]}").alias("present")) for c, _ in own])).alias("x"))
                      .select("x.*"))
    holders = reduce(lambda a, b: a.unionByName(b), cells).where("value IS NOT NULL") \
        .groupBy("kind", "value").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = holders.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))

    def in_word(i: int):
        """Numbers of the columns whose bits are set in a word."""
        every = F.sequence(F.lit(0), F.lit(WORD - 1))
        return F.transform(F.filter(every, lambda b: F.getbit(F.col(words[i]), b) == 1), lambda b: b + i * WORD)

    members = F.flatten(F.array(*map(in_word, range(len(words)))))
    per = sets.withColumn("column", F.explode(members)).groupBy("column") \
        .agg(F.sum("n").alias("n_values"), *[F.bit_and(w).alias(w) for w in words])
    names = spark.createDataFrame([(i, t, c) for (t, c), i in number.items()], "column int, table_name string, column_name string")
    known = per.select("column", "n_values").join(reduce(lambda a, b: a.unionByName(b), counts), "column").join(names, "column")
    parent = known.select(F.col("column").alias("parent"), F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"),
                          F.col("n_values").alias("parent_values"), (F.col("n_values") == F.col("present")).alias("parent_unique"))
    return per.withColumn("parent", F.explode(members)).where("parent <> column").join(names, "column").join(parent, "parent") \
        .select(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"), "parent_table", "parent_column",
                "n_values", "parent_values", "parent_unique")


# ---------------------------------------------------------------------------
# Text documents
# ---------------------------------------------------------------------------


def _type_text(c) -> F.Column:
    return F.concat(F.col(f"{c}.data_type"),
                    F.when(F.col(f"{c}.data_precision").isNotNull(),
                           F.concat(F.lit("("), F.col(f"{c}.data_precision").cast("string"), F.lit(","),
                                    F.coalesce(F.col(f"{c}.data_scale").cast("string"), F.lit("None")), F.lit(")")))
                     .when(F.col(f"{c}.data_length").isNotNull(),
                           F.concat(F.lit("("), F.col(f"{c}.data_length").cast("string"), F.lit(")")))
                     .otherwise(F.lit("")))


def table_cards(tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame,
                samples: DataFrame, top_n: int = 5) -> DataFrame:
    """One card per table: header, measured rows, comment, one line per
    column (type, nullability, comment, top values ``v×n``), primary keys,
    foreign keys and indexes.  Returns ``owner, table_name, title, body``."""
    key = ["owner", "table_name"]
    top = (samples.where(F.col("rank") <= top_n)
           .groupBy(*key, "column_name")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))),
                                         lambda s: fmt(TOP_ITEM, value=s["value"], count=s["cnt"].cast("string"))),
                             ", ").alias("top")))
    cols = columns.join(top, key + ["column_name"], "left")
    line = F.concat(fmt(COLUMN_LINE, name=F.col("column_name"), type=_type_text("c"), nullable=F.col("nullable")),
                    F.when(F.col("comments").isNotNull() & (F.col("comments") != ""),
                           fmt(COLUMN_COMMENT, comment=F.col("comments"))).otherwise(F.lit("")),
                    F.when(F.col("top").isNotNull(), fmt(COLUMN_TOP, top=F.col("top"))).otherwise(F.lit("")))
    col_lines = (cols.select(*key, "column_id", F.struct(*[F.col(c) for c in cols.columns]).alias("c"),
                             "column_name", "nullable", "comments", "top")
                 .select(*key, "column_id", line.alias("line"))
                 .groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                     F.struct("column_id", "line"))), lambda s: s["line"]), "\n").alias("col_text")))
    pk = (constraints.where(F.col("constraint_type") == "P")
          .groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
              "constraint_name", "position", "column_name"))), lambda s: fmt(PK_LINE, name=s["constraint_name"], column=s["column_name"])),
              "\n").alias("pk")))
    fk = (constraints.where(F.col("constraint_type") == "R")
          .groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
              "constraint_name", "position", "column_name", "r_constraint_name"))), lambda s: fmt(FK_LINE, name=s["constraint_name"], column=s["column_name"],
                              ref=s["r_constraint_name"])), "\n").alias("fk")))
    ix = (indexes.groupBy(*key, "index_name")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_position", "column_name"))),
                                        lambda s: s["column_name"]), ", ").alias("cols"))
          .groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index_name", "cols"))),
                                                      lambda s: fmt(IX_LINE, name=s["index_name"], columns=s["cols"])),
                                          "\n").alias("ix")))
    t = tables.join(col_lines, key, "left").join(pk, key, "left").join(fk, key, "left").join(ix, key, "left")
    body = F.concat_ws("\n",
                       fmt(CARD_HEADER, table=F.col("table_name"), owner=F.col("owner")),
                       fmt(CARD_ROWS, rows=F.coalesce(F.col("num_rows").cast("string"), F.lit("None"))),
                       fmt(CARD_COMMENT, comment=F.coalesce(F.nullif(F.col("table_comment"), F.lit("")),
                                                            F.lit(MISSING))),
                       F.lit(CARD_COLUMNS),
                       F.col("col_text"),
                       F.when(F.col("pk").isNotNull(), F.concat(F.lit(PK_HEADER + "\n"), F.col("pk"))),
                       F.when(F.col("fk").isNotNull(), F.concat(F.lit(FK_HEADER + "\n"), F.col("fk"))),
                       F.when(F.col("ix").isNotNull(), F.concat(F.lit(IX_HEADER + "\n"), F.col("ix"))))
    title = fmt(CARD_TITLE, table=F.col("table_name"), owner=F.col("owner"))
    return t.select(*key, title.alias("title"), body.alias("body"))


def view_cards(views: DataFrame) -> DataFrame:
    """``owner, view_name, view_comment, view_text`` → title/body."""
    body = fmt(VIEW_BODY, view=F.col("view_name"),
               comment=F.coalesce(F.nullif(F.col("view_comment"), F.lit("")), F.lit(MISSING)),
               sql=F.coalesce(F.col("view_text"), F.lit("")))
    return views.select("owner", F.col("view_name").alias("table_name"),
                        fmt(VIEW_TITLE, view=F.col("view_name"), owner=F.col("owner")).alias("title"),
                        body.alias("body"))


def rel_cards(constraints: DataFrame) -> DataFrame:
    """One relationship card per table that has foreign keys."""
    key = ["owner", "table_name"]
    fk = constraints.where(F.col("constraint_type") == "R")
    lines = fk.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "constraint_name", "position", "column_name", "r_constraint_name", "table_name"))), lambda s: fmt(
        REL_LINE, name=s["constraint_name"], table=s["table_name"], column=s["column_name"],
        ref=s["r_constraint_name"])), "\n").alias("lines"))
    body = F.concat(fmt(REL_HEADER, table=F.col("table_name")), F.lit("\n"), F.col("lines"))
    return lines.select(*key, fmt(REL_TITLE, table=F.col("table_name")).alias("title"), body.alias("body"))


def column_docs(columns: DataFrame) -> DataFrame:
    """One short document per column: ``table.column: type`` plus comment."""
    return columns.select("owner", "table_name", "column_name", F.concat(
        F.col("table_name"), F.lit("."), F.col("column_name"), F.lit(": "), F.col("data_type"),
        F.when(F.col("comments").isNotNull(), F.concat(F.lit(" — "), F.col("comments"))).otherwise(F.lit("")))
        .alias("doc"))


def ddl_docs(columns: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text per table from the column metadata."""
    key = ["owner", "table_name"]
    col = F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), F.col("data_type"),
                   F.when(F.col("data_precision").isNotNull(),
                          F.concat(F.lit("("), F.col("data_precision").cast("string"), F.lit(","),
                                   F.col("data_scale").cast("string"), F.lit(")"))).otherwise(F.lit("")),
                   F.when(F.col("nullable") == "N", F.lit(" NOT NULL")).otherwise(F.lit("")))
    g = columns.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("column_id", col.alias("c")))), lambda s: s["c"]), ",\n").alias("cols"))
    return g.select(*key, F.lit("TABLE").alias("object_type"),
                    F.concat(F.lit("CREATE TABLE "), F.col("owner"), F.lit("."), F.col("table_name"),
                             F.lit(" (\n"), F.col("cols"), F.lit("\n)")).alias("ddl"))


def schema_context(columns: DataFrame) -> DataFrame:
    """Per table: ``- col (type): description`` lines (``No description`` when
    the comment is missing)."""
    key = ["owner", "table_name"]
    line = fmt(CONTEXT_LINE, column=F.col("column_name"), type=F.col("data_type"),
               description=F.coalesce(F.col("comments"), F.lit(NO_DESCRIPTION)))
    return columns.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("column_id", line.alias("l")))), lambda s: s["l"]), "\n").alias("context"))


def ddl_excerpt(ddl: DataFrame, owner: str, table: str | None = None, first: int = 20) -> DataFrame:
    """DDL of one table, or of the first ``first`` objects of the owner (by
    name), joined by newlines — one row."""
    d = ddl.where(F.upper("owner") == owner.upper())
    if table:
        d = d.where((F.col("object_type") == "TABLE") & (F.upper("table_name") == table.upper()))
    else:
        d = d.orderBy("table_name").limit(first)
    return d.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "ddl"))),
                                                     lambda s: s["ddl"]), "\n"), F.lit("")).alias("excerpt"))

"""Parametrised statements answered for a whole table of requests.

Spark's parser reads each distinct template once, with every ``:name`` as a
column of the requests.  Its tree is put together again as DataFrame
operations with the distinct parameter values joined in:

* ``expression of columns = expression of parameters`` is a join key;
* a lower and an upper bound of a date become a join on spans of days, with
  the bounds checked afterwards;
* other conditions on parameters are checked on the joined rows;
* grouping adds the parameter values to the keys, and ``ORDER BY … LIMIT :n``
  is a rank within them, bounded by the largest limit asked for.

So a template that is added as a row is answered like the others, by one join
of the requests with its relation, however many requests there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import params as P

#: days of a span in joins on date ranges
SPAN_DAYS = 32
#: spans up to which a relation is read only for the days that are asked for (87 years)
MOST_SPANS = 1000
#: templates that are read in one call
MOST_TEMPLATES = 10_000
_TOKEN = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|(?<![:\w]):([A-Za-z_]\w*)""", re.S)
_RANGES = {"GreaterThan": "low", "GreaterThanOrEqual": "low", "LessThan": "high", "LessThanOrEqual": "high"}


class Unsupported(ValueError):
    """A template that can't be answered by one join."""


@contextmanager
def _lenient(spark: SparkSession) -> Iterator[None]:
    """Values that don't convert are null instead of an error while expressions
    of parameters are built: such a request matches nothing."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parameter_columns(sql: str) -> tuple[str, list[str]]:
    """The statement with each ``:name`` (outside literals and comments) as the
    column ```p:name```, and the names in order."""
    names: list[str] = []

    def put(m: re.Match) -> str:
        if m.group(1):
            return m.group(1)
        name = m.group(2).lower()
        if name not in names:
            names.append(name)
        return f"`p:{name}`"

    return _TOKEN.sub(put, sql), names


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    c = node.children()
    return [c.apply(i) for i in range(c.size())]


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _attributes(expr) -> set[str]:
    """Names of the columns in an expression."""
    if _kind(expr).endswith(("Subquery", "Exists", "ListQuery")):
        raise Unsupported("subqueries in conditions aren't read")
    if _kind(expr) == "UnresolvedAttribute":
        return {".".join(_seq(expr.nameParts()))}
    return set().union(*map(_attributes, _children(expr)))


def _parameters(expr) -> set[str]:
    return {a[2:] for a in _attributes(expr) if a.startswith("p:")}


def _conjuncts(expr) -> list:
    return _conjuncts(expr.left()) + _conjuncts(expr.right()) if _kind(expr) == "And" else [expr]


@dataclass
class Statement:
    """What the parser read: one SELECT over one relation."""

    relation: str
    parameters: list[str]
    where: list = field(default_factory=list)
    grouping: list | None = None
    output: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: object = None

    @property
    def matched(self) -> list[str]:
        """Parameters that decide which rows are read."""
        return sorted(set().union(*map(_parameters, [*self.where, *self.having, *self.output, *(self.grouping or [])])))


def parse(spark: SparkSession, sql: str) -> Statement:
    text, names = parameter_columns(sql)
    with _lenient(spark):
        node = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    out = Statement("", names)
    while True:
        kind = _kind(node)
        if kind == "GlobalLimit":
            out.limit = node.limitExpr()
        elif kind == "Sort":
            out.order = _seq(node.order())
        elif kind == "UnresolvedHaving":
            out.having = _conjuncts(node.havingCondition())
        elif kind == "Aggregate":
            out.output = _seq(node.aggregateExpressions())
            out.grouping = _seq(node.groupingExpressions())
        elif kind == "Project":
            out.output = _seq(node.projectList())
        elif kind == "Filter":
            out.where = _conjuncts(node.condition())
        elif kind == "UnresolvedRelation":
            out.relation = ".".join(_seq(node.multipartIdentifier())).lower()
            return out
        elif kind not in ("LocalLimit", "SubqueryAlias"):
            raise Unsupported(f"{kind} isn't read")
        node = _children(node)[0]


def _column(spark: SparkSession, expr) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expr))


def _bounds(expr) -> list[tuple[object, str, object]]:
    """(expression of columns, low or high, expression of parameters) of a
    comparison or a BETWEEN."""
    kind = _kind(expr)
    if kind == "UnresolvedFunction" and _seq(expr.nameParts()) == ["between"]:
        of, low, high = _children(expr)
        sides = [(of, "low", low), (of, "high", high)]
    elif kind in _RANGES or kind == "EqualTo":
        a, b = _children(expr)
        way = _RANGES.get(kind, "same")
        sides = [(a, way, b), (b, {"low": "high", "high": "low"}.get(way, way), a)]
    else:
        return []
    return [(of, way, value) for of, way, value in sides if not _parameters(of) and _attributes(of) and _parameters(value)
            and all(x.startswith("p:") for x in _attributes(value))]


class Answer:
    """One template over its relation, for the distinct parameter values."""

    def __init__(self, spark: SparkSession, statement: Statement, relation: DataFrame):
        self.spark, self.st, self.relation = spark, statement, relation
        self.keys = [f"p:{p}" for p in statement.matched]

    def col(self, expr) -> Column:
        return _column(self.spark, expr)

    def _type(self, expr) -> T.DataType:
        return self.relation.select(self.col(expr)).schema[0].dataType

    def dated(self) -> dict | None:
        """The first date that parameters bound on both sides: ``of``, ``low``
        and ``high``."""
        found: dict[str, dict] = {}
        for c in self.st.where:
            for of, way, value in _bounds(c) if _parameters(c) else ():
                if isinstance(self._type(of), T.DateType):
                    found.setdefault(of.sql(), {"of": of}).update({"low": value, "high": value} if way == "same" else {way: value})
        return next((s for s in found.values() if "low" in s and "high" in s), None)

    def span(self, of) -> Column:
        return F.floor(F.unix_date(self.col(of)) / SPAN_DAYS)

    def spanned(self, values: DataFrame, dates: dict, name: str) -> DataFrame:
        """Parameter values, once for each span of days that they reach."""
        with _lenient(self.spark):
            bound = {w: F.floor(F.unix_date(self.col(dates[w]).cast("date")) / SPAN_DAYS) for w in ("low", "high")}
            return values.withColumns({"low": bound["low"], "high": bound["high"]}).where("low <= high") \
                .withColumn(name, F.explode(F.sequence("low", "high"))).drop("low", "high")

    def joined(self, values: DataFrame, asked: list[int] | None = None) -> DataFrame:
        """Rows of the relation with the parameter values they go with.  Rows
        outside the spans of days in ``asked`` are dropped where their date is
        read, before the joins that the relation is made of."""
        rows, on, later = self.relation, [], []
        spans: dict[str, dict] = {}
        for c in self.st.where:
            if not _parameters(c):
                rows = rows.where(self.col(c))
                continue
            found = _bounds(c)
            if found and found[0][1] == "same":
                of, _, value = found[0]
                name = f"k:{len(on)}"
                rows = rows.withColumn(name, self.col(of))
                with _lenient(self.spark):
                    values = values.withColumn(f"v:{len(on)}", self.col(value).try_cast(rows.schema[name].dataType))
                on.append((name, f"v:{len(on)}"))
                continue
            later.append(c)
            for of, way, value in found:
                if isinstance(self._type(of), T.DateType):
                    spans.setdefault(of.sql(), {"of": of})[way] = value
        for s in spans.values():
            if "low" not in s or "high" not in s:
                continue
            span, at = f"k:{len(on)}", f"v:{len(on)}"
            rows, values = rows.withColumn(span, self.span(s["of"])), self.spanned(values, s, at)
            on.append((span, at))
            break
        if asked is not None:
            rows = rows.where(self.span(self.dated()["of"]).isin(asked))
        if not self.keys:
            return rows
        if not on:
            raise Unsupported("no condition on parameters is an equality or a range of dates")
        same = None
        for k, v in on:
            same = (F.col(f"`{k}`") == F.col(f"`{v}`")) if same is None else same & (F.col(f"`{k}`") == F.col(f"`{v}`"))
        with _lenient(self.spark):
            out = rows.join(values, same)
            for c in later:
                out = out.where(self.col(c))
        return out.drop(*[x for pair in on for x in pair])

    def _aggregated(self) -> bool:
        """Whether a statement without GROUP BY is one aggregate."""
        probe = self.relation.limit(0)
        for k in self.keys:
            probe = probe.withColumn(k, F.lit(""))
        return probe.select(*map(self.col, self.st.output))._jdf.queryExecution().analyzed().nodeName() == "Aggregate"

    def _group(self, expr) -> Column:
        """A grouping; an ordinal stands for the output of that place, without its alias."""
        if _kind(expr) == "UnresolvedOrdinal":
            expr = self.st.output[expr.ordinal() - 1]
            if _kind(expr) == "Alias":
                expr = _children(expr)[0]
        return self.col(expr)

    def rows(self, values: DataFrame, most: int | None, asked: list[int] | None = None) -> tuple[DataFrame, list[str]]:
        """Answer rows by parameter values, ``rank`` among them, and the names
        of the answer's columns; at most ``most`` ranks."""
        st, joined = self.st, self.joined(values, asked)
        keys = [F.col(f"`{k}`") for k in self.keys]
        output = []
        for e in st.output:
            if _kind(e) == "UnresolvedStar":
                output += [F.col(f"`{c}`") for c in self.relation.columns]
            else:
                output.append(self.col(e))
        single = st.grouping is None and self._aggregated()
        if st.grouping is not None:
            grouping = [self._group(g) for g in st.grouping]
            out = joined.groupBy(*keys, *grouping).agg(*output)
            names = out.columns[len(keys) + len(grouping):]
            out = out.toDF(*self.keys, *[f"g:{i}" for i in range(len(grouping))], *names)
        elif single:
            out = joined.groupBy(*keys).agg(*output)
            names = out.columns[len(keys):]
            if keys:  # no rows: the aggregate of nothing
                none = self.relation.where("false")
                none = none.withColumns({k: F.lit("") for k in self.keys}).agg(*output).first()
                types = [f.dataType for f in out.schema.fields[len(keys):]]
                out = values.select(*keys).distinct().join(out.withColumn("g:some", F.lit(True)), self.keys, "left")
                out = out.select(*keys, *[F.when(F.col("`g:some`"), F.col(f"`{n}`")).otherwise(F.lit(v).cast(t)).alias(n)
                                          for n, v, t in zip(names, none, types, strict=True)])
        else:
            extra = [self.col(o.child()).alias(f"o:{i}") for i, o in enumerate(st.order)] if st.order else []
            try:
                out = joined.select(*keys, *output, *extra)
            except Exception:  # ordered by an alias of the output
                extra = []
                out = joined.select(*keys, *output)
            names = out.columns[len(keys):len(out.columns) - len(extra)]
            names = [n if names.count(n) == 1 else f"{n}:{i}" for i, n in enumerate(names)]
            out = out.toDF(*self.keys, *names, *[f"o:{i}" for i in range(len(extra))])
        for h in st.having:
            out = out.where(self.col(h))
        order = []
        for i, o in enumerate(st.order):
            c = F.col(f"`o:{i}`") if f"o:{i}" in out.columns else self.col(o.child())
            down, first = o.direction().sql() == "DESC", o.nullOrdering().sql() == "NULLS FIRST"
            order.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else c.asc_nulls_first() if first else c.asc_nulls_last())
        if order or most is not None:
            order += [F.col(f"`{n}`") for n in names]  # ties follow the answer
            rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
            out = out.withColumn("rank", rank)
            if most is not None:
                out = out.where(F.col("rank") <= most)
        else:
            out = out.withColumn("rank", F.lit(None).cast("int"))
        return out, names


def answer_requests(requests: DataFrame, templates: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """Answers of all requests: ``prompt_id``, ``template``, ``rank`` (null
    where the template has neither order nor limit) and ``answer``, the row's
    values as strings.

    ``requests`` has ``prompt_id``, ``template`` (a name) and ``params``
    (map of strings, names in lower case); ``templates`` has ``name`` and ``sql``
    (parameters as ``:name`` or ``{name}``); ``relations`` the tables they may
    name.  A request that lacks a parameter of its template gets no rows, nor
    does one whose value doesn't convert; a null parameter is a missing one.
    Rows of equal order follow the answer's columns.  Requests are read several
    times, so those of some cost should be written first.  A template beyond one
    SELECT over one relation, or without an equality or a range of dates among
    its conditions on parameters, raises :class:`Unsupported`."""
    spark = requests.sparkSession
    read = templates.select("name", P.bind_template("sql", F.create_map().cast("map<string,string>"))["sql"].alias("sql")).distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(read) > MOST_TEMPLATES:
        raise Unsupported(f"more than {MOST_TEMPLATES} templates")
    relations = {k.lower(): v for k, v in relations.items()}
    wanted = {name for name, _ in read}
    if len(read) > 1:  # a relation isn't read for a template that nobody asks for
        wanted = {r[0] for r in requests.where(F.col("template").isin(*wanted)).select("template").distinct().collect()}
    answers, spans = [], {}
    for name, sql in read:
        st = parse(spark, sql)
        if st.relation not in relations:
            raise Unsupported(f"template {name!r} names an unknown relation {st.relation!r}")
        mine = requests.where(F.col("template") == name).select("prompt_id", *[F.try_element_at("params", F.lit(p)).alias(f"p:{p}") for p in st.parameters])
        if st.parameters:
            mine = mine.dropna(subset=[f"p:{p}" for p in st.parameters])
        a = Answer(spark, st, relations[st.relation])
        keys = [f"`{k}`" for k in a.keys]
        values = mine.select(*keys).distinct() if keys else None
        dates = a.dated()
        # the days that any template asks for: with the same rows dropped, the templates share the relation's exchanges
        days = (st.relation, dates["of"].sql()) if dates else None
        if days and name in wanted:
            reach = a.spanned(values, dates, "span").select("span")
            spans[days] = spans[days].unionByName(reach) if days in spans else reach
        answers.append((name, a, mine, values, days))
    asked = {}
    for days, reach in spans.items():
        found = reach.distinct().limit(MOST_SPANS + 1).collect()
        if len(found) <= MOST_SPANS:
            asked[days] = sorted(r[0] for r in found)
    parts, last = [], None
    for name, a, mine, values, days in answers:
        st, most, limit = a.st, None, None
        if st.limit is not None:
            with _lenient(spark):
                limit = _column(spark, st.limit).try_cast("int")
                if _parameters(st.limit):
                    most = mine.agg(F.max(limit)).first()[0] or 0  # the bound of ranks must be a constant
                else:
                    most = spark.range(1).select(limit).first()[0]
        keys = [f"`{k}`" for k in a.keys]
        out, names = a.rows(values, most, asked.get(days))
        row = F.array(*[F.col(f"`{n}`").cast("string") for n in names]).alias("answer")
        out = out.select(*keys, "rank", row)
        one = F.lit(name).alias("template")
        got = mine.join(out, a.keys) if keys else mine.withColumn("template", F.lit(name)).join(out.select("rank", "answer", one), "template")
        if limit is not None and _parameters(st.limit):
            got = got.where(F.col("rank") <= limit)
        last = got.select("prompt_id", one, "rank", "answer")
        if name in wanted:
            parts.append(last)
    if last is not None and not parts:
        return last.where("false")
    if not parts:
        return spark.createDataFrame([], requests.select("prompt_id").schema.add("template", "string").add("rank", T.IntegerType()).add("answer", T.ArrayType(T.StringType())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Prompt parameters: extraction rules, ``{name=value}`` pairs, template
placeholders, binding and defaults — all Spark SQL expressions over columns,
so a table of prompts is processed in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extraction patterns (year, top N, ISO date, date range).
YEAR_RE = r"\b(20\d{2})\b"
TOP_N_RE = r"\btop\s+(\d+)"
DATE_RE = r"\b(20\d{2}-\d{2}-\d{2})\b"
BETWEEN_RE = r"(?:between|from)\s+(20\d{2}-\d{2}-\d{2})\s+(?:and|to)\s+(20\d{2}-\d{2}-\d{2})"
NAMED_RE = r"\{(.*?)=(.*?)\}"
PLACEHOLDER_RE = r"\{(.*?)\}"

_STR_ARR = T.ArrayType(T.StringType())
_STR_MAP = T.MapType(T.StringType(), T.StringType())


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_params(prompt: Column | str, asof_year: int) -> Column:
    """Rule-based parameters of a prompt as ``map<string,string>``:

    * ``year``: "last year" / "this year" relative to ``asof_year``; an
      explicit ``20dd`` wins (it also fires inside an ISO date: D16);
    * ``limit``: ``top N``;
    * ``start_date``/``end_date``: ``between|from D1 and|to D2``;
    * ``date``: the first ISO date (also the range start: D16).
    """
    q = F.lower(_c(prompt))
    rel = (F.when(q.contains("last year"), F.lit(str(asof_year - 1)))
            .when(q.contains("this year"), F.lit(str(asof_year))))
    year = F.coalesce(_extract(q, YEAR_RE), rel)
    limit = _extract(q, TOP_N_RE).try_cast("int")
    entries = F.array(
        F.struct(F.lit("year").alias("key"), year.alias("value")),
        F.struct(F.lit("limit").alias("key"), limit.cast("string").alias("value")),
        F.struct(F.lit("start_date").alias("key"), _extract(q, BETWEEN_RE, 1).alias("value")),
        F.struct(F.lit("end_date").alias("key"), _extract(q, BETWEEN_RE, 2).alias("value")),
        F.struct(F.lit("date").alias("key"), _extract(q, DATE_RE).alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def value_kind(v: Column) -> Column:
    """``int`` for digit strings, ``float`` for other numbers, else ``text``."""
    return (F.when(v.rlike(r"^[0-9]+$"), F.lit("int"))
             .when(v.try_cast("double").isNotNull(), F.lit("float"))
             .otherwise(F.lit("text")))


def named_param_entries(prompt: Column | str) -> Column:
    """``{name=value}`` pairs as ``array<struct<name, value, kind>>`` in
    order of appearance, names and values trimmed; when a name repeats only
    its last occurrence is kept."""
    p = _c(prompt)
    names = F.regexp_extract_all(p, F.lit(NAMED_RE), 1)
    values = F.regexp_extract_all(p, F.lit(NAMED_RE), 2)
    pairs = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")),
                        lambda e: F.struct(F.trim(e["n"]).alias("name"), F.trim(e["v"]).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))),
                                                  lambda x: x["name"] == e["name"]))
    return F.transform(last, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"),
                                                value_kind(e["value"]).alias("kind")))


def named_params(prompt: Column | str) -> Column:
    """``{name=value}`` pairs as ``map<string,string>`` (last duplicate wins)."""
    e = named_param_entries(prompt)
    return F.map_from_entries(F.transform(e, lambda x: F.struct(x["name"], x["value"])))


def placeholders(sql: Column | str) -> Column:
    """Placeholder names ``{p}`` of a template, in order."""
    return F.regexp_extract_all(_c(sql), F.lit(PLACEHOLDER_RE), 1)


def lower_keys(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def bind_template(sql: Column | str, params: Column) -> Column:
    """``struct<sql, missing>``: every ``{p}`` rewritten to ``:p`` (lower-cased
    name, case-insensitive match against the parameters); ``missing`` lists
    placeholders without a value.  The statement is then run with
    ``spark.sql(sql, args=…)`` — values are never pasted into the text."""
    ph = placeholders(sql)
    keys = F.map_keys(lower_keys(params))
    bound = F.aggregate(ph, _c(sql), lambda acc, p: F.replace(acc, F.concat(F.lit("{"), p, F.lit("}")),
                                                              F.concat(F.lit(":"), F.lower(p))))
    missing = F.filter(ph, lambda p: ~F.array_contains(keys, F.lower(p)))
    return F.struct(bound.alias("sql"), missing.alias("missing"))


def fill_defaults(params: Column, defaults: Column, required: Column) -> Column:
    """``struct<params, missing, ok>``: defaults added for absent keys,
    required names without a value listed."""
    filled = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(params), k)), params)
    missing = F.array_except(required, F.map_keys(params))
    return F.struct(filled.alias("params"), missing.alias("missing"), (F.size(missing) == 0).alias("ok"))


def param_hits(prompt: Column | str, expected: Column) -> Column:
    """How many expected parameter names the prompt mentions."""
    lp = F.lower(_c(prompt))
    return F.size(F.filter(expected, lambda p: lp.contains(F.lower(p))))


def typed_args(entries) -> dict:
    """Driver-side helper for one request: ``[(name, value, kind)]`` →
    ``spark.sql`` arguments with int/float/text types."""
    out = {}
    for name, value, kind in entries:
        key = name.lower()
        out[key] = int(value) if kind == "int" else float(value) if kind == "float" else value
    return out

"""Column functions over model output and generated SQL text: list and object
parsing, SQL cleanup and the read-only gate, dictionary synonym expansion.
All of them are Spark SQL expressions (regex, JSON, higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: Column | str) -> Column:
    """Strip leading/trailing whitespace (``\\s``: space, tab, newlines)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


# ---------------------------------------------------------------------------
# Model list / object output
# ---------------------------------------------------------------------------


def parse_list(col: Column | str, max_items: int = 5) -> Column:
    """JSON list when the text is one, otherwise the non-blank lines stripped
    of ``-``, ``•`` and spaces; both forms capped at ``max_items`` (D10)."""
    c = _c(col)
    as_json = F.from_json(c, T.ArrayType(T.StringType()))
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(strip_ws(x)) > 0)
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit("-• ")))
    return F.slice(F.coalesce(as_json, stripped), 1, max_items)


def safe_json_list(col: Column | str) -> Column:
    """JSON list text → ``array<string>``; anything else → empty list."""
    return F.coalesce(F.from_json(_c(col), T.ArrayType(T.StringType())),
                      F.array().cast(T.ArrayType(T.StringType())))


def unfence(col: Column | str) -> Column:
    """Replace every fenced block (```lang … ```) by its content (D6)."""
    return F.regexp_replace(_c(col), r"```[A-Za-z]*[ \t]*\r?\n?([\s\S]*?)```", "$1")


def parse_object(col: Column | str) -> Column:
    """Model object output → ``struct<ok: boolean, value: map<string,string>>``."""
    v = F.from_json(strip_ws(unfence(strip_ws(col))), T.MapType(T.StringType(), T.StringType()))
    return F.struct(v.isNotNull().alias("ok"), v.alias("value"))


# ---------------------------------------------------------------------------
# Generated SQL
# ---------------------------------------------------------------------------


def clean_sql(col: Column | str) -> Column:
    """Model output → SQL: unwrap fences, drop a leading ``sql`` label, keep the
    text from the first SELECT/WITH keyword on (unchanged when there is none)."""
    t = strip_ws(F.regexp_replace(strip_ws(unfence(col)), r"^(?i)sql", ""))
    m = F.regexp_extract(t, r"(?i)((?:select|with)[^\p{L}\p{N}_][\s\S]*)$", 1)
    return strip_ws(F.when(m != "", m).otherwise(t))


#: literals, quoted names and comments (possessive: long ones don't recurse)
_QUOTED = r"""'(?:[^'\\]++|\\[\s\S])*+'|"(?:[^"\\]++|\\[\s\S])*+"|`[^`]*+`|--[^\n]*+|/\*[\s\S]*?\*/"""
_READS = r"^(SELECT|WITH)([^\p{L}\p{N}_]|$)"
_CHANGES = r"(^|[^\p{L}\p{N}_])(INSERT\s+(INTO|OVERWRITE|TABLE)|MERGE\s+INTO|DELETE\s+FROM|UPDATE\s+\S+\s+SET)([^\p{L}\p{N}_]|$)"


def is_allowed_sql(col: Column | str) -> Column:
    """Read-only gate for a column of texts: one statement that begins with the
    word SELECT or WITH and changes no table.  Literals, quoted names and comments
    are blanked first, so a ``;`` or a keyword in them counts for nothing.
    Empty/null → false.  Statements that are to be run are judged by the parser
    (``operators.evaluate.parse_statements``)."""
    t = F.upper(strip_ws(F.regexp_replace(_c(col), _QUOTED, " ")))
    body = F.regexp_replace(t, r";[\s;]*$", "")
    ok = t.rlike(_READS) & ~body.contains(";") & ~t.rlike(_CHANGES)
    return F.coalesce(ok, F.lit(False))


# ---------------------------------------------------------------------------
# Dictionary synonym expansion
# ---------------------------------------------------------------------------

# The synonym dictionary (word → alternatives, in order).
SYNONYMS = {
    "show": ["list", "display", "give me"],
    "records": ["rows", "entries", "data"],
    "count": ["number", "total", "how many"],
    "customers": ["clients", "buyers", "users"],
    "orders": ["purchases", "transactions", "sales"],
    "employees": ["staff", "workers", "team members"],
    "products": ["items", "goods", "inventory"],
}


def synonym_map(d: dict[str, list[str]] = SYNONYMS) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def expand_synonyms(col: Column | str, max_variants: int = 5, d: dict[str, list[str]] = SYNONYMS) -> Column:
    """Variants of a question, original first: the ordered cartesian product
    of each dictionary word's choices (earlier words vary slowest), first
    ``max_variants`` only.

    Variant ``v`` picks, for word ``j``, choice ``(v // P_j) % r_j`` where
    ``r_j`` is the word's number of choices and ``P_j`` the product of the
    later words' choice counts (saturated at ``max_variants``: it only has to
    be compared with ``v < max_variants``).
    """
    cap = max_variants
    words = F.filter(F.split(_c(col), r"\s+"), lambda w: w != "")
    m = synonym_map(d)
    opts = F.transform(words, lambda w: F.concat(
        F.array(w), F.coalesce(F.try_element_at(m, F.btrim(F.lower(w), F.lit("?,."))),
                               F.array().cast(T.ArrayType(T.StringType())))))
    radix = F.transform(opts, lambda o: F.size(o).cast("long"))
    # suffix products, inclusive: S_j = prod_{k >= j} r_k (saturated)
    suffix = F.aggregate(F.reverse(radix), F.array().cast(T.ArrayType(T.LongType())),
                         lambda acc, r: F.concat(F.array(F.least(F.lit(cap).cast("long"),
                                                                 r * F.coalesce(F.try_element_at(acc, F.lit(1)),
                                                                                F.lit(1).cast("long")))), acc))
    total = F.coalesce(F.try_element_at(suffix, F.lit(1)), F.lit(1).cast("long"))
    n = F.least(total, F.lit(cap).cast("long"))

    def variant(v):
        picked = F.transform(opts, lambda o, j: F.element_at(
            o, (F.floor(v / F.coalesce(F.try_element_at(suffix, j + 2), F.lit(1).cast("long")))
                % F.size(o)).cast("int") + 1))
        return F.array_join(picked, " ")

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), variant)

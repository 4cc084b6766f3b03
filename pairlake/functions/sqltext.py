"""What a SQL text looks like from outside: small pattern checks, no parse tree.

Quoted strings and comments are blanked first, so words inside them never count. The
patterns read common query shapes; they are hints for reports, not a SQL grammar.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = r"(?s)'[^']*+'|--[^\n]*+|/\*.*?\*/"
_MARKS = r"\border\s+by\b|\b(?:limit|select|from|union|intersect|except)\b|[(),]"
_NAME = r'(?:"[^"]++"|[a-z_][a-z0-9_$]*+)(?:\.(?:"[^"]++"|[a-z_][a-z0-9_$]*+))*+'
# What decides where tables stand: parentheses, FROM and JOIN with the name that follows,
# commas with theirs, and the words that end a FROM clause or begin a join's condition.
_STEPS = (
    r"\b(?:extract|trim|substring|overlay|position)\s*\(|[()]|\bdistinct\s+from\b"
    rf"|\b(?:from|join)\b(?:\s+(?:lateral\s+)?(?!lateral\b|select\b){_NAME})?|,(?:\s*(?!lateral\b|select\b){_NAME})?"
    r"|\b(?:where|group|order|having|limit|offset|qualify|window|union|intersect|except|select|on|using)\b"
)
# Where a reader of a query is: elsewhere, before a table, after one, in a join's condition,
# among arguments in which FROM names no table.
_ELSEWHERE, _BEFORE, _AFTER, _JOINING, _ARGUMENTS = range(5)
_READER = "struct<at:int,outer:array<int>,names:array<string>,joins:int>"
# Aggregate functions that count as such in the reports.
AGGREGATES = (
    "count", "sum", "avg", "mean", "min", "max", "median", "mode", "stddev", "stddev_pop",
    "stddev_samp", "variance", "var_pop", "var_samp", "corr", "covar_pop", "covar_samp",
    "string_agg", "group_concat", "list", "array_agg", "first", "last", "any_value", "arg_max",
    "arg_min", "quantile", "quantile_cont", "quantile_disc", "percentile_cont",
    "percentile_disc", "approx_quantile", "approx_count_distinct", "bool_and", "bool_or",
)
# Names that count as date and time functions.
DATE_FUNCTIONS = (
    "year", "month", "day", "date_part", "datepart", "date_trunc", "datetrunc",
    "strftime", "strptime", "extract", "julianday", "date", "datetime", "now",
    "current_date", "date_diff", "datediff", "date_add", "age", "to_timestamp",
)


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def visible(sql: Column) -> Column:
    """Lower-case SQL without string literals and comments."""
    return F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), _SILENT, " "))


def _outer(text: Column) -> Column:
    """What stands outside all parentheses: ORDER BY, LIMIT, and the SELECT list's width."""
    marks = F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(False).alias("order"),
        F.lit(False).alias("limit"),
        F.lit(0).alias("part"),
        F.lit(0).alias("commas"),
    )

    def step(acc: Column, m: Column) -> Column:
        outside, part = acc["depth"] == 0, acc["part"]
        ends_list = m.isin("from", "union", "intersect", "except")
        return F.struct(
            (acc["depth"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("depth"),
            (acc["order"] | (outside & m.startswith("order"))).alias("order"),
            (acc["limit"] | (outside & (m == "limit"))).alias("limit"),
            F.when(outside & (part == 0) & (m == "select"), 1)
            .when(outside & (part == 1) & ends_list, 2)
            .otherwise(part)
            .alias("part"),
            (acc["commas"] + (outside & (part == 1) & (m == ",")).cast("int")).alias("commas"),
        )

    return F.aggregate(marks, start, step)


def has_order_by(sql: Column) -> Column:
    """Does the outer query have an ORDER BY (subqueries and windows do not count)?"""
    return _outer(visible(sql))["order"]


def unordered_limit(sql: Column) -> Column:
    """An outer LIMIT without an outer ORDER BY returns an arbitrary subset."""
    return bind(_outer(visible(sql)), lambda o: o["limit"] & ~o["order"])


_HIDDEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)
_CLAUSES = re.compile(r"[()]|\border\s+by\b(\s+all\b)?|\b(?:limit|offset|window|cluster|distribute|sort)\b", re.I)


def tie_broken(sql: str, columns: int, descending: bool) -> str | None:
    """The text with every output column appended to its outermost ORDER BY, by position.

    None where there is no such ORDER BY, or where it names all columns already. Quoted parts
    and comments are looked past; whatever has no meaning is left to the engine's parser.
    """
    seen = _HIDDEN.sub(lambda m: " " * len(m[0]) if m[0][:2] in ("--", "/*") else "x" * len(m[0]), sql)
    depth, order, end = 0, None, len(seen.rstrip("; \t\r\n"))
    for mark in _CLAUSES.finditer(seen):
        word = mark[0].lower()
        if word in "()":
            depth += 1 if word == "(" else -1
        elif depth == 0 and word.startswith("order"):
            order, end = mark, len(seen.rstrip("; \t\r\n"))
        elif depth == 0 and order and end > mark.start():
            end = mark.start()
    if order is None or order[1]:
        return None
    keys = ", ".join(f"{i} {'DESC' if descending else 'ASC'}" for i in range(1, columns + 1))
    return f"{sql[:end]}\n, {keys}\n{sql[end:]}"


def _sources(text: Column) -> Column:
    """(names, joins): the tables named in FROM clauses, and the joins and commas between
    them, of a query and its subqueries however deep, read once with a stack."""
    steps = F.regexp_extract_all(text, F.lit(_STEPS), F.lit(0))
    start = F.struct(
        F.lit(_ELSEWHERE).alias("at"),
        F.array().cast("array<int>").alias("outer"),
        F.array().cast("array<string>").alias("names"),
        F.lit(0).alias("joins"),
    )

    def step(acc: Column, m: Column) -> Column:
        at, outer = acc["at"], acc["outer"]
        opens, closes = m.endswith("("), m == ")"
        distinct = m.startswith("distinct")
        begins = m.startswith("from") & (at != _ARGUMENTS)
        comma = m.startswith(",") & at.isin(_AFTER, _JOINING)
        join = m.startswith("join") & (at != _ARGUMENTS)
        table = begins | join | comma
        name = F.regexp_extract(m, rf"^(?:(?:from|join)\s+(?:lateral\s+)?|,\s*)({_NAME})$", 1)
        condition = m.isin("on", "using") & at.isin(_AFTER, _JOINING)
        moved = (
            F.when(opens & (m != "("), _ARGUMENTS)
            .when(opens, _ELSEWHERE)
            .when(closes, F.coalesce(F.try_element_at(outer, F.lit(-1)), F.lit(_ELSEWHERE)))
            .when(table, F.when(name == "", _BEFORE).otherwise(_AFTER))
            .when(condition, _JOINING)
            .when(distinct | m.startswith(",") | m.startswith("from") | (at == _ARGUMENTS), at)
            .otherwise(_ELSEWHERE)
        )
        # A derived table is a table of its list: after it, a comma brings another one.
        kept = F.when(opens, F.concat(outer, F.array(F.when(at == _BEFORE, _AFTER).otherwise(at))))
        return F.struct(
            moved.alias("at"),
            kept.when(closes, F.slice(outer, F.lit(1), F.greatest(F.size(outer) - 1, F.lit(0)))).otherwise(outer).alias("outer"),
            F.when(table & (name != ""), F.concat(acc["names"], F.array(name))).otherwise(acc["names"]).alias("names"),
            (acc["joins"] + (join | comma).cast("int")).alias("joins"),
        ).cast(_READER)

    return F.aggregate(steps, start.cast(_READER), step)


def _strip_quotes(name: Column) -> Column:
    last = F.substring_index(name, ".", -1)
    return F.regexp_replace(last, '"', "")


def _tables(text: Column, names: Column) -> Column:
    cte = r'(?:\bwith\s+(?:recursive\s+)?|,\s*)("[^"]+"|[a-z_][a-z0-9_]*)\s*(?:\([^()]*\)\s*)?as\s*\('
    ctes = F.when(
        text.rlike(r"^\s*with\b"), F.regexp_extract_all(text, F.lit(cte), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    told = F.transform(names, _strip_quotes)
    return F.array_sort(F.array_distinct(F.array_except(told, F.transform(ctes, _strip_quotes))))


def _known(calls: Column, names: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.array_sort(F.array_distinct(F.filter(calls, lambda f: F.array_contains(wanted, f))))


def query_shape(sql: Column) -> Column:
    """What reports compare about a query, each text pass made once:

    ``tables`` (after FROM and JOIN at any depth, without CTEs), ``joins`` (JOIN words and
    commas between tables), ``aggregates``, ``grouped``, ``dates`` (date functions), and ``columns`` of the
    outer SELECT list (NULL when the text is no SELECT).
    """

    def shape(v: Column) -> Column:
        current = F.when(
            v["text"].rlike(r"\bcurrent_date\b"), F.array(F.lit("current_date"))
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(
            _tables(v["text"], v["sources"]["names"]).alias("tables"),
            v["sources"]["joins"].alias("joins"),
            _known(v["calls"], AGGREGATES).alias("aggregates"),
            v["text"].rlike(r"\bgroup\s+by\b").alias("grouped"),
            F.array_distinct(F.concat(_known(v["calls"], DATE_FUNCTIONS), current)).alias("dates"),
            F.when(v["outer"]["part"] > 0, v["outer"]["commas"] + 1).alias("columns"),
        )

    def passes(text: Column) -> Column:
        calls = F.regexp_extract_all(text, F.lit(r"\b([a-z_][a-z0-9_]*)\s*\("), F.lit(1))
        return F.struct(
            text.alias("text"),
            _sources(text).alias("sources"),
            calls.alias("calls"),
            _outer(text).alias("outer"),
        )

    return bind(bind(visible(sql), passes), shape)


def table_names(sql: Column) -> Column:
    return query_shape(sql)["tables"]


def join_count(sql: Column) -> Column:
    return query_shape(sql)["joins"]


def output_columns(sql: Column) -> Column:
    return query_shape(sql)["columns"]


# --- hardness of a query, from the counts of its parsed form -----------------------------

_CONDITION = "struct<negated:boolean,op:int,nested:int>"
#: One line per query; counts and lists are what the difficulty rules look at.
PARSED = (
    "select_aggs array<int>, table_units int, "
    f"from_conds array<{_CONDITION}>, from_ops array<string>, "
    f"where_conds array<{_CONDITION}>, where_ops array<string>, "
    "group_aggs array<int>, "
    f"having_conds array<{_CONDITION}>, having_ops array<string>, "
    "order_aggs array<int>, has_limit boolean, "
    "has_intersect boolean, has_union boolean, has_except boolean"
)
# Fixed value: the number of the LIKE operator in the parsed form.
LIKE = 9


def _count(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))


def hardness_counts() -> tuple[Column, Column, Column]:
    """(first component, nested queries, other features) of a ``PARSED`` line."""
    conds = F.concat("from_conds", "where_conds", "having_conds")
    ops = F.concat("from_ops", "where_ops", "having_ops")
    first = (
        (F.size("where_conds") > 0).cast("int")
        + (F.size("group_aggs") > 0).cast("int")
        + (F.size("order_aggs") > 0).cast("int")
        + F.col("has_limit").cast("int")
        + F.greatest(F.col("table_units") - 1, F.lit(0))
        + _count(ops, lambda o: o == "or")
        + _count(conds, lambda c: c["op"] == LIKE)
    )
    nested = (
        F.aggregate(conds, F.lit(0), lambda a, c: a + c["nested"])
        + F.col("has_intersect").cast("int")
        + F.col("has_union").cast("int")
        + F.col("has_except").cast("int")
    )

    def aggs(name: str) -> Column:
        return _count(F.col(name), lambda a: a != 0)

    # The published rule reads the NOT flag of a condition as its aggregate; kept as is.
    n_aggs = (
        aggs("select_aggs")
        + aggs("group_aggs")
        + aggs("order_aggs")
        + _count(F.concat("where_conds", "having_conds"), lambda c: c["negated"])
    )
    others = (
        (n_aggs > 1).cast("int")
        + (F.size("select_aggs") > 1).cast("int")
        + (F.size("where_conds") > 1).cast("int")
        + (F.size("group_aggs") > 1).cast("int")
    )
    return first, nested, others


def hardness(first: Column, nested: Column, others: Column) -> Column:
    """easy, medium, hard or extra."""
    flat = nested == 0
    return (
        F.when((first <= 1) & (others == 0) & flat, "easy")
        .when(
            flat & (((others <= 2) & (first <= 1)) | ((first <= 2) & (others < 2))), "medium"
        )
        .when(
            (flat & (others > 2) & (first <= 2))
            | (flat & (first > 2) & (first <= 3) & (others <= 2))
            | ((first <= 1) & (others == 0) & (nested <= 1)),
            "hard",
        )
        .otherwise("extra")
    )

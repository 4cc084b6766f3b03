"""Question, SQL and model-output text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, and the typographic characters made plain.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2212"
SINGLE_QUOTES = "\u2018\u2019"
DOUBLE_QUOTES = "\u201c\u201d"
THIN_SPACES = "\u00a0\u202f\u2009"

# ASCII is listed first and runs are possessive for speed: the classes alone say the same.
_WORD = r"[a-zA-Z0-9_\p{L}\p{N}]++"
_SPACE_RUN = f"[{WHITESPACE}]+"
_THINK = r"(?s)<think>.*?</think>"
_FENCE = r"(?s)```[A-Za-z]*+[ \t]*+\n?+(.*?)(?:```|\z)"
# Quoted text and comments up to their end (or the end of the text), other text up to `;`.
_STATEMENT = (
    r"""(?s)\A(?:[^;'"/-]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|--[^\n]*+"""
    r"""|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|[-/])*+"""
)
_PIECE = (
    r"""(?s)'[^']*+'(?:'[^']*+')*+|"[^"]*+"(?:"[^"]*+")*+|--[^\n]*+|/\*.*?\*/"""
    rf"""|[{WHITESPACE}]++|[^{WHITESPACE}'"]++|."""
)


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACE_RUN, " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))


def normalize_question(c: Column) -> Column:
    return F.array_join(words(c), " ")


def normalize_sql(c: Column) -> Column:
    return collapse(F.rtrim(F.lower(c), F.lit("; \n")))


def token_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two token sets; two empty sets count as equal."""
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def plain_text(c: Column) -> Column:
    """ASCII hyphens, quotes and spaces instead of their typographic variants."""
    found = HYPHENS + SINGLE_QUOTES + DOUBLE_QUOTES + THIN_SPACES
    plain = (
        "-" * len(HYPHENS)
        + "'" * len(SINGLE_QUOTES)
        + '"' * len(DOUBLE_QUOTES)
        + " " * len(THIN_SPACES)
    )
    return collapse(F.translate(c, found, plain))


def first_statement(c: Column) -> Column:
    """Everything up to the first ``;`` outside quotes and comments."""
    return F.regexp_extract(c, _STATEMENT, 0)


def clean_sql(c: Column) -> Column:
    """Model output without thinking blocks and code fences: one statement ending in ``;``."""
    answer = F.regexp_replace(c, _THINK, "")
    answer = F.when(
        answer.contains("</think>"), F.substring_index(answer, "</think>", -1)
    ).otherwise(answer)
    answer = F.when(answer.contains("```"), F.regexp_extract(answer, _FENCE, 1)).otherwise(answer)
    sql = strip(first_statement(answer))
    return F.when(sql != "", F.concat(sql, F.lit(";"))).otherwise(F.lit(""))


def pieces(sql: Column) -> Column:
    """Quoted strings, comments, whitespace runs and other text runs, in order."""
    return F.regexp_extract_all(sql, F.lit(_PIECE), F.lit(0))


def one_line(c: Column) -> Column:
    """The first statement without comments, whitespace collapsed outside quotes."""
    def is_gap(p: Column) -> Column:
        return p.startswith("--") | p.startswith("/*") | (strip(p) == "")

    parts = F.transform(
        pieces(clean_sql(c)), lambda p: F.when(is_gap(p), F.lit(" ")).otherwise(p)
    )
    kept = F.filter(
        parts, lambda p, i: (p != " ") | ((i > 0) & (F.get(parts, i - 1) != " "))
    )
    out = F.regexp_replace(F.btrim(F.array_join(kept, "")), r" ;\z", ";")
    return F.when(out == ";", F.lit("")).otherwise(out)

"""Canonical cells: the one form in which query results are compared, sorted and hashed.

A row is ``ARRAY<STRUCT<tag INT, num DOUBLE, str STRING>>``: tag 0 is NULL, tag 1 a finite
number, tag 2 any other text. Infinite and NaN numbers have tag 2 and keep ``num``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-6
DIGITS = 6
CELL = "struct<tag:int,num:double,str:string>"
# Fixed value: what counts as a number inside a text cell.
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_TEXT_SPACE = " \t\n\x0b\x0c\r"


def _cell(tag: Column, num: Column, text: Column) -> Column:
    return F.struct(
        tag.cast("int").alias("tag"),
        num.cast("double").alias("num"),
        text.cast("string").alias("str"),
    )


def _number(v: Column) -> Column:
    special = F.when(F.isnan(v), F.lit("nan")).when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    none = F.lit(None)
    return (
        F.when(v.isNull(), _cell(F.lit(0), none, none))
        .when(finite, _cell(F.lit(1), F.when(v == 0, F.lit(0.0)).otherwise(v), none))
        .otherwise(_cell(F.lit(2), v, special))
    )


def _text(v: Column) -> Column:
    trimmed = F.btrim(v, F.lit(_TEXT_SPACE))
    return F.when(
        trimmed.rlike(NUMBER), _number(trimmed.try_cast("double"))
    ).otherwise(_plain_text(v))


def _plain_text(v: Column) -> Column:
    none = F.lit(None)
    return F.when(v.isNull(), _cell(F.lit(0), none, none)).otherwise(_cell(F.lit(2), none, v))


def cell(c: Column, dtype: T.DataType, numeric_text: bool = True) -> Column:
    """One value in canonical form; ``numeric_text`` reads text like ``" 4e1 "`` as a number.

    Without it, text stays text and booleans are no numbers, as a table on screen shows them.
    """
    if isinstance(dtype, T.NumericType) or (numeric_text and isinstance(dtype, T.BooleanType)):
        return _number(c.cast("double"))
    if isinstance(dtype, T.BinaryType):
        c = F.lower(F.hex(c))
    text = c if isinstance(dtype, T.StringType) else c.cast("string")
    return _text(text) if numeric_text else _plain_text(text)


def row_cells(
    df: DataFrame, columns: list[str] | None = None, numeric_text: bool = True
) -> Column:
    """All columns of ``df`` (in order) as one canonical row."""
    names = df.columns if columns is None else columns
    return F.array(*[cell(F.col(f"`{n}`"), df.schema[n].dataType, numeric_text) for n in names])


def row_key(cells: Column) -> Column:
    """The sort key of a row: numbers rounded to 6 decimals."""
    return F.transform(
        cells,
        lambda c: F.struct(
            c["tag"].alias("tag"),
            F.when(c["tag"] == 1, F.bround(c["num"], DIGITS)).alias("num"),
            F.coalesce(c["str"], F.lit("")).alias("str"),
        ),
    )


def _number_text(v: Column) -> Column:
    rounded = F.bround(v, DIGITS)
    # Adding 0.0 turns -0.0 into 0.0, so both write the same text.
    fixed = (rounded + F.lit(0.0)).try_cast("decimal(38,6)").cast("string")
    return F.when(F.abs(v) < 1e15, fixed).otherwise(F.format_string("%.16e", v))


def row_text(cells: Column) -> Column:
    """One text per row; equal exactly when the row keys are equal."""
    parts = F.transform(
        cells,
        lambda c: F.when(c["tag"] == 0, F.lit("0"))
        .when(c["tag"] == 1, F.concat(F.lit("1:"), _number_text(c["num"])))
        .otherwise(
            F.concat(
                F.when(c["num"].isNull(), F.lit("2:")).otherwise(F.lit("3:")),
                F.char_length(c["str"]).cast("string"),
                F.lit(":"),
                c["str"],
            )
        ),
    )
    return F.concat(F.size(cells).cast("string"), F.lit("|"), F.array_join(parts, "|"))


def same_cell(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal, or finite numbers within the relative or absolute tolerance. NaN never matches."""
    x, y = a["num"], b["num"]
    infinite = (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    reach = F.greatest(tolerance * F.greatest(F.abs(x), F.abs(y)), F.lit(tolerance))
    close = ~F.isnan(x) & ~F.isnan(y) & ((x == y) | (~infinite & (F.abs(x - y) <= reach)))
    plain = x.isNull() & y.isNull() & (a["tag"] == b["tag"]) & a["str"].eqNullSafe(b["str"])
    return F.when(x.isNotNull() & y.isNotNull(), close).otherwise(plain)


def same_row(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Same width and every cell the same."""
    cells_agree = F.forall(
        F.zip_with(a, b, lambda u, v: F.coalesce(same_cell(u, v, tolerance), F.lit(False))),
        lambda ok: ok,
    )
    return a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & cells_agree


def relaxed_row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row for the relaxed comparison: numbers to 6 significant digits, names ignored."""
    names = df.columns if columns is None else columns
    parts = []
    for n in names:
        c, dtype = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(dtype, T.NumericType):
            v = c.cast("double") + F.lit(0.0)
            value = F.concat(F.lit("n:"), F.format_string("%.5e", v))
        else:
            value = F.concat(F.lit("s:"), F.char_length(c.cast("string")), F.lit(":"), c.cast("string"))
        parts.append(F.coalesce(F.when(c.isNotNull(), value), F.lit("0")))
    return F.array_join(F.array(*parts), "|")

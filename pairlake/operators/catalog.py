"""Schemas and profiles of user tables, and the prompt text made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits on example values, and DuckDB's reserved words.
MAX_DISTINCT = 20
MAX_EXAMPLES = 2
MAX_EXAMPLE_CHARS = 40
RESERVED = tuple(
    "all analyse analyze and any array as asc asymmetric both case cast check collate column "
    "constraint create default deferrable desc describe distinct do else end except false fetch "
    "for foreign from group having in initially intersect into lambda lateral leading limit not "
    "null offset on only or order pivot pivot_longer pivot_wider placing primary qualify "
    "references returning select show some summarize symmetric table then to trailing true union "
    "unique unpivot using variadic when where window with".split()
)
_TYPE_NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN",
    T.StringType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
}
_CATALOG = "table string, ordinal int, column string, type string"
# Buckets of the cheap lower bound on a column's distinct values.
_BUCKETS = 1024


def type_name(dtype: T.DataType) -> str:
    """A Spark type in DuckDB's spelling."""
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return f"{type_name(dtype.elementType)}[]"
    return _TYPE_NAMES.get(type(dtype), dtype.simpleString().upper())


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, ordinal, column, type``, one line per column (metadata only)."""
    lines = [
        (name, i, f.name, type_name(f.dataType))
        for name in sorted(tables, key=lambda n: (n.lower(), n))
        for i, f in enumerate(tables[name].schema.fields, 1)
    ]
    return spark.createDataFrame(lines, _CATALOG)


def _few_valued(df: DataFrame) -> list[str]:
    """Text columns that may have at most MAX_DISTINCT values.

    Values fall into hash buckets; more buckets than MAX_DISTINCT prove more values. The
    sets hold at most _BUCKETS numbers each, so free-text columns leave here without
    their values ever being grouped.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return []
    buckets = [
        F.size(F.collect_set(F.when(_q(c).isNotNull(), F.pmod(F.xxhash64(_q(c)), F.lit(_BUCKETS))))).alias(
            f"c{i}"
        )
        for i, c in enumerate(text)
    ]
    seen = df.agg(*buckets).first()
    return [c for i, c in enumerate(text) if 0 < seen[f"c{i}"] <= MAX_DISTINCT]


def usable_example(v: Column) -> Column:
    return (
        F.char_length(v).between(1, MAX_EXAMPLE_CHARS)
        & ~v.rlike(r"[\x00-\x1f\x7f]")
        & ~v.contains("*/")
    )


def example_values(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, examples``: the most frequent values of few-valued text columns.

    The limit of 20 distinct values counts all of them; only usable ones are shown.
    """
    counts = []
    for name, df in tables.items():
        columns = _few_valued(df)
        if not columns:
            continue
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("value")) for c in columns]))
        counts.append(
            df.select(cells.alias("cell"))
            .filter(F.col("cell.value").isNotNull())
            .groupBy(F.lit(name).alias("table"), F.col("cell.column"), F.col("cell.value"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
    if not counts:
        return spark.createDataFrame([], "table string, column string, examples array<string>")
    per_column = Window.partitionBy("table", "column")
    ranked = (
        _union(counts)
        .withColumn("_distinct", F.count(F.lit(1)).over(per_column))
        .filter((F.col("_distinct") <= MAX_DISTINCT) & usable_example(F.col("value")))
        .withColumn("_rank", F.row_number().over(per_column.orderBy(F.desc("n"), "value")))
        .filter(F.col("_rank") <= MAX_EXAMPLES)
    )
    return ranked.groupBy("table", "column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda e: e["value"]
        ).alias("examples")
    )


def schema_json(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The catalog with ``examples`` where a column has any."""
    return catalog(spark, tables).join(example_values(spark, tables), ["table", "column"], "left")


def ident(name: Column) -> Column:
    """A plain identifier as it is, any other name quoted."""
    plain = name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z") & ~F.lower(name).isin(*RESERVED)
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain, name).otherwise(quoted)


def _literal(v: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))


def column_text(name: Column, type_: Column, examples: Column) -> Column:
    shown = F.concat(
        F.lit(" /* e.g. "), F.array_join(F.transform(examples, _literal), ", "), F.lit(" */")
    )
    return F.concat(
        ident(name),
        F.lit(" "),
        type_,
        F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, shown).otherwise(F.lit("")),
    )


def serialize(columns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``CREATE TABLE t (c TYPE, …);`` per table, one line each → ``schema_text``.

    ``columns``: ``table, ordinal, column, type, examples`` and the grouping ``keys``.
    """
    line = column_text(F.col("column"), F.col("type"), F.col("examples"))
    per_table = (
        columns.withColumn("_line", line)
        .groupBy(*keys, "table")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "_line"))).alias("_cols"))
        .withColumn(
            "_ddl",
            F.concat(
                F.lit("CREATE TABLE "),
                ident(F.col("table")),
                F.lit(" ("),
                F.array_join(F.transform("_cols", lambda c: c["_line"]), ", "),
                F.lit(");"),
            ),
        )
    )
    ordered = F.array_sort(
        F.collect_list(F.struct(F.lower("table").alias("low"), F.col("table").alias("name"), "_ddl"))
    )
    return per_table.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda t: t["_ddl"]), "\n").alias("schema_text")
    )


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, ordinal, column, n_rows, n_nulls, lo, hi``: one pass per table.

    ``lo`` and ``hi`` (10 characters) are set for dates, timestamps and ``year`` columns.
    """
    frames = []
    for name, df in tables.items():
        aggs, lines = [F.count(F.lit(1)).alias("n")], []
        for i, f in enumerate(df.schema.fields):
            c = _q(f.name)
            ranged = f.name.lower() == "year" or isinstance(
                f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
            )
            aggs.append(F.count(c).alias(f"p{i}"))
            if ranged:
                aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]

            def shown(end: str, i: int = i, ranged: bool = ranged) -> Column:
                return F.substring(F.col(f"{end}{i}").cast("string"), 1, 10) if ranged else F.lit(None).cast("string")

            lines.append(
                F.struct(
                    F.lit(i + 1).alias("ordinal"),
                    F.lit(f.name).alias("column"),
                    F.col("n").alias("n_rows"),
                    (F.col("n") - F.col(f"p{i}")).alias("n_nulls"),
                    shown("lo").alias("lo"),
                    shown("hi").alias("hi"),
                )
            )
        wide = df.agg(*aggs)
        frames.append(
            wide.select(F.lit(name).alias("table"), F.explode(F.array(*lines)).alias("p")).select(
                "table", "p.*"
            )
        )
    return _union(frames)


def data_notes(profiled: DataFrame) -> DataFrame:
    """The profile as text: row counts, ranges, columns with NULLs (bounded by columns)."""
    place = F.concat(F.col("table"), F.lit("."), F.col("column"))
    count = F.when(
        F.col("ordinal") == 1, F.concat(F.col("table"), F.lit(" "), F.col("n_rows").cast("string"))
    )
    span = F.when(F.col("lo").isNotNull(), F.concat(place, F.lit(" "), F.col("lo"), F.lit(" to "), F.col("hi")))
    nulls = F.when(
        F.col("n_nulls") > 0,
        F.concat(
            place, F.lit(" ("), F.col("n_nulls").cast("string"), F.lit(" of "),
            F.col("n_rows").cast("string"), F.lit(")"),
        ),
    )

    def listed(text: Column, separator: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("table", "ordinal", text.alias("t")))))
        return F.array_join(F.transform(items, lambda i: i["t"]), separator)

    lists = profiled.agg(
        listed(count, ", ").alias("c"), listed(span, "; ").alias("r"), listed(nulls, ", ").alias("n")
    )
    return lists.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Row counts: "), F.col("c"), F.lit(".")),
            F.when(F.col("r") != "", F.concat(F.lit("Ranges: "), F.col("r"), F.lit("."))),
            F.when(F.col("n") != "", F.concat(F.lit("NULLs: "), F.col("n"), F.lit("."))),
        ).alias("notes")
    )

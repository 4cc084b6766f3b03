"""Repair of loosely typed tables: declared types, numbers stored as text, bad bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical whole and decimal numbers (no leading zeros, signs or spaces).
INTEGER = r"\A-?(0|[1-9][0-9]{0,17})\z"
DECIMAL = r"\A-?(0|[1-9][0-9]*)\.[0-9]+\z"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def retype(df: DataFrame, declared: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Cast text columns to their declared types where every value allows it.

    A column that only fails on empty strings reads them as NULL; any other failure keeps
    it as text. One aggregation decides all columns. Returns the table and its notes
    (``cast``, ``empty_as_null`` or ``kept``).
    """
    checks = []
    for i, (name, typ) in enumerate(declared.items()):
        c = _quoted(name)
        fails = c.isNotNull() & c.try_cast(typ).isNull()
        checks += [F.count_if(fails).alias(f"f{i}"), F.count_if(fails & (c != "")).alias(f"g{i}")]
    counts = df.agg(*checks).first()
    notes, out = {}, []
    for name in df.columns:
        c = _quoted(name)
        if name not in declared:
            out.append(c)
            continue
        i, typ = list(declared).index(name), declared[name]
        if counts[f"f{i}"] == 0:
            notes[name] = "cast"
            out.append(c.cast(typ).alias(name))
        elif counts[f"g{i}"] == 0:
            notes[name] = "empty_as_null"
            out.append(F.nullif(c, F.lit("")).cast(typ).alias(name))
        else:
            notes[name] = "kept"
            out.append(c)
    return df.select(*out), notes


def numbers_from_text(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Text columns whose every value is a canonical number become BIGINT or DOUBLE."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checks = []
    for i, name in enumerate(text):
        c = _quoted(name)
        whole = c.rlike(INTEGER)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(whole).alias(f"i{i}"),
            F.count_if(whole | c.rlike(DECIMAL)).alias(f"d{i}"),
        ]
    counts = df.agg(*checks).first() if checks else None
    types = {}
    for i, name in enumerate(text):
        n = counts[f"n{i}"]
        if n and counts[f"i{i}"] == n:
            types[name] = "bigint"
        elif n and counts[f"d{i}"] == n:
            types[name] = "double"
    out = [_quoted(c).cast(types[c]).alias(c) if c in types else _quoted(c) for c in df.columns]
    return df.select(*out), types


def decode(c: Column) -> Column:
    """Bytes as UTF-8 text; invalid bytes become U+FFFD, NULL stays apart from ''."""
    return F.make_valid_utf8(c.cast("string"))


def pivot_indicators(
    observations: DataFrame,
    entities: DataFrame,
    indicators: dict[str, int],
    entity: str = "iso3",
    period: str = "year",
    order: str = "seq",
) -> DataFrame:
    """Long ``(entity, period, indicator, value)`` → one column per indicator.

    ``indicators`` maps each name to the decimals kept; 0 gives BIGINT. Rows without any
    value and entities that are not listed are dropped; the last of repeated observations
    (by ``order``) stays.
    """
    known = observations.join(entities.select(entity).distinct(), entity, "left_semi")
    cells = []
    for name, digits in indicators.items():
        value = F.max_by("value", F.when(F.col("indicator") == name, F.col(order)))
        rounded = F.bround(value, digits)
        cells.append((rounded.cast("bigint") if digits == 0 else rounded).alias(name))
    wide = known.groupBy(entity, period).agg(*cells)
    return wide.dropna(how="all", subset=list(indicators))


def table_name(file_name: Column) -> Column:
    """A table name from a file name: lower-case letters, digits and underscores."""
    base = F.lower(F.regexp_replace(file_name, r"\.[^.]+\z", ""))
    name = F.btrim(F.regexp_replace(base, "[^a-z0-9_]+", "_"), F.lit("_"))
    shown = F.when(name == "", F.lit("data")).otherwise(name)
    return F.when(name.rlike("^[a-z_]"), name).otherwise(F.concat(F.lit("t_"), shown))


def nested_countries(raw: DataFrame, column: str = "body") -> DataFrame:
    """API country lists (``[meta, rows]`` as JSON text) → ``iso3, name, region, …``.

    Aggregates (region ``NA``) are dropped, text is trimmed, a blank capital is NULL.
    """
    entry = (
        "array<struct<id:string,name:string,region:struct<id:string,value:string>,"
        "incomeLevel:struct<value:string>,capitalCity:string>>"
    )
    rows = F.from_json(F.get_json_object(column, "$[1]"), entry)
    item = raw.select(F.explode(rows).alias("c")).filter(F.col("c.region.id") != "NA")
    return item.select(
        F.col("c.id").alias("iso3"),
        F.trim("c.name").alias("name"),
        F.trim("c.region.value").alias("region"),
        F.trim("c.incomeLevel.value").alias("income_group"),
        F.nullif(F.trim("c.capitalCity"), F.lit("")).alias("capital_city"),
    )


def nested_observations(raw: DataFrame, column: str = "body", indicator: str = "indicator") -> DataFrame:
    """API indicator documents → long ``iso3, year, indicator, value``."""
    entry = "array<struct<countryiso3code:string,date:string,value:double>>"
    rows = F.from_json(F.get_json_object(column, "$[1]"), entry)
    return raw.select(indicator, F.explode(rows).alias("r")).select(
        F.col("r.countryiso3code").alias("iso3"),
        F.col("r.date").cast("bigint").alias("year"),
        F.col(indicator).alias("indicator"),
        F.col("r.value").alias("value"),
    )

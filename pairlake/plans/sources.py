"""Registered queries: files in and out, uploads, nested documents, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators import merge, repair
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query
from pairlake.session import scratch
from pairlake.sources import files


@query(
    "s1_read_jsonl",
    f"WITH {roles.DOC_PAIRS} SELECT CAST(id AS VARCHAR) AS id, db_id, question, sql, source FROM doc_pairs",
)
def read_jsonl(t: Tables) -> DataFrame:
    """Pairs written as JSON lines and read back with a fixed schema."""
    path = scratch(t.spark, "pairs")
    pairs = roles.doc_pairs(t).withColumn("id", F.col("id").cast("string")).drop("seq")
    files.write_jsonl(pairs, path)
    return files.read_jsonl(t.spark, path, files.PAIRS).select("id", "db_id", "question", "sql", "source")


@query(
    "s2_write_json_report",
    """
SELECT '{"lang":"' || lang || '","source":"' || source || '","n":' || count(*) || ',"longest":' || max(n_chars)
  || ',"sample":' || to_json(min(text))::VARCHAR || ',"note":null}' AS line
FROM documents GROUP BY lang, source""",
)
def write_json_report(t: Tables) -> DataFrame:
    """A report per language and source as JSON lines, non-ASCII text kept."""
    path = scratch(t.spark, "report")
    report = t.documents.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("n_chars").alias("longest"),
        F.min("text").alias("sample"),
        F.lit(None).cast("string").alias("note"),
    )
    files.write_jsonl(report, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "s3_prediction_logs",
    f"""
WITH {roles.LOG}
SELECT CAST(id AS VARCHAR) AS id, latency_ms, tokens_out, tokens_in, model, 'app' AS runtime, 'events' AS "set" FROM log""",
)
def prediction_logs(t: Tables) -> DataFrame:
    """Logs named model__runtime__set, resumed once: the later line of an id counts."""
    path = scratch(t.spark, "logs")
    log = roles.prediction_log(t).select(
        F.col("id").cast("string").alias("id"),
        F.lit("SELECT 1;").alias("sql"),
        "latency_ms",
        "tokens_out",
        "tokens_in",
        F.concat(F.col("model"), F.lit("__app__events.jsonl")).alias("run"),
    )
    first_try = log.filter("latency_ms < 30").withColumn("latency_ms", F.lit(-1.0))
    for part in (first_try, log):
        part.write.mode("append").partitionBy("run").json(path)
    return files.read_predictions(t.spark, path).drop("sql")


@query(
    "s4_csv_null_marker",
    """
SELECT c_custkey, c_name, nullif(c_mktsegment, 'AUTOMOBILE') AS c_mktsegment, c_acctbal FROM customer""",
)
def csv_null_marker(t: Tables) -> DataFrame:
    """Customers as CSV with NA for NULL, types inferred on the way back."""
    path = scratch(t.spark, "csv")
    rows = t.customer.select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("AUTOMOBILE")).alias("c_mktsegment"), "c_acctbal"
    )
    rows.write.csv(path, header=True, nullValue="NA")
    return files.read_csv(t.spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(
    "s5_upload_names",
    r"""
WITH names AS (
  SELECT page_id, regexp_extract(url, '[^/]*$') AS file FROM pages),
clean AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(lower(file), '\.[^.]+$', ''), '[^a-z0-9_]+', '_', 'g'), '_') AS name
  FROM names)
SELECT page_id, CASE WHEN regexp_matches(name, '^[a-z_]') THEN name
  WHEN name = '' THEN 't_data' ELSE 't_' || name END AS table_name FROM clean""",
)
def upload_names(t: Tables) -> DataFrame:
    """Table names for the last path segment of every page."""
    name = F.substring_index("url", "/", -1)
    return t.pages.select("page_id", repair.table_name(name).alias("table_name"))


@query(
    "s5_upload_views",
    "SELECT 'order_lines_2024' AS view, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(12,2)))::DOUBLE AS total FROM lineitem "
    "UNION ALL SELECT 't_1995_customers', count(*), sum(CAST(c_acctbal AS DECIMAL(12,2)))::DOUBLE FROM customer",
)
def upload_views(t: Tables) -> DataFrame:
    """A Parquet and a CSV upload, each opened as a view named after its file."""
    folder = scratch(t.spark, "uploads")
    t.lineitem.write.parquet(f"{folder}/Order lines-2024.parquet")
    t.customer.write.csv(f"{folder}/1995 Customers.csv", header=True)
    out = []
    for file, money in (("Order lines-2024.parquet", "l_extendedprice"), ("1995 Customers.csv", "c_acctbal")):
        view = files.open_upload(t.spark, f"{folder}/{file}")
        out.append(
            t.spark.table(view).agg(
                F.lit(view).alias("view"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col(money).cast("decimal(12,2)")).cast("double").alias("total"),
            )
        )
    return out[0].unionByName(out[1])


@query(
    "s6_nested_countries",
    """
SELECT c_name AS iso3, c_name AS name, c_mktsegment AS region, 'income ' || c_nationkey AS income_group,
       CASE WHEN c_acctbal >= 0 THEN 'city ' || c_custkey END AS capital_city
FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def nested_countries(t: Tables) -> DataFrame:
    """API-style country documents: aggregates dropped, text trimmed, blanks NULL."""
    entry = F.struct(
        F.col("c_name").alias("id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")).alias("name"),
        F.struct(
            F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("id"),
            F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("value"),
        ).alias("region"),
        F.struct(F.concat(F.lit("income "), F.col("c_nationkey").cast("string")).alias("value")).alias("incomeLevel"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("city "), F.col("c_custkey").cast("string")))
        .otherwise(F.lit("  "))
        .alias("capitalCity"),
    )
    body = F.concat(F.lit('[{"pages":1},'), F.to_json(F.array(entry)), F.lit("]"))
    return repair.nested_countries(t.customer.select(body.alias("body")))


@query(
    "s6_nested_observations",
    """
SELECT l_returnflag AS iso3, year(l_shipdate) AS year, l_linestatus AS indicator, count(*) AS n,
       sum(CAST(l_quantity AS DECIMAL(12,2)))::DOUBLE AS total
FROM lineitem GROUP BY ALL""",
)
def nested_observations(t: Tables) -> DataFrame:
    """One API-style document per order line, flattened to observations."""
    entry = F.struct(
        F.col("l_returnflag").alias("countryiso3code"),
        F.year("l_shipdate").cast("string").alias("date"),
        F.col("l_quantity").alias("value"),
    )
    body = F.concat(F.lit('[{"pages":1},'), F.to_json(F.array(entry)), F.lit("]"))
    raw = t.lineitem.select(F.col("l_linestatus").alias("indicator"), body.alias("body"))
    flat = repair.nested_observations(raw)
    return flat.groupBy("iso3", "year", "indicator").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"),
    )


@query("s7_manifest")
def manifest(t: Tables) -> DataFrame:
    """Digests of the table files against a manifest: one file changed, one missing."""
    found = files.file_digests(t.spark, t.folder, "*.parquet")
    pinned = found.select(
        F.when(F.col("file") == "pages.parquet", "gone.parquet").otherwise(F.col("file")).alias("file"),
        F.when(F.col("file") == "labels.parquet", F.sha2(F.col("sha256"), 256))
        .otherwise(F.col("sha256"))
        .alias("sha256"),
    )
    return files.verify_manifest(found, pinned)


@query(
    "s7_text_digests",
    """
SELECT lang, octet_length(encode(content)) AS length, sha256(content) AS sha256 FROM (
  SELECT lang, string_agg(sha256(text) || ' ' || doc_id, chr(10) ORDER BY doc_id) || chr(10) AS content
  FROM documents GROUP BY lang)""",
)
def text_digests(t: Tables) -> DataFrame:
    """One file per language, written as text: digests of small files whole, of large ones in pieces."""
    folder = scratch(t.spark, "texts")
    line = F.concat(F.sha2("text", 256), F.lit(" "), F.col("doc_id").cast("string")).alias("value")
    # Only the lines go to their file's task, not the texts behind them.
    lines = t.documents.select("lang", "doc_id", line).repartition("lang").sortWithinPartitions("lang", "doc_id")
    lines.select("lang", "value").write.partitionBy("lang").text(folder)
    found = files.file_digests(t.spark, folder, "part-*", whole=40_000)
    return found.select(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang"), "length", "sha256")


@query(
    "s8_replace_source",
    """
SELECT CAST(doc_id AS VARCHAR) AS id, lang AS db_id, source, text AS question FROM documents WHERE source <> 'src0'
UNION ALL
SELECT 'chat_' || conv_id || '_' || turn, 'chat', 'src0', text FROM conversations WHERE role = 'user'""",
)
def replace_source(t: Tables) -> DataFrame:
    """All rows of one source replaced by user turns."""
    train = t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("db_id"),
        "source",
        F.col("text").alias("question"),
    )
    fresh = t.conversations.filter("role = 'user'").select(
        F.concat_ws("_", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("chat").alias("db_id"),
        F.lit("src0").alias("source"),
        F.col("text").alias("question"),
    )
    return merge.replace_source(train, fresh, "src0")


@query(
    "s9_report_upsert",
    f"""
WITH {roles.OUTCOMES},
report AS (SELECT lang AS "set", source AS model, 'all' AS runtime, count(*) AS n, round(avg(n_chars), 1) AS score FROM documents GROUP BY ALL),
fresh AS (SELECT runtime AS "set", model, 'all' AS runtime, count(*) AS n, round(count(*) FILTER (ex) / count(*), 4) AS score
          FROM outcome_rows WHERE runtime <> 'es' GROUP BY ALL)
SELECT * FROM report r WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f."set" = r."set" AND f.model = r.model AND f.runtime = r.runtime)
UNION ALL SELECT * FROM fresh""",
)
def report_upsert(t: Tables) -> DataFrame:
    """Fresh scores replace report rows of the same set, model and runtime."""
    report = t.documents.groupBy(
        F.col("lang").alias("set"), F.col("source").alias("model"), F.lit("all").alias("runtime")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 1).alias("score"))
    fresh = (
        roles.outcome_rows(t)
        .filter("runtime <> 'es'")
        .groupBy(F.col("runtime").alias("set"), "model", F.lit("all").alias("runtime"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.count_if("ex") / F.count(F.lit(1)), 4).alias("score"),
        )
    )
    return merge.upsert(report, fresh, ["set", "model", "runtime"])

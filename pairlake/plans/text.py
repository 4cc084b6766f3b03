"""Registered queries: question, SQL and prompt text over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions import sqltext, text
from pairlake.operators import prompts as P
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query

# --- normal forms ---------------------------------------------------------------------------


@query(
    "n1_normalize_question",
    f"SELECT doc_id, {roles.norm_question('text')} AS normal FROM documents",
)
def normalize_question(t: Tables) -> DataFrame:
    """Whole documents as lower-case words joined by one space."""
    return t.documents.select("doc_id", text.normalize_question(F.col("text")).alias("normal"))


@query("n2_normalize_sql", f"SELECT page_id, {roles.norm_sql(chr(39) + ' ' + chr(39) + ' || html || ' + chr(39) + ' ;; ' + chr(39))} AS normal FROM pages")
def normalize_sql(t: Tables) -> DataFrame:
    """Page sources, treated as SQL text with trailing semicolons."""
    raw = F.concat(F.lit(" "), F.col("html"), F.lit(" ;; "))
    return t.pages.select("page_id", text.normalize_sql(raw).alias("normal"))


@query(
    "n3_token_set",
    f"""
SELECT doc_id, len({roles.tokens('text')})::INTEGER AS n_tokens,
       md5(array_to_string(list_sort({roles.tokens('text')}), ' ')) AS tokens_md5
FROM documents""",
)
def token_set(t: Tables) -> DataFrame:
    """Distinct words of every document."""
    tokens = text.token_set(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.size(tokens).alias("n_tokens"),
        F.md5(F.array_join(F.array_sort(tokens), " ")).alias("tokens_md5"),
    )


_TYPED = "‘" + "x’ — “y” "


@query(
    "n4_plain_text",
    f"""
SELECT doc_id, {roles.collapsed(
    "translate(replace(replace('" + _TYPED + "' || text, ' de ', chr(8201) || 'de' || chr(160)), '-', chr(8211)), "
    + "'" + text.HYPHENS + "' || '" + text.SINGLE_QUOTES + "' || '" + text.DOUBLE_QUOTES + "' || '" + text.THIN_SPACES + "', "
    + "'------' || chr(39) || chr(39) || '\"\"' || '   ')")} AS plain
FROM documents""",
)
def plain_text(t: Tables) -> DataFrame:
    """Documents with typographic characters put in, then made plain again."""
    raw = F.concat(F.lit(_TYPED), F.col("text"))
    raw = F.replace(raw, F.lit(" de "), F.lit(" de "))
    raw = F.replace(raw, F.lit("-"), F.lit("–"))
    return t.documents.select("doc_id", text.plain_text(raw).alias("plain"))


# --- model output ---------------------------------------------------------------------------


def model_output(t: Tables) -> DataFrame:
    """Assistant turns as the string literal of a fenced, commented, two-statement answer."""
    literal = F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    raw = F.concat(
        F.lit("<think>first; try\n</think>\nHere:\n```sql\nSELECT "),
        literal,
        F.lit(' AS "a;  b" -- note; here\n  FROM t /* x; y */ ;\nSELECT 2;\n```\nDone.'),
    )
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", raw.alias("raw"))


_LITERAL = "chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39)"


@query(
    "n5_clean_sql",
    f"""
SELECT conv_id, turn, 'SELECT ' || {_LITERAL} || ' AS "a;  b" -- note; here' || chr(10)
  || '  FROM t /* x; y */;' AS sql
FROM conversations WHERE role = 'assistant'""",
)
def clean_sql(t: Tables) -> DataFrame:
    """The first statement of each model answer."""
    return model_output(t).select("conv_id", "turn", text.clean_sql(F.col("raw")).alias("sql"))


@query(
    "n6_first_statement",
    r"""
SELECT page_id, regexp_extract(html,
  '\A(?:[^;''"/-]|''[^'']*(?:''|\z)|"[^"]*(?:"|\z)|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*(?:[^*]|\*+[^*/])*\**\z|[-/])*') AS statement
FROM pages""",
)
def first_statement(t: Tables) -> DataFrame:
    """Page sources up to the first semicolon outside quotes and comments."""
    return t.pages.select("page_id", text.first_statement(F.col("html")).alias("statement"))


@query(
    "n7_one_line",
    f"""
SELECT conv_id, turn, 'SELECT ' || {_LITERAL} || ' AS "a;  b" FROM t;' AS sql
FROM conversations WHERE role = 'assistant'""",
)
def one_line(t: Tables) -> DataFrame:
    """The same answers on one line, comments gone, quoted text untouched."""
    return model_output(t).select("conv_id", "turn", text.one_line(F.col("raw")).alias("sql"))


# --- query shapes ---------------------------------------------------------------------------


def sql_texts(t: Tables) -> DataFrame:
    """One query per document, its shape chosen by language, the text as a literal."""
    literal = F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    en = F.concat(
        F.lit("SELECT a.x, count(*) AS n, max(b.y) FROM main.alpha AS a JOIN beta b ON a.k = b.k WHERE a.s = "),
        literal,
        F.lit(" GROUP BY a.x ORDER BY n DESC, (a.x) LIMIT 5;"),
    )
    fr = F.concat(
        F.lit('SELECT q.s FROM delta AS d, (SELECT s, row_number() OVER (ORDER BY s) AS r FROM "gamma" WHERE s <> '),
        literal,
        F.lit(" ORDER BY s LIMIT 3) AS q -- ORDER BY 1"),
    )
    de = F.concat(
        F.lit("WITH c AS (SELECT extract(year FROM d) AS y, "),
        literal,
        F.lit(" AS s FROM epsilon) SELECT y, s, date_trunc('month', current_date) FROM c LIMIT 7"),
    )
    es = F.concat(F.lit("select "), literal, F.lit(" AS s, substring('limit 1' from 2)"))
    sql = F.when(F.col("lang") == "en", en).when(F.col("lang") == "fr", fr).when(F.col("lang") == "de", de).otherwise(es)
    return t.documents.select("doc_id", "lang", sql.alias("sql"))


@query("n8_top_level_order_by", "SELECT doc_id, lang = 'en' AS ordered FROM documents")
def top_level_order_by(t: Tables) -> DataFrame:
    """Only the outer query's ORDER BY counts."""
    return sql_texts(t).select("doc_id", sqltext.has_order_by(F.col("sql")).alias("ordered"))


@query("n9_unordered_limit", "SELECT doc_id, lang = 'de' AS unordered_limit FROM documents")
def unordered_limit(t: Tables) -> DataFrame:
    """An outer LIMIT without an outer ORDER BY."""
    return sql_texts(t).select("doc_id", sqltext.unordered_limit(F.col("sql")).alias("unordered_limit"))


@query(
    "n10_query_shape",
    """
SELECT doc_id, tables, n_joins::INTEGER AS n_joins, aggregates, grouped, dates, n_columns::INTEGER AS n_columns
FROM documents JOIN (VALUES
  ('en', 'alpha,beta', 1, 'count,max', TRUE, '', 3),
  ('fr', 'delta,gamma', 1, '', FALSE, '', 1),
  ('de', 'epsilon', 0, '', FALSE, 'current_date,date_trunc,extract', 3),
  ('es', '', 0, '', FALSE, '', 2)) v(lang, tables, n_joins, aggregates, grouped, dates, n_columns) USING (lang)""",
)
def query_shape(t: Tables) -> DataFrame:
    """Tables, joins, aggregates, grouping, date functions and width of each query."""
    shaped = sql_texts(t).select("doc_id", sqltext.query_shape(F.col("sql")).alias("q"))
    return shaped.select(
        "doc_id",
        F.array_join("q.tables", ",").alias("tables"),
        F.col("q.joins").alias("n_joins"),
        F.array_join("q.aggregates", ",").alias("aggregates"),
        F.col("q.grouped").alias("grouped"),
        F.array_join(F.array_sort("q.dates"), ",").alias("dates"),
        F.col("q.columns").alias("n_columns"),
    )


@query(
    "n11_hardness",
    """
WITH counts AS (
  SELECT l_linenumber - 1 AS conds, l_linestatus = 'O' AS likes, l_returnflag, l_tax > 0.04 AS limited,
         l_quantity > 40 AS nested, l_discount > 0.05 AS two_columns, l_discount > 0.08 AS grouped
  FROM lineitem),
parts AS (
  SELECT (conds > 0)::INT + limited::INT + grouped::INT + CASE WHEN likes THEN conds ELSE 0 END AS c1,
         CASE WHEN nested THEN conds ELSE 0 END + (l_returnflag = 'R')::INT AS c2,
         ((CASE WHEN two_columns THEN 2 ELSE 0 END + CASE WHEN grouped THEN 2 ELSE 0 END
            + CASE WHEN l_returnflag = 'A' THEN conds ELSE 0 END) > 1)::INT
           + two_columns::INT + (conds > 1)::INT + grouped::INT AS others
  FROM counts)
SELECT CASE WHEN c1 <= 1 AND others = 0 AND c2 = 0 THEN 'easy'
    WHEN (others <= 2 AND c1 <= 1 AND c2 = 0) OR (c1 <= 2 AND others < 2 AND c2 = 0) THEN 'medium'
    WHEN (others > 2 AND c1 <= 2 AND c2 = 0) OR (c1 > 2 AND c1 <= 3 AND others <= 2 AND c2 = 0)
      OR (c1 <= 1 AND others = 0 AND c2 <= 1) THEN 'hard' ELSE 'extra' END AS difficulty,
  count(*) AS n FROM parts GROUP BY 1""",
)
def hardness(t: Tables) -> DataFrame:
    """Line items as parsed queries: conditions, nesting, limits and columns vary."""
    conds = (F.col("l_linenumber") - 1).cast("int")
    condition = F.struct(
        (F.col("l_returnflag") == "A").alias("negated"),
        F.when(F.col("l_linestatus") == "O", sqltext.LIKE).otherwise(2).alias("op"),
        F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("nested"),
    )
    none, no = F.array().cast("array<struct<negated:boolean,op:int,nested:int>>"), F.array().cast("array<string>")
    parsed = t.lineitem.select(
        F.when(F.col("l_discount") > 0.05, F.array(F.lit(1), F.lit(3)))
        .otherwise(F.array(F.lit(0)))
        .alias("select_aggs"),
        F.lit(1).alias("table_units"),
        none.alias("from_conds"),
        no.alias("from_ops"),
        F.array_repeat(condition, conds).alias("where_conds"),
        F.array_repeat(F.lit("and"), F.greatest(conds - 1, F.lit(0))).alias("where_ops"),
        F.when(F.col("l_discount") > 0.08, F.array(F.lit(1), F.lit(1)))
        .otherwise(F.array().cast("array<int>"))
        .alias("group_aggs"),
        none.alias("having_conds"),
        no.alias("having_ops"),
        F.array().cast("array<int>").alias("order_aggs"),
        (F.col("l_tax") > 0.04).alias("has_limit"),
        F.lit(False).alias("has_intersect"),
        (F.col("l_returnflag") == "R").alias("has_union"),
        F.lit(False).alias("has_except"),
    )
    level = sqltext.hardness(*sqltext.hardness_counts())
    return parsed.groupBy(level.alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


# --- prompts, batches, replies ----------------------------------------------------------------

_SCHEMA = "CREATE TABLE documents (doc_id BIGINT, text VARCHAR);"


@query(
    "n12_chat_rows",
    f"""
WITH {roles.CHAT_PAIRS}
SELECT conv_id, turn,
  '[{{"role":"system","content":"{P.SYSTEM_PROMPT}"}},{{"role":"user","content":' ||
    to_json('{_SCHEMA}' || chr(10) || chr(10) || 'Question: ' || trim(question, ' ' || chr(9) || chr(10) || chr(13)))::VARCHAR
    || '}}]' AS prompt,
  '[{{"role":"assistant","content":' || to_json(sql)::VARCHAR || '}}]' AS completion
FROM chat_pairs""",
)
def chat_rows(t: Tables) -> DataFrame:
    """Conversation pairs as prompt and completion messages."""
    pairs = roles.chat_pairs(t).withColumn("schema_text", F.lit(_SCHEMA))
    return P.training_example(pairs).select(
        "conv_id",
        "turn",
        F.to_json("prompt").alias("prompt"),
        F.to_json("completion").alias("completion"),
    )


@query(
    "n13_length_budget",
    r"""
SELECT doc_id AS id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) <= 400 AS kept FROM documents""",
)
def length_budget(t: Tables) -> DataFrame:
    """Documents within 400 words, and the ids of those over it."""
    pairs = roles.doc_pairs(t)
    length = F.regexp_count("question", F.lit(r"[\p{L}\p{N}_]+"))
    kept, dropped = P.fit_length(pairs, length, 400)
    return kept.select("id", F.lit(True).alias("kept")).unionByName(
        dropped.withColumn("kept", F.lit(False))
    )


@query(
    "n14_batch_packing",
    """
WITH placed AS (
  SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p FROM documents)
SELECT lang, p // 20 AS batch, count(*) AS n,
       md5(string_agg((p % 20 + 1) || '. ' || text, chr(10) ORDER BY p)) AS prompt_md5
FROM placed GROUP BY lang, p // 20""",
)
def batch_packing(t: Tables) -> DataFrame:
    """Documents of a language in numbered lists of twenty."""
    questions = t.documents.select("lang", "doc_id", F.col("text").alias("question"))
    return P.pack_batches(questions, ["lang"], "doc_id").select(
        "lang", "batch", "n", F.md5("prompt").alias("prompt_md5")
    )


@query(
    "n15_recent_context",
    """
WITH placed AS (
  SELECT lang, CAST(substr(source, 4) AS INTEGER) AS round, text,
         row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id) AS p
  FROM documents),
starts AS (SELECT lang, round, min(p) AS s FROM placed GROUP BY ALL)
SELECT s.lang, s.round, count(p.p)::INTEGER AS n_previous,
       md5(coalesce(string_agg(p.text, chr(10) ORDER BY p.p), '')) AS previous_md5
FROM starts s LEFT JOIN placed p ON p.lang = s.lang AND p.p < s.s AND p.p >= s.s - 30
GROUP BY s.lang, s.round""",
)
def recent_context(t: Tables) -> DataFrame:
    """For each language and round: the last 30 documents of earlier rounds."""
    questions = t.documents.select(
        "lang",
        F.substring("source", 4, 9).cast("int").alias("round"),
        "doc_id",
        F.col("text").alias("question"),
    )
    return P.recent_context(questions, ["lang"], "round", "doc_id").select(
        "lang",
        "round",
        F.size("previous").alias("n_previous"),
        F.md5(F.array_join("previous", "\n")).alias("previous_md5"),
    )


def _reply(sql: Column) -> Column:
    entries = F.array(
        F.struct(F.lit(1).alias("n"), sql.alias("sql")),
        F.struct(F.lit(9).alias("n"), F.lit("out of range").alias("sql")),
        F.struct(F.lit(3).alias("n"), F.lit(None).cast("string").alias("sql")),
    )
    body = F.to_json(F.struct(entries.alias("answers")), {"ignoreNullFields": "false"})
    wrapped = F.concat(F.lit("Sure, here you are:\n"), body, F.lit("\nAnything else?"))
    return F.when(F.length(sql) > 200, wrapped).otherwise(body)


@query(
    "n16_reply_alignment",
    f"""
WITH {roles.CHAT_PAIRS}
SELECT conv_id || '/' || turn AS batch_id, n::INTEGER AS n, CASE WHEN n = 1 THEN sql ELSE '' END AS sql
FROM chat_pairs, (VALUES (1), (2), (3)) v(n)""",
)
def reply_alignment(t: Tables) -> DataFrame:
    """JSON replies, some wrapped in chatter, aligned to three asked questions."""
    batches = roles.chat_pairs(t).select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("batch_id"),
        F.lit(3).alias("n"),
        _reply(F.col("sql")).alias("reply"),
    )
    return P.align_answers(batches)


@query(
    "n17_pending_requests",
    f"""
WITH {roles.CHAT_PAIRS},
asked AS (
  SELECT conv_id, turn, sha256('{{"model":"m1","question":' || to_json(text)::VARCHAR || ',"temperature":0}}') AS digest
  FROM conversations WHERE role = 'user'),
done AS (SELECT sha256('{{"model":"m1","question":' || to_json(question)::VARCHAR || ',"temperature":0}}') AS digest FROM chat_pairs)
SELECT conv_id, turn, digest FROM asked WHERE digest NOT IN (SELECT digest FROM done)""",
)
def pending_requests(t: Tables) -> DataFrame:
    """User turns whose request has no answer yet, by digest."""

    def digest(question: str) -> Column:
        return P.request_digest(
            {"question": F.col(question), "temperature": F.lit(0), "model": F.lit("m1")}
        )

    asked = t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", digest("text").alias("digest")
    )
    done = roles.chat_pairs(t).select(digest("question").alias("digest")).distinct()
    return P.pending(asked, done).select("conv_id", "turn", "digest")

"""Registered queries: duplicates, leaks, splits, samples and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions import text
from pairlake.operators import curate as K
from pairlake.operators import results as R
from pairlake.operators import similarity as S
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query


@query(
    "l1_exact_dedupe",
    f"""
WITH {roles.DOC_PAIRS}, keyed AS (
  SELECT id, db_id, {roles.norm_question('question')} AS q, {roles.norm_sql('sql')} AS s FROM doc_pairs)
SELECT min(id) AS id, db_id FROM keyed GROUP BY db_id, q, s""",
)
def exact_dedupe(t: Tables) -> DataFrame:
    """The first document per language, normalised text and query."""
    return K.exact_dedupe(roles.doc_pairs(t)).select("id", "db_id")


@query(
    "l1_chat_dedupe",
    f"""
WITH {roles.CHAT_PAIRS}, keyed AS (
  SELECT conv_id * 1000 + turn AS id, {roles.norm_question('question')} AS q, {roles.norm_sql('sql')} AS s FROM chat_pairs)
SELECT min(id) AS id FROM keyed GROUP BY q, s""",
)
def chat_dedupe(t: Tables) -> DataFrame:
    """Conversation pairs in one database: a single block holds everything."""
    pairs = roles.chat_pairs(t).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("chat").alias("db_id"), "question", "sql"
    )
    return K.exact_dedupe(pairs).select("id")


@query(
    "l2_jaccard",
    f"""
WITH {roles.CHAT_PAIRS}, sets AS (
  SELECT conv_id, turn, {roles.tokens('question')} AS a, {roles.tokens('sql')} AS b FROM chat_pairs)
SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE
  len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS jaccard FROM sets""",
)
def jaccard(t: Tables) -> DataFrame:
    """Token overlap between each question and its answer."""
    pairs = roles.chat_pairs(t)
    score = text.jaccard(text.token_set(F.col("question")), text.token_set(F.col("sql")))
    return pairs.select("conv_id", "turn", score.alias("jaccard"))


LEAKS = f"""sets AS MATERIALIZED (
  SELECT id, db_id, {roles.norm_question('question')} AS q, {roles.norm_sql('sql')} AS s,
         {roles.tokens('question')} AS ts FROM doc_pairs),
tr AS MATERIALIZED (SELECT *, len(ts) AS n FROM sets WHERE id NOT IN (SELECT doc_id FROM labels)),
te AS MATERIALIZED (SELECT *, len(ts) AS n FROM sets WHERE id IN (SELECT doc_id FROM labels)),
near AS MATERIALIZED (
  SELECT tr.id, min(te.id) AS test FROM tr JOIN te ON tr.db_id = te.db_id
    AND 10 * tr.n >= 9 * te.n AND 10 * te.n >= 9 * tr.n
  WHERE 10 * len(list_intersect(tr.ts, te.ts)) >= 9 * (tr.n + te.n - len(list_intersect(tr.ts, te.ts)))
  GROUP BY tr.id),
by_q AS (SELECT db_id, q, min(id) AS test FROM te GROUP BY db_id, q),
by_s AS (SELECT db_id, s, min(id) AS test FROM te GROUP BY db_id, s),
leaks AS (
  SELECT tr.id, by_q.test IS NOT NULL AS same_question, by_s.test IS NOT NULL AS same_sql,
         near.test IS NOT NULL AS near_question, by_q.test AS question_test, by_s.test AS sql_test,
         near.test AS near_test
  FROM tr LEFT JOIN by_q USING (db_id, q) LEFT JOIN by_s USING (db_id, s) LEFT JOIN near USING (id))"""


@query(
    "l3_leak_join",
    f"WITH {roles.DOC_PAIRS}, {LEAKS} SELECT * FROM leaks WHERE same_question OR same_sql OR near_question",
)
def leak_join(t: Tables) -> DataFrame:
    """Unlabelled documents that repeat a labelled one."""
    return S.find_leaks(roles.train_pairs(t), roles.test_items(t))


@query(
    "l4_shared_databases",
    """
SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT
SELECT source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def shared_databases(t: Tables) -> DataFrame:
    """Sources that occur among labelled and among unlabelled documents, over all rows."""
    labelled = t.labels.select("doc_id").distinct()
    train = t.documents.join(labelled, "doc_id", "left_anti").select("source")
    val = t.documents.join(labelled, "doc_id", "left_semi").select("source")
    return K.shared_databases(train, val, "source")


GREEDY = f"""keyed AS MATERIALIZED (
  SELECT seq, db_id, {roles.norm_question('question')} AS q, {roles.norm_sql('sql')} AS s,
         {roles.tokens('question')} AS ts FROM doc_pairs),
sized AS MATERIALIZED (SELECT *, len(ts) AS n FROM keyed),
edges AS MATERIALIZED (
  SELECT b.seq AS later, a.seq AS earlier,
         CASE WHEN a.q = b.q THEN 1 WHEN a.s = b.s THEN 2 ELSE 3 END AS rule
  FROM sized a JOIN sized b ON a.db_id = b.db_id AND a.seq < b.seq
  WHERE a.q = b.q OR a.s = b.s OR (10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    AND 10 * len(list_intersect(a.ts, b.ts)) >= 9 * (a.n + b.n - len(list_intersect(a.ts, b.ts))))),
contested AS MATERIALIZED (
  SELECT later, list(earlier) AS earlier, row_number() OVER (ORDER BY later) AS i FROM edges GROUP BY later),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS gone
  UNION ALL
  SELECT w.i + 1, CASE WHEN len(list_filter(c.earlier, lambda e: NOT list_contains(w.gone, e))) > 0
                  THEN list_append(w.gone, c.later) ELSE w.gone END
  FROM walk w JOIN contested c ON c.i = w.i + 1),
dropped AS MATERIALIZED (SELECT unnest(gone) AS seq FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)),
reasons AS (
  SELECT later AS seq, min(rule) AS rule FROM edges
  WHERE later IN (SELECT seq FROM dropped) AND earlier NOT IN (SELECT seq FROM dropped) GROUP BY later)"""


@query(
    "l5_greedy_dedupe",
    f"""
WITH RECURSIVE {roles.DOC_PAIRS}, {GREEDY}
SELECT d.id, CASE rule WHEN 1 THEN 'duplicate_question' WHEN 2 THEN 'duplicate_sql'
  WHEN 3 THEN 'near_duplicate_question' END AS reason
FROM doc_pairs d LEFT JOIN reasons r ON r.seq = d.seq""",
)
def greedy_dedupe(t: Tables) -> DataFrame:
    """All documents in order, dropped when too close to an earlier kept one."""
    return S.greedy_dedupe(roles.doc_pairs(t)).select("id", "reason")


def _hashed_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        F.col("l_returnflag").alias("db_id"),
        F.substring(F.sha2(F.concat_ws("|", F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")), 256), 1, 16).alias("result_hash"),
    )
    tests = t.part.select(
        F.when(F.col("p_size") > 25, "A").otherwise("R").alias("db_id"),
        F.when(
            F.col("p_type") != "SMALL",
            F.substring(F.sha2(F.concat_ws("|", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")), 256), 1, 16),
        ).alias("gold_result_hash"),
    )
    return rows, tests


@query(
    "l6_same_result_leak",
    """
WITH tests AS (
  SELECT CASE WHEN p_size > 25 THEN 'A' ELSE 'R' END AS db_id,
         substr(sha256(p_size || '|' || p_partkey), 1, 16) AS h FROM part WHERE p_type <> 'SMALL')
SELECT l_orderkey AS id, l_linenumber FROM lineitem
WHERE (l_returnflag, substr(sha256(CAST(l_quantity AS INTEGER) || '|' || l_suppkey), 1, 16)) IN (SELECT (db_id, h) FROM tests)""",
)
def same_result_leak(t: Tables) -> DataFrame:
    """Line items whose (quantity, supplier) result equals a part's gold result."""
    return K.same_result_as_test(*_hashed_rows(t)).select("id", "l_linenumber")


@query(
    "l7_cap_per_group",
    """
SELECT id, db_id, over_target FROM (
  SELECT doc_id AS id, lang AS db_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r,
         greatest(count(*) OVER (PARTITION BY lang) - 200, 0) AS over_target FROM documents)
WHERE r <= 200""",
)
def cap_per_group(t: Tables) -> DataFrame:
    """The first 200 documents per language, and how many were left out."""
    kept, over = K.cap_per_group(roles.doc_pairs(t), 200)
    return kept.join(over, "db_id").select("id", "db_id", "over_target")


_HASH = "substr(sha256(source || '|' || n_chars), 1, 16)"


def _finalized(t: Tables) -> tuple[DataFrame, DataFrame]:
    h = F.substring(F.sha2(F.concat_ws("|", F.col("source"), F.col("n_chars").cast("string")), 256), 1, 16)
    size = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    records = (
        roles.train_pairs(t)
        .join(size, "id")
        .withColumn("result_hash", h)
        .withColumn("decision", F.when(F.col("source") == "src2", "no_agreement").otherwise("agreed"))
    )
    tests = roles.test_items(t).join(size, "id").withColumn("gold_result_hash", h)
    tests = tests.withColumn("gold_sql", F.concat(F.col("gold_sql"), F.lit(" -- gold")))
    return K.finalize(records, tests, 60)


FINALIZE = f"""
WITH RECURSIVE {roles.DOC_PAIRS.replace('doc_pairs AS (', 'doc_pairs_all AS (', 1)
    .replace('FROM doc_pairs WHERE', 'FROM doc_pairs_all WHERE')},
doc_pairs AS (SELECT * FROM train WHERE source <> 'src2'),
{GREEDY},
unique_rows AS MATERIALIZED (
  SELECT k.*, {_HASH.replace('source', 'd.source').replace('n_chars', 'd.n_chars')} AS h
  FROM sized k JOIN doc_pairs d USING (seq) WHERE k.seq NOT IN (SELECT seq FROM dropped)),
te AS MATERIALIZED (
  SELECT db_id, {roles.norm_question('question')} AS q, {roles.norm_sql("sql || ' -- gold'")} AS s,
         {roles.tokens('question')} AS ts, len({roles.tokens('question')}) AS n, {_HASH} AS h FROM tests),
leaking AS MATERIALIZED (
  SELECT DISTINCT u.seq FROM unique_rows u JOIN te ON u.db_id = te.db_id
  WHERE u.q = te.q OR u.s = te.s OR (10 * u.n >= 9 * te.n AND 10 * te.n >= 9 * u.n
    AND 10 * len(list_intersect(u.ts, te.ts)) >= 9 * (u.n + te.n - len(list_intersect(u.ts, te.ts))))),
flagged AS (
  SELECT seq, db_id, CASE WHEN seq IN (SELECT seq FROM leaking) THEN 'test_leakage_text'
    WHEN (db_id, h) IN (SELECT (db_id, h) FROM te) THEN 'test_leakage_same_result' END AS reason FROM unique_rows),
clean AS (
  SELECT seq, db_id, row_number() OVER (PARTITION BY db_id ORDER BY seq) AS r FROM flagged WHERE reason IS NULL)"""


@query("l8_finalize_kept", FINALIZE + " SELECT seq AS id, db_id FROM clean WHERE r <= 60")
def finalize_kept(t: Tables) -> DataFrame:
    """Deduplicated, leak-free, capped documents."""
    return _finalized(t)[0].select("id", "db_id")


@query(
    "l8_finalize_drops",
    FINALIZE
    + """
SELECT db_id, reason, count(*) AS n FROM (
  SELECT db_id, CASE rule WHEN 1 THEN 'duplicate_question' WHEN 2 THEN 'duplicate_sql' ELSE 'near_duplicate_question' END AS reason
  FROM reasons JOIN doc_pairs USING (seq)
  UNION ALL SELECT db_id, reason FROM flagged WHERE reason IS NOT NULL
  UNION ALL SELECT db_id, 'over_target' FROM clean WHERE r > 60) GROUP BY ALL""",
)
def finalize_drops(t: Tables) -> DataFrame:
    """How many rows each step of the funnel dropped."""
    return _finalized(t)[1]


@query(
    "l9_hold_out",
    """
WITH per_db AS (
  SELECT s_nationkey AS db_id, sha256('split-v1:' || s_nationkey) AS o, count(*) FILTER (l_returnflag = 'A') AS n_rows
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
running AS (SELECT *, sum(n_rows) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS r FROM per_db WHERE n_rows > 0)
SELECT db_id, n_rows FROM running WHERE r - n_rows < 0.10 * (SELECT count(*) FROM lineitem)""",
)
def hold_out(t: Tables) -> DataFrame:
    """Whole supplier nations held out until returned lines reach a tenth of all lines."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("db_id"), F.col("l_returnflag").alias("source")
    )
    return K.hold_out(rows, "split-v1", 0.10, "A")


@query(
    "l10_seeded_subset",
    "SELECT o_orderkey AS id FROM orders ORDER BY sha256('subset-v1:' || o_orderkey), o_orderkey LIMIT 200",
)
def seeded_subset(t: Tables) -> DataFrame:
    """200 orders in seeded order."""
    return K.seeded_subset(t.orders.select(F.col("o_orderkey").alias("id")), 200, "subset-v1")


@query(
    "l11_systematic_sample",
    """
SELECT id, "set" FROM (
  SELECT o_orderkey AS id, o_orderpriority AS "set", row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders)
WHERE (r - 1) % 10 = 0""",
)
def systematic_sample(t: Tables) -> DataFrame:
    """Every tenth order of each priority."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("set"))
    return K.systematic_sample(rows)


@query(
    "l12_review_sample",
    """
SELECT id, db_id FROM (
  SELECT doc_id AS id, lang AS db_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('review-v1:' || lang || ':' || doc_id), doc_id) AS r
  FROM documents WHERE lang IN ('en', 'fr', 'de'))
WHERE r <= CASE WHEN db_id = 'de' THEN 16 ELSE 17 END""",
)
def review_sample(t: Tables) -> DataFrame:
    """50 documents for review: 17, 17 and 16 of three languages."""
    rows = roles.doc_pairs(t).select("id", "db_id")
    return K.review_sample(rows, ("en", "fr", "de"), "review-v1")


@query(
    "l13_stable_sample",
    """
SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND n_chars >= 500
ORDER BY sha256('stable-v1:' || doc_id), doc_id LIMIT 50""",
)
def stable_sample(t: Tables) -> DataFrame:
    """50 labelled documents in seeded order that pass the item checks."""
    docs = t.documents.join(t.labels, "doc_id")
    items = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("db_id"), F.lit("easy").alias("difficulty"), F.lit("h").alias("gold_result_hash"))
    checks = docs.select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("n_chars") < 500, 0).otherwise(1).alias("n_rows"),
        F.lit(False).alias("all_null"),
        (F.col("toxic") == 0).alias("deterministic"),
        F.lit(False).alias("ties"),
        F.lit("h").alias("result_hash"),
    )
    audit = R.audit_items(items, checks, t.documents.select(F.col("lang").alias("db_id")))
    return K.stable_sample(items.select("id"), audit, 50, "stable-v1")


@query(
    "l14_sequence_ids",
    """
SELECT o_orderkey AS seq, 'synth_' || c_mktsegment || '_' ||
  CASE WHEN p < 10000 THEN lpad(p::VARCHAR, 4, '0') ELSE p::VARCHAR END AS new_id
FROM (SELECT o_orderkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS p
      FROM orders JOIN customer ON o_custkey = c_custkey)""",
)
def sequence_ids(t: Tables) -> DataFrame:
    """Numbered ids for the orders of each segment."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"), F.col("c_mktsegment").alias("db_id")
    )
    return K.sequence_ids(rows).select("seq", "new_id")


def _funnel(t: Tables) -> DataFrame:
    """Documents with the reason why the execution filter dropped them."""
    reason = (
        F.when(F.col("n_chars") < 300, "sqlite_error")
        .when(F.col("n_chars") > 6000, "duckdb_error")
        .when((F.col("quality") == 0), "result_mismatch")
    )
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", reason.alias("reason"),
        roles.difficulty(F.col("n_chars")).alias("difficulty"),
    )


FUNNEL = f"""funnel AS (
  SELECT doc_id, lang, source, n_chars, CASE WHEN n_chars < 300 THEN 'sqlite_error' WHEN n_chars > 6000 THEN 'duckdb_error'
    WHEN quality = 0 THEN 'result_mismatch' END AS reason, {roles.DIFFICULTY} AS difficulty
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "l15_retention",
    f"""WITH {FUNNEL}
SELECT lang, source, count(*) AS pairs, count(*) - count(reason) AS kept,
       CAST(printf('%.4f', (count(*) - count(reason))::DOUBLE / count(*)) AS DOUBLE) AS retention FROM funnel GROUP BY ALL""",
)
def retention(t: Tables) -> DataFrame:
    """Pairs, kept and retention per language and source."""
    return K.retention(_funnel(t), ["lang", "source"])


@query(
    "l15_drops_by_reason",
    f"WITH {FUNNEL} SELECT lang, reason, count(*) AS n FROM funnel WHERE reason IS NOT NULL GROUP BY ALL",
)
def drops_by_reason(t: Tables) -> DataFrame:
    """Drop reasons per language."""
    return K.drops_by_reason(_funnel(t), ["lang"])


@query(
    "l15_corpus_totals",
    f"""
WITH {roles.DOC_PAIRS}, keyed AS MATERIALIZED (
  SELECT id, db_id, source, n_chars, {roles.norm_question('question')} AS q, {roles.norm_sql('sql')} AS s FROM doc_pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY db_id, q, s ORDER BY id) AS r FROM keyed)
SELECT source, count(DISTINCT db_id) AS databases, count_if(r = 1)::BIGINT AS outputs,
       count_if(r > 1)::BIGINT AS duplicates_removed, count_if(r = 1 AND n_chars < 200)::BIGINT AS empty_results
FROM ranked GROUP BY 1""",
)
def corpus_totals(t: Tables) -> DataFrame:
    """Outputs, duplicates and short documents per source."""
    pairs = roles.doc_pairs(t)
    kept = K.exact_dedupe(pairs).select("id", F.lit(False).alias("duplicate"))
    sizes = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") < 200).alias("empty"))
    rows = pairs.select("id", "db_id", "source").join(kept, "id", "left").join(sizes, "id")
    rows = rows.withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))
    return K.corpus_totals(rows, ["source"])


@query(
    "l15_difficulty_histogram",
    f"""WITH {FUNNEL}
SELECT lang, count_if(difficulty = 'easy')::BIGINT AS easy, count_if(difficulty = 'medium')::BIGINT AS medium,
       count_if(difficulty = 'hard')::BIGINT AS hard, count_if(difficulty = 'extra')::BIGINT AS extra
FROM funnel WHERE reason IS NULL GROUP BY 1""",
)
def difficulty_histogram(t: Tables) -> DataFrame:
    """Difficulties of the kept documents per language."""
    return K.difficulty_histogram(_funnel(t).filter("reason is null"), ["lang"])


@query(
    "l15_length_percentiles",
    """
SELECT lang, CAST(floor((xs[(n - 1) // 2 + 1] + xs[n // 2 + 1]) / 2) AS BIGINT) AS p50,
       xs[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, xs[n] AS max
FROM (SELECT lang, list(n_chars ORDER BY n_chars) AS xs, count(*) AS n FROM documents GROUP BY lang)""",
)
def length_percentiles(t: Tables) -> DataFrame:
    """Median, 95th percentile and maximum of document lengths."""
    return K.length_percentiles(t.documents, "lang", "n_chars")


@query(
    "l16_source_mix",
    """
SELECT source, count_if(n_chars <= 3000)::BIGINT AS train_pairs, count_if(n_chars > 3000)::BIGINT AS dropped_over_max_len
FROM documents GROUP BY 1""",
)
def source_mix(t: Tables) -> DataFrame:
    """Training rows by source and rows over the length limit."""
    return K.source_mix(t.documents, "n_chars", 3000)


@query(
    "l17_review_acceptance",
    """
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS db_id, count(*) AS n,
       count_if(quality = 1 AND toxic = 0)::BIGINT AS accepted,
       CAST(printf('%.4f', count_if(quality = 1 AND toxic = 0)::DOUBLE / count(*)) AS DOUBLE) AS accept_rate
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""",
)
def review_acceptance(t: Tables) -> DataFrame:
    """Accepted share of the labelled documents, per language and overall."""
    verdicts = t.documents.join(t.labels, "doc_id").select(
        F.col("lang").alias("db_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accept")
    )
    return K.review_acceptance(verdicts)

"""Queries whose operators compare documents with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.chosen_paths import near_duplicates
from pairlake.llm.registry import query, table
from pairlake.llm.repeated_bytes import remove_repeats

OP7_SQL = r"""
WITH RECURSIVE words_ AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) END)) AS s
  FROM words_),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
freq AS (SELECT t, count(*) AS f FROM items GROUP BY t),
ranked AS (SELECT doc_id, n, i.t, row_number() OVER (PARTITION BY doc_id ORDER BY f, i.t) AS r
  FROM items i JOIN freq USING (t) WHERE f >= 1),
rare AS (SELECT * FROM ranked WHERE r <= n - CAST(ceil(0.85 * n - 1e-9) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
counted AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS total
  FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b),
links AS (SELECT a, b FROM counted WHERE 100 * i >= 85 * (total - i)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sets
  UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON both_.a = reach.node WHERE reach.root < both_.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.root AS component_id, r.root = s.doc_id AS kept
FROM sets s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = s.doc_id
"""


@query("op7_near_duplicates", OP7_SQL)
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier documents."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

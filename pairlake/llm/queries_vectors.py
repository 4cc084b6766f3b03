"""Searches over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.ball_tree import top_k, whole_numbers
from pairlake.llm.hnsw import directions, nearest
from pairlake.llm.registry import query, table
from pairlake.session import cut

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@query("op4_exact_top_k", OP4_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector against all others."""
    vectors = cut(whole_numbers(table(spark, sf_dir, "embeddings"), 64.0))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query("op5_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every fiftieth vector, by graphs over all vectors."""
    vectors = cut(directions(table(spark, sf_dir, "embeddings")))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)

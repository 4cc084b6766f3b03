"""Queries whose operators treat every document or conversation by itself or by its source."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.mixing import mix
from pairlake.llm.registry import query, table
from pairlake.llm.secrets import scan_secrets
from pairlake.llm.segmentations import decode, encode_samples
from pairlake.llm.token_counts import count_tokens
from pairlake.llm.toxicity import score_toxicity

BASE_KINDS = ("assign", "access", "hex")

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)


def _kind_sql(kind: str, place: int, pattern: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place,
        regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM texts"""


OP2_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS ({_kind_sql("assign", 1, _ASSIGN)}
  UNION ALL {_kind_sql("access", 2, "AKIA[A-Z0-9]+")}
  UNION ALL {_kind_sql("hex", 3, "[0-9a-f]+")}),
places AS (SELECT doc_id, kind, place, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM kinds),
spans AS (SELECT doc_id, kind, place, ms[i] AS m,
    list_sum(list_transform(ps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM places
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(ms[i], '{_ASSIGN}', 2)) >= 6
    WHEN 'access' THEN length(ms[i]) >= 20 ELSE length(ms[i]) >= 24 END),
lines AS (SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ','
      ORDER BY s, place) AS line
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256, coalesce(line, '') AS spans
FROM documents d LEFT JOIN lines USING (doc_id)
"""


@query("op2_secret_scan", OP2_SQL)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def line(spans):
        each = F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(each, ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank FROM weighed),
goals AS (SELECT source, source_size, least(cap, coalesce(
      (SELECT arg_min(level, rank) FROM levels WHERE level <= cap / w) * w, cap)) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
running AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM sized)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, p.source_size, p.target,
  CAST(r.size * (p.whole + CASE WHEN so_far + r.size / 2.0::DOUBLE < p.target - p.whole * p.source_size
    THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
"""


@query("op8_mixing", OP8_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2 to 150% of all words, each at most twice."""
    mixed = mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by word_bpe_49k.json, encoded once per distinct text."""
    return count_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        limit=2048,
        drops_space=True,
    )


@query("op9_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_sampled_pieces")
def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and what they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    sampled = encode_samples(table(spark, sf_dir, "documents"), model, k=2)
    decoded = decode(sampled.withColumn("ids_hash", F.xxhash64("ids")), model)
    return decoded.select(
        "doc_id",
        "rank",
        "n_pieces",
        "log_prob",
        "log_inclusion",
        "ids_hash",
        F.sha2("text", 256).alias("text_sha256"),
    )

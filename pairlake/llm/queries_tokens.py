"""Queries that encode, cut and fingerprint every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.byte_pairs import decode, encode
from pairlake.llm.fill_in_middle import fill_in_middle, restore
from pairlake.llm.manifest import folded, leaf, manifest, proof
from pairlake.llm.registry import query, table


@query("op11_word_pieces")
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by word_bpe_49k.json, and what they decode to."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(table(spark, sf_dir, "documents"), tokenizer, drops_space=True)
    return decode(encoded, tokenizer).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


OP12_SQL = r"""
WITH tokens AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::UBIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(w) + 1) AS b,
    ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS d FROM tokens),
parts AS (SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(w[1:least(a, b)], ''), '') AS p,
    coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(w[greatest(a, b) + 1:n], ''), '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", OP12_SQL)
def fill_in_middle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three at two tokens, and put together again."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed="1", rate=90, suffix_first=20)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _framed_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    columns = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(map(_framed_sql, columns))})"


_HALVE = "list_transform(range(0, (len({0}) + 1) // 2), lambda i: sha256({0}[2 * i + 1] || coalesce({0}[2 * i + 2], '')))"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
        lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"""
# A row's place at each level leads to the digests beside it; a level with one node has none.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS other,
    CAST(doc_id AS VARCHAR) AS d FROM documents),
marked AS (SELECT doc_id, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS r,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN other ELSE leaf END AS shown FROM leaves),
levels AS (SELECT lang, 0 AS level, list(leaf ORDER BY r) AS nodes FROM marked GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_HALVE.format("nodes")} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r
  FROM levels WHERE len(nodes) = 1),
crown AS (SELECT 0 AS level, list(subroot ORDER BY r) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_HALVE.format("nodes")} FROM crown WHERE len(nodes) > 1),
steps AS (SELECT m.doc_id, m.leaf, l.level, l.nodes, m.r >> l.level AS place FROM marked m
    JOIN levels l ON m.lang IS NOT DISTINCT FROM l.lang AND len(l.nodes) > 1
  UNION ALL SELECT m.doc_id, m.leaf, 1000 + c.level, c.nodes, s.r >> c.level FROM marked m
    JOIN subroots s ON m.lang IS NOT DISTINCT FROM s.lang JOIN crown c ON len(c.nodes) > 1),
beside AS (SELECT doc_id, leaf, level, CASE WHEN place % 2 = 1 THEN nodes[place] ELSE '' END AS a,
    CASE WHEN place % 2 = 0 THEN coalesce(nodes[place + 2], '') ELSE '' END AS b FROM steps),
paths AS (SELECT doc_id, leaf, list(a ORDER BY level) AS a, list(b ORDER BY level) AS b FROM beside GROUP BY doc_id, leaf),
folds AS (SELECT m.*, coalesce(p.a, []) AS a, coalesce(p.b, []) AS b FROM marked m LEFT JOIN paths p USING (doc_id, leaf)),
folding AS (SELECT doc_id, leaf, shown AS node, 1 AS i, a, b FROM folds
  UNION ALL SELECT doc_id, leaf, sha256(a[i] || node || b[i]), i + 1, a, b FROM folding WHERE i <= len(a))
SELECT f.doc_id, f.leaf, s.subroot, c.nodes[1] AS root,
  sha256(coalesce(array_to_string(list_transform(range(1, len(f.a) + 1), lambda i: f.a[i] || f.b[i]), ''), '')) AS proof_sha256,
  g.node AS folded_root, g.node = c.nodes[1] AS verified
FROM folds f JOIN folding g ON f.doc_id = g.doc_id AND f.leaf = g.leaf AND g.i = len(f.a) + 1
JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang JOIN crown c ON len(c.nodes) = 1
"""


@query("op13_manifest", OP13_SQL)
def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, proof and check of every document; where 7 divides the id's crc32, the
    row checked is one whose n_chars has grown by one."""
    docs = table(spark, sf_dir, "documents")

    def of(n_chars):
        return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.try_add(F.col("n_chars"), F.lit(1))
    rows = docs.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), F.when(changed, of(more)).alias("shown"))
    found = manifest(rows, "doc_id", "lang", carried=["shown"])
    checked = found.withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("path")))
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

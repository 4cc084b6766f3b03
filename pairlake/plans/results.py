"""Registered queries: result sets compared, hashed, audited and charted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.cells import relaxed_row_text, row_cells, row_text
from pairlake.operators import results as R
from pairlake.operators.runner import Query, run_batch
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query

MONEY = "decimal(12,2)"


def _cents(c: str):
    return F.col(c).cast(MONEY)


# --- canonical cells in SQL ---------------------------------------------------------------


def sql_number(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) < 1e15 THEN CAST(CAST(round_even({x}, 6) + 0.0 AS DECIMAL(38,6)) "
        f"AS VARCHAR) ELSE printf('%.16e', {x}) END"
    )


def sql_num_cell(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '0' ELSE '1:' || {sql_number(x)} END)"


def sql_text_cell(x: str) -> str:
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    value = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return (
        f"(CASE WHEN {x} IS NULL THEN '0' WHEN regexp_full_match(trim({x}), '{number}') THEN "
        f"'1:' || {sql_number(value)} ELSE '2:' || length({x}) || ':' || {x} END)"
    )


def sql_digest(text: str, number: int) -> str:
    return f"CAST('0x' || substr(sha256({text}), {8 * number + 1}, 8) AS BIGINT)"


def sql_hash(text: str) -> str:
    sums = " || ':' || ".join(f"sum({sql_digest(text, k)})" for k in range(R.SLICES))
    return f"substr(sha256(count(*) || ':' || {sums}), 1, 16)"


# --- the flagship: one question, two queries, one verdict -----------------------------------


@query(
    "r0_segment_revenue_agrees",
    f"""
WITH a AS (
  SELECT c_mktsegment AS segment,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'revenue_by_segment' AS query_id, count(*) AS n_rows, TRUE AS matched,
       {sql_hash("'3|' || " + sql_text_cell("segment") + " || '|' || " + sql_num_cell("revenue")
                 + " || '|' || " + sql_num_cell("n::DOUBLE"))} AS result_hash
FROM a""",
)
def segment_revenue_agrees(t: Tables) -> DataFrame:
    """Revenue by market segment: a join, and sums per customer joined afterwards."""
    direct = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.sum(_cents("o_totalprice")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))
    )
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.sum(_cents("o_totalprice")).alias("spent"), F.count(F.lit(1)).alias("orders")
    )
    staged = (
        t.customer.join(per_customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.sum("spent").cast("double").alias("revenue"), F.sum("orders").alias("n"))
    )
    lines = R.result_rows(direct, "revenue_by_segment", "a").unionByName(
        R.result_rows(staged, "revenue_by_segment", "b")
    )
    asked = R.query_list(t.spark, {"revenue_by_segment": False})
    verdict = R.results_match(lines, asked)
    hashes = R.result_hash(lines, asked).filter("side = 'a'")
    return verdict.join(hashes, "query_id").select("query_id", "n_rows", "matched", "result_hash")


# --- two results per nation, some of them slightly off ---------------------------------------


def monthly(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy(
        "n_name", "n_regionkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.sum(_cents("o_totalprice")).cast("double").alias("revenue"))


def noisy(rows: DataFrame) -> DataFrame:
    """The other side: tiny noise, relative noise, wrong cents, or missing rows by region."""
    region = F.col("n_regionkey")
    revenue = (
        F.when(region == 1, F.col("revenue") + 1e-7)
        .when((region == 2) & F.col("month").endswith("-03"), F.col("revenue") + 5.0)
        .when(region == 4, F.col("revenue") * (1 + 4e-7))
        .otherwise(F.col("revenue"))
    )
    return rows.withColumn("revenue", revenue).filter((region != 3) | (F.col("month") >= "1995-02"))


def result_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = monthly(t)
    sides = [
        R.result_rows(df, F.col("n_name"), side, columns=["month", "revenue"])
        for side, df in (("a", rows), ("b", noisy(rows)))
    ]
    asked = t.nation.select(F.col("n_name").alias("query_id"), F.lit(False).alias("ordered"))
    return sides[0].unionByName(sides[1]), asked


PAIRS = """a AS (
  SELECT n_name, n_regionkey, strftime(o_orderdate, '%Y-%m') AS month,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
b AS (
  SELECT n_name, n_regionkey, month,
         CASE WHEN n_regionkey = 1 THEN revenue + 1e-7
              WHEN n_regionkey = 2 AND month LIKE '%-03' THEN revenue + 5.0
              WHEN n_regionkey = 4 THEN revenue * (1 + 4e-7) ELSE revenue END AS revenue
  FROM a WHERE n_regionkey <> 3 OR month >= '1995-02')"""

MATCH = f"""{PAIRS},
ra AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY month, revenue) AS rn FROM a),
rb AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY month, revenue) AS rn FROM b),
compared AS (
  SELECT coalesce(ra.n_name, rb.n_name) AS query_id, ra.rn AS rna, rb.rn AS rnb,
         coalesce(ra.month = rb.month AND abs(ra.revenue - rb.revenue) <=
           greatest(1e-6 * greatest(abs(ra.revenue), abs(rb.revenue)), 1e-6), FALSE) AS same
  FROM ra FULL JOIN rb ON ra.n_name = rb.n_name AND ra.rn = rb.rn),
verdicts AS (
  SELECT query_id, count(rna) AS n_a, count(rnb) AS n_b, bool_and(same) AS matched
  FROM compared GROUP BY query_id),
matches AS (
  SELECT n_name AS query_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b,
         coalesce(matched, TRUE) AS matched
  FROM nation LEFT JOIN verdicts ON query_id = n_name)"""


@query(
    "r1_canonical_values",
    f"""
SELECT p_partkey, '4|' || {sql_num_cell("p_partkey::DOUBLE")} || '|' || {sql_text_cell("p_name")}
  || '|' || {sql_text_cell("(' ' || p_retailprice::VARCHAR)")} || '|' ||
  {sql_text_cell("nullif(p_type, 'SMALL')")} AS canonical
FROM part""",
)
def canonical_values(t: Tables) -> DataFrame:
    """Numbers, numeric text, other text and NULLs in canonical form."""
    df = t.part.select(
        "p_partkey",
        "p_name",
        F.concat(F.lit(" "), F.col("p_retailprice").cast("string")).alias("price"),
        F.nullif("p_type", F.lit("SMALL")).alias("kind"),
    )
    return df.select("p_partkey", row_text(row_cells(df)).alias("canonical"))


@query(
    "r1_canonical_lineitem",
    f"""
SELECT {sql_hash("'6|' || " + sql_num_cell("l_orderkey::DOUBLE") + " || '|' || "
    + sql_num_cell("l_extendedprice") + " || '|' || " + sql_num_cell("l_discount * l_tax / 3")
    + " || '|' || " + sql_text_cell("l_shipmode") + " || '|' || "
    + sql_num_cell("CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") + " || '|' || "
    + sql_text_cell("strftime(l_shipdate, '%Y-%m-%d')"))} AS result_hash, count(*) AS n_rows
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)""",
)
def canonical_lineitem(t: Tables) -> DataFrame:
    """Every line item as one big result, hashed without holding it in one place."""
    df = t.lineitem.select(
        "l_orderkey",
        "l_extendedprice",
        (F.col("l_discount") * F.col("l_tax") / 3).alias("x"),
        F.concat("l_returnflag", "l_linestatus").alias("flags"),
        (F.col("l_returnflag") == "A").alias("returned"),
        F.to_date("l_shipdate").alias("shipped"),
    )
    asked = R.query_list(t.spark, {"lineitem": False})
    return R.result_hash(R.result_rows(df, "lineitem"), asked).select("result_hash", "n_rows")


@query(
    "r2_multiset_order",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS query_id, l_quantity AS quantity, l_returnflag AS flag,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_returnflag) AS rn
FROM lineitem""",
)
def multiset_order(t: Tables) -> DataFrame:
    """Each order's lines as an unordered result, in canonical order."""
    rows = R.result_rows(
        t.lineitem, F.col("l_orderkey").cast("string"), columns=["l_quantity", "l_returnflag"]
    )
    return R.sorted_rows(rows).select(
        "query_id",
        F.col("cells")[0]["num"].alias("quantity"),
        F.col("cells")[1]["str"].alias("flag"),
        "rn",
    )


@query("r3_results_match", f"WITH {MATCH} SELECT * FROM matches")
def results_match(t: Tables) -> DataFrame:
    """Two monthly revenue results per nation: equal, close, off by cents, or shorter."""
    return R.results_match(*result_pairs(t))


@query(
    "r3_ordered_match",
    """
WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders),
b AS (SELECT o_custkey, o_orderkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice + 0.0 * o_orderkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey ELSE o_orderkey END, o_orderkey) AS rn
      FROM orders)
SELECT CAST(a.o_custkey AS VARCHAR) AS query_id, count(*) AS n_a, count(*) AS n_b,
       bool_and(a.o_orderkey = b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 1e-6) AS matched
FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.rn = b.rn
GROUP BY a.o_custkey""",
)
def ordered_match(t: Tables) -> DataFrame:
    """Each customer's orders by price, ties broken in two ways."""
    qid = F.col("o_custkey").cast("string")
    flipped = F.when(F.col("o_orderpriority") == "1-URGENT", -F.col("o_orderkey")).otherwise(
        F.col("o_orderkey")
    )
    lines = R.result_rows(
        t.orders, qid, "a", ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"]
    ).unionByName(
        R.result_rows(
            t.orders, qid, "b", ["o_totalprice", flipped, "o_orderkey"], ["o_orderkey", "o_totalprice"]
        )
    )
    asked = lines.select("query_id").distinct().withColumn("ordered", F.lit(True))
    return R.results_match(lines, asked)


@query(
    "r4_result_hash",
    f"""
WITH {PAIRS}
SELECT n_name AS query_id, side, count(*) AS n_rows,
       {sql_hash("'2|' || " + sql_text_cell("month") + " || '|' || " + sql_num_cell("revenue"))} AS result_hash
FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' AS side FROM b)
GROUP BY n_name, side""",
)
def result_hash(t: Tables) -> DataFrame:
    """Hashes of both sides of every nation's result."""
    return R.result_hash(*result_pairs(t))


@query(
    "r4_ordered_hash",
    f"""
WITH ranked AS (
  SELECT c_mktsegment, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ix
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment AS query_id, 'a' AS side, count(*) AS n_rows,
       {sql_hash("ix || '#2|' || " + sql_num_cell("o_orderkey::DOUBLE") + " || '|' || "
                 + sql_num_cell("o_totalprice"))} AS result_hash
FROM ranked GROUP BY 1""",
)
def ordered_hash(t: Tables) -> DataFrame:
    """All orders of a segment by price: five large ordered results."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = R.result_rows(
        joined,
        F.col("c_mktsegment"),
        "a",
        [F.desc("o_totalprice"), F.asc("o_orderkey")],
        ["o_orderkey", "o_totalprice"],
    )
    asked = t.customer.select(F.col("c_mktsegment").alias("query_id")).distinct()
    return R.result_hash(lines, asked.withColumn("ordered", F.lit(True)))


@query(
    "r5_relaxed_match",
    f"""
WITH {PAIRS},
keyed AS (
  SELECT n_name, month || printf('%.5e', revenue) AS k, 1 AS d FROM a
  UNION ALL SELECT n_name, month || printf('%.5e', revenue), -1 FROM b),
balance AS (SELECT n_name, k, sum(d) AS d FROM keyed GROUP BY ALL),
verdict AS (SELECT n_name AS query_id, bool_and(d = 0) AS matched FROM balance GROUP BY n_name)
SELECT n.n_name AS query_id, coalesce(matched, TRUE) AS matched
FROM nation n LEFT JOIN verdict ON query_id = n.n_name""",
)
def relaxed_match(t: Tables) -> DataFrame:
    """The same pairs at 6 significant digits."""
    rows = monthly(t)
    sides = []
    for side, df in (("a", rows), ("b", noisy(rows))):
        shown = df.select("n_name", "month", "revenue")
        sides.append(
            shown.select(
                F.col("n_name").alias("query_id"),
                F.lit(side).alias("side"),
                F.lit(2).alias("width"),
                relaxed_row_text(shown, ["month", "revenue"]).alias("row"),
            )
        )
    asked = t.nation.select(F.col("n_name").alias("query_id"))
    return R.relaxed_match(sides[0].unionByName(sides[1]), asked)


@query(
    "r6_empty_or_all_null",
    """
WITH rows AS (SELECT l_partkey, nullif(l_linestatus, 'O') AS status FROM lineitem WHERE l_returnflag = 'R')
SELECT CAST(p_partkey AS VARCHAR) AS query_id, count(l_partkey) AS n_rows,
       count(status) = 0 AS all_null
FROM part LEFT JOIN rows ON l_partkey = p_partkey GROUP BY 1""",
)
def empty_or_all_null(t: Tables) -> DataFrame:
    """Returned lines per part: some results have no rows, some only NULLs."""
    df = t.lineitem.filter("l_returnflag = 'R'").withColumn(
        "status", F.nullif("l_linestatus", F.lit("O"))
    )
    rows = R.result_rows(df, F.col("l_partkey").cast("string"), columns=["status"])
    asked = t.part.select(F.col("p_partkey").cast("string").alias("query_id"))
    return R.emptiness(rows, asked)


@query(
    "r7_determinism",
    """
WITH reversed_orders AS (SELECT * FROM orders ORDER BY o_orderkey DESC),
a AS (SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
b AS (SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM reversed_orders GROUP BY 1),
c AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders),
d AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM reversed_orders)
SELECT 'by_status' AS query_id, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AS deterministic
UNION ALL
SELECT 'price_rank', (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM d)) = 0""",
)
def determinism(t: Tables) -> DataFrame:
    """A grouped and a ranked query on the orders and on their reversed copy."""
    from pyspark.sql import Window

    ranked = F.rank().over(Window.partitionBy("o_custkey").orderBy("o_totalprice"))
    return R.determinism(
        {"orders": t.orders},
        {
            "by_status": lambda s: s["orders"]
            .groupBy("o_orderstatus")
            .agg(F.count(F.lit(1)), F.max("o_totalprice")),
            "price_rank": lambda s: s["orders"].select("o_custkey", "o_orderkey", ranked),
        },
    )


def _sql_ties(name: str, columns: str, key: str, limit: int) -> str:
    first, second = [c.strip() for c in columns.split(",")]
    up = f"SELECT {columns}, row_number() OVER (ORDER BY {key}, {first}, {second}) AS rn FROM orders"
    down = f"SELECT {columns}, row_number() OVER (ORDER BY {key}, {first} DESC, {second} DESC) AS rn FROM orders"
    return (
        f"SELECT '{name}' AS query_id, bool_or(u.{first} <> d.{first} OR u.{second} <> d.{second}) AS ties "
        f"FROM ({up}) u JOIN ({down}) d ON u.rn = d.rn AND u.rn <= {limit}"
    )


_TIE_CASES = (
    ("dearest_orders", ("o_orderkey", "o_totalprice"), ("o_totalprice", True), 100),
    ("first_days", ("o_orderkey", "o_custkey"), ("o_orderdate", False), 50),
    ("first_priorities", ("o_orderpriority", "o_orderstatus"), ("o_orderpriority", False), 10),
)


@query(
    "r8_order_by_ties",
    " UNION ALL ".join(
        _sql_ties(n, ", ".join(cols), key + (" DESC" if desc else ""), k)
        for n, cols, (key, desc), k in _TIE_CASES
    ),
)
def order_by_ties(t: Tables) -> DataFrame:
    """Top-N queries whose answer does or does not depend on ties."""
    lines = None
    for name, columns, (key, desc), limit in _TIE_CASES:
        df = t.orders.select(*dict.fromkeys([*columns, key]))
        order = [F.desc("_key") if desc else F.asc("_key")]
        keyed = df.select(*columns, F.col(key).alias("_key"))
        for side in R.order_ties(keyed, order, limit):
            rows = side.withColumn("query_id", F.lit(name))
            lines = rows if lines is None else lines.unionByName(rows)
    asked = R.query_list(t.spark, {c[0]: True for c in _TIE_CASES})
    return R.results_match(lines, asked).select("query_id", (~F.col("matched")).alias("ties"))


@query(
    "r8_ties_without_limit",
    """
SELECT (SELECT count(*) FROM (SELECT o_totalprice FROM orders GROUP BY 1
        HAVING count(DISTINCT o_orderkey) > 1)) > 0 AS has_ties""",
)
def ties_without_limit(t: Tables) -> DataFrame:
    """A full ORDER BY price: do two different rows share a price?"""
    return R.has_order_ties(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query(
    "r9_gold_audit",
    f"""
WITH items AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, lang AS db_id, source, n_chars,
         CASE WHEN n_chars < 200 THEN 'trivial' ELSE {roles.DIFFICULTY} END AS difficulty
  FROM documents d JOIN labels USING (doc_id)
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), lang, source, n_chars, {roles.DIFFICULTY}
  FROM documents JOIN labels USING (doc_id) WHERE source = 'src3'),
copies AS (SELECT id, count(*) AS n FROM items GROUP BY id)
SELECT i.id, CASE WHEN n > 1 THEN 'duplicate id'
    WHEN db_id = 'es' OR difficulty = 'trivial' THEN 'unknown db_id or difficulty'
    WHEN source = 'src5' THEN 'error: Binder Error'
    WHEN n_chars < 400 THEN 'empty result'
    WHEN n_chars < 500 THEN 'all-NULL result'
    WHEN quality = 0 AND toxic = 1 THEN 'non-deterministic (ties or unordered LIMIT)'
    WHEN toxic = 1 THEN 'ORDER BY ties change the result'
    WHEN quality = 0 THEN 'gold_result_hash is stale (now ' || substr(sha256(source || i.id), 1, 16) || ')' END AS problem
FROM items i JOIN copies USING (id) JOIN labels ON CAST(doc_id AS VARCHAR) = i.id""",
)
def gold_audit(t: Tables) -> DataFrame:
    """Labelled documents as gold items with every kind of problem."""
    docs = t.documents.join(t.labels, "doc_id")
    items = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("db_id"),
        F.when(F.col("n_chars") < 200, "trivial")
        .otherwise(roles.difficulty(F.col("n_chars")))
        .alias("difficulty"),
        F.when(
            F.col("quality") == 1,
            F.substring(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256), 1, 16),
        ).alias("gold_result_hash"),
        "source",
    )
    again = items.filter("source = 'src3'").join(
        t.documents.select(
            F.col("doc_id").cast("string").alias("id"),
            roles.difficulty(F.col("n_chars")).alias("d"),
        ),
        "id",
    ).withColumn("difficulty", F.col("d")).drop("d")
    checks = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("source") == "src5", "Binder Error").alias("error"),
        F.when(F.col("n_chars") < 400, 0).otherwise(1).alias("n_rows"),
        (F.col("n_chars") < 500).alias("all_null"),
        (~((F.col("quality") == 0) & (F.col("toxic") == 1))).alias("deterministic"),
        (F.col("toxic") == 1).alias("ties"),
        F.substring(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256), 1, 16).alias(
            "result_hash"
        ),
    )
    databases = t.documents.select(F.col("lang").alias("db_id")).filter("db_id <> 'es'")
    return R.audit_items(items.unionByName(again), checks, databases)


@query(
    "r10_capped_result",
    """
SELECT lang AS query_id, row_ix, row_count, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_ix,
         count(*) OVER (PARTITION BY lang) AS row_count FROM documents)
WHERE row_ix < 500""",
)
def capped_result(t: Tables) -> DataFrame:
    """The first 500 documents per language, with the full counts."""
    docs = t.documents.select("lang", "doc_id")
    rows = R.result_rows(docs, F.col("lang"), "a", ["doc_id"], ["doc_id"])
    asked = docs.select(F.col("lang").alias("query_id")).distinct()
    return R.capped(rows, asked).select(
        "query_id",
        "row_ix",
        "row_count",
        F.col("cells")[0]["num"].cast("bigint").alias("doc_id"),
    )


_BATCH = (
    ("segments", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", False),
    ("big_orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey;", True),
    ("no_rows", "SELECT * FROM part WHERE p_size < 0", False),
    ("bad_column", "SELECT c_colour FROM customer", False),
)


@query(
    "r11_query_batch",
    f"""
WITH s AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS ix
      FROM orders WHERE o_totalprice > 400000)
SELECT 'segments' AS query_id, FALSE AS failed, count(*) AS n_rows,
       {sql_hash("'2|' || " + sql_text_cell("k") + " || '|' || " + sql_num_cell("n::DOUBLE"))} AS result_hash FROM s
UNION ALL SELECT 'big_orders', FALSE, count(*), {sql_hash("ix || '#1|' || " + sql_num_cell("k::DOUBLE"))} FROM o
UNION ALL SELECT 'no_rows', FALSE, 0, NULL
UNION ALL SELECT 'bad_column', TRUE, 0, NULL""",
)
def query_batch(t: Tables) -> DataFrame:
    """Four SQL texts on the tables: two results, an empty one and a failure."""
    views = {name: f"{t.folder}/{name}.parquet" for name in ("customer", "orders", "part")}
    rows, errors = run_batch(t.spark, [Query(i, sql, "a", o) for i, sql, o in _BATCH], timeout=600, views=views)
    asked = R.query_list(t.spark, {i: o for i, _, o in _BATCH})
    hashes = R.result_hash(rows, asked).drop("side")
    failed = errors.select("query_id", F.lit(True).alias("failed"))
    return (
        asked.join(failed, "query_id", "left")
        .join(hashes, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("failed", F.lit(False)).alias("failed"),
            F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
            "result_hash",
        )
    )


def _judged(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines, asked = result_pairs(t)
    pairs = asked.join(t.nation.withColumnRenamed("n_name", "query_id"), "query_id")
    errors = t.nation.filter(F.col("n_name").endswith("7")).select(
        F.col("n_name").alias("query_id"), F.lit("transpile_error").alias("reason")
    )
    return R.equivalence_filter(pairs, lines, errors)


REASONS = """judged AS (
  SELECT query_id, CASE WHEN query_id LIKE '%7' THEN 'transpile_error'
    WHEN NOT matched THEN 'result_mismatch' END AS reason FROM matches)"""


@query(
    "r12_equivalence_filter",
    f"WITH {MATCH}, {REASONS} SELECT query_id, n_regionkey FROM judged JOIN nation ON n_name = query_id WHERE reason IS NULL",
)
def equivalence_filter(t: Tables) -> DataFrame:
    """The pairs whose two results agree."""
    return _judged(t)[0].select("query_id", "n_regionkey")


@query(
    "r12_equivalence_drops",
    f"WITH {MATCH}, {REASONS} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1",
)
def equivalence_drops(t: Tables) -> DataFrame:
    """Why the other pairs fell."""
    return _judged(t)[1]


@query(
    "r13_chart_kind",
    """
WITH rows AS (
  SELECT 'm' || o_custkey AS query_id, strftime(o_orderdate, '%Y-%m') AS x, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS y
  FROM orders GROUP BY ALL
  UNION ALL
  SELECT 'p' || o_custkey, nullif(o_orderpriority, '5-LOW'),
         sum(CAST(o_totalprice AS DECIMAL(12,2))) - 30000 FROM orders GROUP BY ALL),
stats AS (
  SELECT query_id, count(*) AS n, bool_and(coalesce(regexp_matches(x, '^\\d{4}-\\d{2}'), FALSE)) AS dated,
         count(*) - count(x) AS blanks, min(y) AS low FROM rows GROUP BY 1)
SELECT query_id, CASE WHEN n BETWEEN 2 AND 30 AND blanks = 0 THEN
    CASE WHEN dated AND n >= 3 THEN 'line' WHEN low >= 0 THEN 'bar' END END AS kind FROM stats""",
)
def chart_kind(t: Tables) -> DataFrame:
    """Each customer's spending by month and by priority: line, bar or no chart."""
    spent = F.sum(_cents("o_totalprice"))
    by_month = (
        t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("x"))
        .agg(spent.alias("y"))
        .withColumn("qid", F.concat(F.lit("m"), F.col("o_custkey").cast("string")))
    )
    by_priority = (
        t.orders.groupBy("o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("x"))
        .agg((spent - 30000).alias("y"))
        .withColumn("qid", F.concat(F.lit("p"), F.col("o_custkey").cast("string")))
    )
    rows = [R.result_rows(df, F.col("qid"), columns=["x", "y"], numeric_text=False) for df in (by_month, by_priority)]
    lines = rows[0].unionByName(rows[1])
    return R.chart_kind(lines, lines.select("query_id").distinct())



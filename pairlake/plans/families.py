"""Registered queries: the eleven families of questions people ask of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.operators.merge import not_in
from pairlake.operators.positions import with_previous, with_rank
from pairlake.operators.quantiles import percentile
from pairlake.plans.registry import Tables, query

MONEY = "decimal(12,2)"


def cents(c: str) -> Column:
    return F.col(c).cast(MONEY)


def total(c: str) -> Column:
    return F.sum(cents(c)).cast("double")


def revenue() -> Column:
    """Extended price after discount, added up exactly."""
    return F.sum(cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")


SQL_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"


def sql_total(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(12,2))) AS DOUBLE)"


# --- filters and top-N ------------------------------------------------------------------------


@query(
    "q1_filters",
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 150000
  AND (o_orderpriority ILIKE '%urgent%' OR o_orderpriority IN ('2-HIGH')) AND o_orderdate IS NOT NULL""",
)
def filters(t: Tables) -> DataFrame:
    """Equality, ranges, case-insensitive match, IN, OR and IS NOT NULL."""
    return t.orders.filter(
        (F.col("o_orderstatus") == "F")
        & F.col("o_totalprice").between(50000, 150000)
        & (F.col("o_orderpriority").ilike("%urgent%") | F.col("o_orderpriority").isin("2-HIGH"))
        & F.col("o_orderdate").isNotNull()
    ).select("o_orderkey", "o_totalprice")


@query(
    "q1_top_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_n(t: Tables) -> DataFrame:
    """The 25 most expensive orders."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("q1_distinct", "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 10")
def distinct_values(t: Tables) -> DataFrame:
    """Each brand and type once."""
    return t.part.filter("p_size > 10").select("p_brand", "p_type").distinct()


# --- aggregates -------------------------------------------------------------------------------


@query(
    "q2_aggregates",
    f"""
SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS lo, max(l_quantity) AS hi,
       {sql_total('l_extendedprice')} / count(*) AS mean_price, round({SQL_REVENUE}, 0) AS revenue,
       max(l_extendedprice) - min(l_extendedprice) AS spread FROM lineitem""",
)
def aggregates(t: Tables) -> DataFrame:
    """Counts, distinct counts, extremes, means and arithmetic on aggregates."""
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_partkey").alias("parts"),
        F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"),
        (total("l_extendedprice") / F.count(F.lit(1))).alias("mean_price"),
        F.round(revenue(), 0).alias("revenue"),
        (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"),
    )


@query(
    "q2_statistics",
    """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(stddev_pop(l_quantity), 6) AS sd,
       round(quantile_cont(l_quantity, 0.5), 4) AS median FROM lineitem GROUP BY 1""",
)
def statistics(t: Tables) -> DataFrame:
    """Correlation, deviation and exact median per return flag."""
    moments = t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("sd"),
    )
    medians = percentile(t.lineitem, ["l_returnflag"], "l_quantity", 0.5, "median")
    return moments.join(medians, "l_returnflag").withColumn("median", F.round("median", 4))


@query(
    "q2_price_percentiles",
    """
SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1""",
)
def price_percentiles(t: Tables) -> DataFrame:
    """Exact 90th percentile of line prices, nearly all of them different, per status."""
    found = percentile(t.lineitem, ["l_linestatus"], "l_extendedprice", 0.9, "p90")
    return found.withColumn("p90", F.round("p90", 4))


# --- grouping -----------------------------------------------------------------------------------


@query(
    "q3_group_having",
    f"""
SELECT o_custkey, count(*) AS n, {sql_total('o_totalprice')} AS spent FROM orders
GROUP BY o_custkey HAVING count(*) >= 12 AND {sql_total('o_totalprice')} > 1000000""",
)
def group_having(t: Tables) -> DataFrame:
    """Customers with many and large orders."""
    grouped = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("spent"))
    return grouped.filter("n >= 12 and spent > 1000000")


@query(
    "q3_revenue_by_segment",
    f"""
SELECT c_mktsegment, {SQL_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY 1""",
)
def revenue_by_segment(t: Tables) -> DataFrame:
    """Revenue and orders per market segment."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")
    )
    # Per order first: the distinct count then needs no second copy of the lines.
    per_order = joined.groupBy("c_mktsegment", "o_orderkey").agg(
        F.sum(cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r")
    )
    return per_order.groupBy("c_mktsegment").agg(
        F.sum("r").cast("double").alias("revenue"), F.count(F.lit(1)).alias("n_orders")
    )


@query(
    "q3_group_ranking",
    f"SELECT l_suppkey, {SQL_REVENUE} AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_suppkey LIMIT 10",
)
def group_ranking(t: Tables) -> DataFrame:
    """The ten suppliers with the highest revenue."""
    return t.lineitem.groupBy("l_suppkey").agg(revenue().alias("revenue")).orderBy(F.desc("revenue"), "l_suppkey").limit(10)


# --- joins --------------------------------------------------------------------------------------


@query(
    "q4_four_way_join",
    f"""
SELECT r_name, n_name, {SQL_REVENUE} AS revenue FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
)
def four_way_join(t: Tables) -> DataFrame:
    """Revenue per supplier nation and region."""
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r")
    )
    return (
        per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("r").cast("double").alias("revenue"))
    )


@query(
    "q4_left_join_zeros",
    """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
GROUP BY 1""",
)
def left_join_zeros(t: Tables) -> DataFrame:
    """Open orders per customer, zeros kept."""
    opened = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(opened, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders")
    )


@query(
    "q4_customer_supplier_nations",
    f"""
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, {SQL_REVENUE} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE cn.n_regionkey = sn.n_regionkey GROUP BY ALL""",
)
def customer_supplier_nations(t: Tables) -> DataFrame:
    """Trade inside each region, by customer and supplier nation."""
    buyers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("customer_nation"), F.col("n_regionkey").alias("cr")
    )
    sellers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("sr")
    )
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("cr = sr")
        .groupBy("customer_nation", "supplier_nation")
        .agg(revenue().alias("revenue"))
    )


@query(
    "q4_no_match",
    "SELECT p_partkey, p_name FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 WHERE l_orderkey IS NULL",
)
def no_match(t: Tables) -> DataFrame:
    """Parts never sold in large quantities (left join and IS NULL)."""
    large = t.lineitem.filter("l_quantity > 49").select("l_partkey")
    return t.part.join(large, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


# --- subqueries -----------------------------------------------------------------------------------


def _views(t: Tables, *names: str) -> None:
    for name in names:
        getattr(t, name).createOrReplaceTempView(name)


_SCALAR = """
SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT sum(CAST(o_totalprice AS DECIMAL(12,2))) * 1.8 / count(*) FROM orders)"""


@query("q5_scalar_subquery", _SCALAR)
def scalar_subquery(t: Tables) -> DataFrame:
    """Orders far above the average price."""
    _views(t, "orders")
    return t.spark.sql(_SCALAR)


@query(
    "q5_not_in",
    """
SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (
  SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9800)""",
)
def not_in_subquery(t: Tables) -> DataFrame:
    """Suppliers outside the nations of some customers."""
    rich = t.customer.filter("c_mktsegment = 'BUILDING' and c_acctbal > 9800")
    return not_in(t.supplier, "s_nationkey", rich, "c_nationkey").select("s_suppkey")


_EXISTS = """
SELECT o_orderkey, o_custkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity > 40)
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')"""


@query("q5_exists", _EXISTS)
def exists(t: Tables) -> DataFrame:
    """EXISTS and NOT EXISTS on the order lines."""
    _views(t, "orders", "lineitem")
    return t.spark.sql(_EXISTS)


_DERIVED = """
SELECT n_lines, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) AS q
GROUP BY n_lines"""


@query("q5_derived_table", _DERIVED)
def derived_table(t: Tables) -> DataFrame:
    """How many orders have how many lines."""
    _views(t, "lineitem")
    return t.spark.sql(_DERIVED)


# --- windows --------------------------------------------------------------------------------------


@query(
    "q6_rank_in_partition",
    """
SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part""",
)
def rank_in_partition(t: Tables) -> DataFrame:
    """Parts ranked by price inside their brand, however large a brand is."""
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    ranked = with_rank(t.part, ["p_brand"], "p_retailprice", order, "r")
    return ranked.select("p_partkey", "p_brand", "r")


@query(
    "q6_lag",
    """
SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS change
FROM orders""",
)
def lag(t: Tables) -> DataFrame:
    """Change of the price from a customer's previous order."""
    rows = with_previous(
        t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "before"
    )
    return rows.select(
        "o_custkey", "o_orderkey", (F.col("o_totalprice") - F.col("before")).alias("change")
    )


@query(
    "q6_running_total",
    """
SELECT c_mktsegment, month, CAST(sum(m) OVER (PARTITION BY c_mktsegment ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
FROM (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS m
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
)
def running_total(t: Tables) -> DataFrame:
    """Running monthly revenue per segment; the window sees months, not orders."""
    monthly = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.sum(cents("o_totalprice")).alias("m"))
    )
    w = Window.partitionBy("c_mktsegment").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("c_mktsegment", "month", F.sum("m").over(w).cast("double").alias("running"))


@query(
    "q6_qualify",
    """
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
)
def qualify(t: Tables) -> DataFrame:
    """The two largest orders of each customer (filter on a window)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey")


# --- time -----------------------------------------------------------------------------------------


@query(
    "q7_year_month",
    f"""
SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, {sql_total('o_totalprice')} AS total
FROM orders GROUP BY ALL""",
)
def year_month(t: Tables) -> DataFrame:
    """Orders per calendar month."""
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total")
    )


@query(
    "q7_period_over_period",
    """
SELECT strftime(q, '%Y-%m-%d') AS quarter, CAST(s AS DOUBLE) AS revenue,
       round(CAST(s AS DOUBLE) / CAST(lag(s) OVER (ORDER BY q) AS DOUBLE) - 1, 6) AS growth
FROM (SELECT date_trunc('quarter', l_shipdate) AS q, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS s FROM lineitem GROUP BY 1)""",
)
def period_over_period(t: Tables) -> DataFrame:
    """Quarterly revenue and its growth; one row per quarter reaches the window."""
    quarterly = t.lineitem.groupBy(F.date_trunc("quarter", "l_shipdate").alias("q")).agg(
        F.sum(cents("l_extendedprice")).alias("s")
    )
    before = F.lag(F.col("s").cast("double")).over(Window.orderBy("q"))
    return quarterly.select(
        F.date_format("q", "yyyy-MM-dd").alias("quarter"),
        F.col("s").cast("double").alias("revenue"),
        F.round(F.col("s").cast("double") / before - 1, 6).alias("growth"),
    )


# --- conditional ------------------------------------------------------------------------------------


@query(
    "q8_case_buckets",
    """
SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n,
       round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 4) AS pct FROM part GROUP BY 1""",
)
def case_buckets(t: Tables) -> DataFrame:
    """Parts by size bucket, with percentages."""
    _views(t, "part")
    return t.spark.sql(
        """
        SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket,
               count(*) AS n, round(100.0D * count(*) / (SELECT count(*) FROM part), 4) AS pct
        FROM part GROUP BY 1"""
    )


@query(
    "q8_filter_where",
    """
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount = 0) AS full_price,
       round(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*), 6) AS share FROM lineitem GROUP BY 1""",
)
def filter_where(t: Tables) -> DataFrame:
    """Returned and full-price lines per supplier."""
    returned = F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_suppkey").agg(
        returned.alias("returned"),
        F.count_if(F.col("l_discount") == 0).alias("full_price"),
        F.round(returned / F.count(F.lit(1)), 6).alias("share"),
    )


# --- multi-step -------------------------------------------------------------------------------------


@query(
    "q9_cte_chain",
    f"""
WITH spend AS (SELECT o_custkey, {sql_total('o_totalprice')} AS s FROM orders GROUP BY 1),
nations AS (SELECT c_nationkey, max(s) AS best FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_name, c_custkey, s AS spent FROM spend JOIN customer ON o_custkey = c_custkey
JOIN nations USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey WHERE s = best""",
)
def cte_chain(t: Tables) -> DataFrame:
    """The best customer of each nation, in steps."""
    spend = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("spent"))
    rows = spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    best = rows.groupBy("c_nationkey").agg(F.max("spent").alias("best"))
    return (
        rows.join(best, "c_nationkey")
        .filter("spent = best")
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select("n_name", "c_custkey", "spent")
    )


@query(
    "q9_top_per_group",
    f"""
WITH sales AS (SELECT p_type, p_partkey, {SQL_REVENUE} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, p_partkey, revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_partkey) AS r FROM sales) WHERE r <= 3""",
)
def top_per_group(t: Tables) -> DataFrame:
    """The three best-selling parts of each type; lines are summed before the join."""
    sales = t.lineitem.groupBy("l_partkey").agg(revenue().alias("revenue"))
    rows = sales.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_type").orderBy(F.desc("revenue"), "p_partkey")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_type", "p_partkey", "revenue")


# --- sets -------------------------------------------------------------------------------------------


@query(
    "q10_union",
    "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier",
)
def union(t: Tables) -> DataFrame:
    """Nations with a debtor or a supplier."""
    return (
        t.customer.filter("c_acctbal < 0")
        .select(F.col("c_nationkey").alias("k"))
        .union(t.supplier.select("s_nationkey"))
        .distinct()
    )


@query(
    "q10_union_all",
    "SELECT 'customer' AS kind, c_nationkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier",
)
def union_all(t: Tables) -> DataFrame:
    """Customers and suppliers in one list."""
    return t.customer.select(
        F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("balance")
    ).union(t.supplier.select(F.lit("supplier"), "s_nationkey", "s_acctbal"))


@query(
    "q10_intersect",
    "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity >= 50",
)
def intersect(t: Tables) -> DataFrame:
    """Parts that were both returned and sold in bulk."""
    returned = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey")
    return returned.intersect(t.lineitem.filter("l_quantity >= 50").select("l_partkey"))


@query(
    "q10_except",
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def except_(t: Tables) -> DataFrame:
    """Customers without an urgent order."""
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(
        t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    )


@query(
    "q10_except_all",
    "SELECT l_suppkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 10",
)
def except_all(t: Tables) -> DataFrame:
    """Repeated rows counted: lines left after taking the larger ones away."""
    lines = t.lineitem.select("l_suppkey", "l_returnflag")
    return lines.exceptAll(t.lineitem.filter("l_quantity > 10").select("l_suppkey", "l_returnflag"))


# --- text -------------------------------------------------------------------------------------------


@query(
    "q11_text_functions",
    """
SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) || ' (' || p_brand || ')' AS label,
       length(p_name)::INTEGER AS n, coalesce(nullif(p_type, 'SMALL'), 'tiny') AS kind, CAST(p_size AS VARCHAR) || 'cm' AS size
FROM part WHERE lower(p_name) LIKE '%ring%'""",
)
def text_functions(t: Tables) -> DataFrame:
    """Labels from names: substrings, case, length, concatenation, COALESCE, casts."""
    name = F.col("p_name")
    return t.part.filter(F.lower("p_name").like("%ring%")).select(
        "p_partkey",
        F.concat(
            F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))), F.lit(" ("), "p_brand", F.lit(")")
        ).alias("label"),
        F.char_length(name).alias("n"),
        F.coalesce(F.nullif("p_type", F.lit("SMALL")), F.lit("tiny")).alias("kind"),
        F.concat(F.col("p_size").cast("string"), F.lit("cm")).alias("size"),
    )


@query(
    "q11_word_counts",
    r"""
SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))::BIGINT AS words, max(length(text))::INTEGER AS longest
FROM documents GROUP BY 1""",
)
def word_counts(t: Tables) -> DataFrame:
    """Words and lengths of the documents per language."""
    return t.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))).alias("words"),
        F.max(F.char_length("text")).alias("longest"),
    )

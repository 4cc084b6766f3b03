import pytest
from pyspark.sql import functions as F

from pairlake.functions import sqltext
from pairlake.operators.scoring import error_tag


# Outermost clauses and what hides them, put together in every way.
INNER = (
    "orders",
    "(SELECT * FROM orders ORDER BY o_totalprice) AS o",
    "(SELECT * FROM orders LIMIT 20) AS o",
    "(SELECT * FROM orders ORDER BY o_totalprice LIMIT 20) AS o",
)
COLUMN = (
    "o_custkey",
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS k",
    "'limit 5 order by 1' AS k",
)
TAIL = (("", False, False), (" ORDER\nBY 1", True, False), (" LIMIT 7", False, True), (" order by 1 limit 7;", True, False))


@pytest.mark.parametrize("inner", INNER)
@pytest.mark.parametrize("column", COLUMN)
@pytest.mark.parametrize(("tail", "ordered", "unordered_limit"), TAIL)
def test_only_the_outermost_clauses_count(one, inner, column, tail, ordered, unordered_limit):
    for start in ("", "WITH big AS (SELECT 1 LIMIT 1) "):
        sql = f"{start}SELECT {column} FROM {inner} -- order by 1 limit 2\n{tail}"
        assert one(sqltext.has_order_by, sql) is ordered
        assert one(sqltext.unordered_limit, sql) is unordered_limit


@pytest.mark.parametrize(
    ("sql", "tables", "joins", "columns"),
    [
        ("SELECT a FROM t", ["t"], 0, 1),
        ("SELECT t.a, s.b FROM db.t AS t JOIN s ON s.k = t.k", ["s", "t"], 1, 2),
        ('SELECT count(a, b) c FROM "Big", u x WHERE a IN (SELECT k FROM v)', ["big", "u", "v"], 1, 1),
        ("WITH c AS (SELECT a FROM t), d AS (SELECT 1) SELECT a, 1, 2 FROM c, d", ["t"], 1, 3),
        ("SELECT extract(year FROM d), substring(s FROM 2) FROM t", ["t"], 0, 2),
        ("SELECT k FROM (SELECT k FROM v WHERE k IN (1, 2)) x, t, (SELECT f(g(1)) FROM w) AS y", ["t", "v", "w"], 2, 1),
        ("I cannot answer", [], 0, None),
    ],
)
def test_query_shape(one, sql, tables, joins, columns):
    assert one(sqltext.table_names, sql) == tables
    assert one(sqltext.join_count, sql) == joins
    assert one(sqltext.output_columns, sql) == columns


@pytest.mark.parametrize("depth", [1, 7, 20])
def test_tables_are_seen_at_any_depth(one, depth):
    sql = "SELECT a FROM inner_one i, inner_two JOIN x USING (k)"
    for level in range(depth):
        sql = f"SELECT f((1 + (2))), b FROM ({sql}) d, t{level % 3} WHERE z IN (SELECT k FROM u{level} y, v WHERE (1) = 1)"
    names = {"inner_one", "inner_two", "x", "v", *(f"t{i % 3}" for i in range(depth)), *(f"u{i}" for i in range(depth))}
    assert one(sqltext.table_names, sql) == sorted(names)
    assert one(sqltext.join_count, sql) == 2 + 2 * depth
    assert one(sqltext.output_columns, sql) == 2


@pytest.mark.parametrize(
    ("sql", "tables", "joins"),
    [
        ("SELECT 1 FROM a JOIN b ON a.x = b.x, c WHERE f(1, d) > 2 ORDER BY e, g", ["a", "b", "c"], 2),
        ("SELECT 1 FROM a WHERE x IS DISTINCT FROM y AND extract(year FROM (SELECT max(d) FROM b)) > 1", ["a", "b"], 0),
        ("SELECT 1 FROM a, LATERAL (SELECT 1 FROM b) l LEFT JOIN (SELECT 2, 3 FROM c) m USING (k), d", ["a", "b", "c", "d"], 3),
        ("WITH r(n, m) AS (SELECT 1, 2), s AS (SELECT 1 FROM a) SELECT n FROM r, s JOIN b USING (n)", ["a", "b"], 2),
        ("SELECT 1 FROM a UNION SELECT b, c FROM d GROUP BY e, f) g, h", ["a", "d"], 0),
    ],
)
def test_where_tables_stand(one, sql, tables, joins):
    assert (one(sqltext.table_names, sql), one(sqltext.join_count, sql)) == (tables, joins)


def star(tables=("lineitem", "orders"), select="l_partkey", extra=""):
    """A query over the star schema: joins its tables on one key each."""
    first, *rest = tables
    joins = "".join(f" JOIN {t} AS t{i} ON t{i}.k = {i}" for i, t in enumerate(rest))
    return f"SELECT {select} FROM {first}{joins}{extra}"


GOLD = star(extra=" WHERE l_quantity > 5")
# (what the query does other than the gold query, the result's width, the tag)
SHAPES = [
    (star(("lineitem", "part")), None, "wrong column or table"),
    (star(("lineitem",)), None, "wrong column or table"),
    (star(select="l_partkey, l_tax"), 2, "wrong column or table"),
    (star(("lineitem", "orders", "orders")), None, "join error"),
    (star(select="sum(l_tax)"), None, "aggregation"),
    (star(extra=" GROUP BY l_partkey"), None, "aggregation"),
    (star(extra=" WHERE month(l_shipdate) = 3"), None, "date/time functions"),
    (star(extra=" WHERE l_quantity > 50"), None, "other"),
    (star(extra=" WHERE l_quantity > 50"), 1, "other"),
]
# (an engine's message about a query of the right form, the tag)
MESSAGES = [
    ("Parser Error: unexpected token l_tax", "dialect error"),
    ('Binder Error: Referenced column "l_colour" was not found', "hallucinated schema"),
    ("Catalog Error: Table with name parcels is missing", "hallucinated schema"),
    ('Binder Error: Ambiguous reference to column name "l_suppkey"', "join error"),
    ('Binder Error: column "l_tax" must appear in the GROUP BY clause', "aggregation"),
    ("Binder Error: no function matches the call date_trunc(DOUBLE)", "date/time functions"),
    ("Conversion Error: cannot read this", "dialect error"),
]


def tag_of(spark, sql, error, n_cols):
    df = spark.createDataFrame([(sql, error, GOLD, n_cols)], "s string, e string, g string, n int")
    return df.select(error_tag(F.col("s"), F.col("e"), F.col("g"), F.col("n")).alias("tag")).first()["tag"]


def test_error_tags_by_shape(spark):
    assert [tag_of(spark, sql, None, n) for sql, n, _ in SHAPES] == [tag for _, _, tag in SHAPES]


def test_error_tags_by_message(spark):
    assert [tag_of(spark, GOLD, error, None) for error, _ in MESSAGES] == [tag for _, tag in MESSAGES]


@pytest.mark.parametrize("sql", [None, "  ", "Dear user, the answer is 7.", "UPDATE orders SET o_custkey = 1"])
def test_answers_that_are_no_query(spark, sql):
    assert tag_of(spark, sql, None, None) == "formatting"


def _parsed(spark, **over):
    base = {
        "select_aggs": [3], "table_units": 1, "from_conds": [], "from_ops": [],
        "where_conds": [], "where_ops": [], "group_aggs": [], "having_conds": [],
        "having_ops": [], "order_aggs": [], "has_limit": False,
        "has_intersect": False, "has_union": False, "has_except": False,
    }
    names = [f.strip().split(" ")[0] for f in
             "select_aggs,table_units,from_conds,from_ops,where_conds,where_ops,group_aggs,"
             "having_conds,having_ops,order_aggs,has_limit,has_intersect,has_union,has_except".split(",")]
    row = tuple((base | over)[n] for n in names)
    df = spark.createDataFrame([row], sqltext.PARSED)
    return df.select(sqltext.hardness(*sqltext.hardness_counts()).alias("h")).first()["h"]


def test_hardness(spark):
    cond = (False, 2, 0)
    assert _parsed(spark) == "easy"
    assert _parsed(spark, select_aggs=[0, 3], has_limit=True) == "medium"
    assert _parsed(spark, has_union=True, has_limit=True) == "hard"
    assert _parsed(spark, has_union=True, has_limit=True, order_aggs=[0]) == "extra"
    assert _parsed(spark, where_conds=[(False, 9, 0)]) == "medium"
    assert _parsed(spark, where_conds=[cond, cond], where_ops=["or"], table_units=3) == "extra"
    assert _parsed(spark, where_conds=[(False, 2, 1)]) == "hard"

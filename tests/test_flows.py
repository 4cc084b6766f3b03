"""Scores and votes from SQL text, the ledger of runs, and what a text may do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairlake.functions.sqltext import tie_broken
from pairlake.operators import flows, ledger
from pairlake.operators.ledger import Ledger
from pairlake.operators.runner import NotAQuery, Query, check_reads_only, run_batch

SCORES = "team string, player string, points int"


@pytest.fixture
def tables(spark):
    rows = [("red", "ann", 3), ("red", "bob", 5), ("blue", "cy", 5), ("blue", "di", 1), ("blue", None, 5)]
    spark.createDataFrame(rows, SCORES).createOrReplaceTempView("scores")
    return ("scores",)


@pytest.fixture
def started(monkeypatch):
    """Texts that are started as jobs, one list per call."""
    seen = []

    def watch(spark, texts, *args):
        seen.append(sorted(texts.values()))
        return real(spark, texts, *args)

    real = ledger.run_texts
    monkeypatch.setattr(ledger, "run_texts", watch)
    return seen


def candidates(spark, *told):
    rows = [(q, i, "one model", sql) for i, (q, sql) in enumerate(told)]
    return spark.createDataFrame(rows, "question_id string, cand_ix int, model string, sql string")


def test_samples_of_one_model_are_told_apart(spark, tables):
    told = [("n", s) for s in ("SELECT 7", "SELECT count(*) FROM scores", "select count(team)\nfrom scores", None)]
    best = flows.vote_sql(candidates(spark, *told), Ledger(spark, tables)).first()
    assert (best["valid"], best["votes"]) == (3, 2)
    assert best["sql"] == "select count(team) from scores;" or best["sql"] == "SELECT count(*) FROM scores;"


def test_every_problem_of_a_candidate(spark, tables):
    texts = {
        "SELECT team, max(points) FROM scores GROUP BY team": None,
        "SELECT nope FROM scores": "error",
        "SELECT team FROM scores WHERE points < 0": "empty",
        "SELECT player FROM scores WHERE player IS NULL": "all_null",
        "SELECT player FROM scores LIMIT 1": "nondeterministic",
        "SELECT team FROM scores LIMIT 50": "limit_without_order",
        "SELECT team, sum(points) AS p FROM scores GROUP BY team ORDER BY p": None,
        "SELECT x FROM VALUES (1, 2), (1, 3) AS v(y, x) ORDER BY y": "order_ties",
        "SELECT max(map(team, points)['red']) AS m FROM scores ORDER BY m": None,
        "": "missing",
    }
    judged = flows.evaluate_sql(candidates(spark, *[("q", t) for t in texts]), Ledger(spark, tables))
    got = {r["cand_ix"]: (r["problem"], r["hash"] is None, r["ordered"]) for r in judged.collect()}
    for i, (text, problem) in enumerate(texts.items()):
        assert got[i] == (problem, problem is not None, "ORDER BY" in text if text else None), text


def test_sorted_and_unsorted_results_do_not_agree(spark, tables):
    told = [("q", "SELECT team FROM scores GROUP BY team"), ("q", "SELECT DISTINCT team FROM scores ORDER BY team")]
    best = flows.vote_sql(candidates(spark, *told), Ledger(spark, tables)).first()
    assert (best["valid"], best["votes"], best["sql"]) == (2, 1, None)


ITEMS = [
    ("max", "easy", "SELECT max(points) FROM scores", None),
    ("top", "hard", "SELECT player FROM scores WHERE team = 'red' ORDER BY points DESC", None),
    ("tied", "hard", "SELECT player FROM scores ORDER BY points DESC LIMIT 1", "0" * 16),
    ("old", "easy", "SELECT count(*) FROM scores", "0" * 16),
    ("broken", "easy", "SELECT nope FROM scores", None),
]


def score(spark, tables, answers):
    items = spark.createDataFrame(
        [(i, "s", *rest) for i, *rest in ITEMS],
        "id string, `set` string, difficulty string, gold_sql string, gold_result_hash string",
    )
    told = spark.createDataFrame(
        [("m", "r", "s", i, n, sql, 1.5, 7, None) for n, (i, sql) in enumerate(answers)],
        "model string, runtime string, `set` string, id string, seq int, sql string, latency_ms double, tokens_out int, tokens_in int",
    )
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double")
    return flows.score_sql(items, told, prices, Ledger(spark, tables))


def test_the_last_answer_of_an_id_counts(spark, tables):
    answers = [("max", "SELECT 1"), ("unknown", "SELECT 1"), ("max", "SELECT 5;"), ("old", "SELECT 5"), ("old", "SELECT 1")]
    scores = score(spark, tables, answers)
    got = {r["id"]: r for r in scores.outcomes.collect()}
    assert set(got) == {i for i, *_ in ITEMS} and len(got) == scores.outcomes.count()
    assert got["max"]["ex"] and got["max"]["sql"] == "SELECT 5;"
    assert not got["old"]["ex"] and got["old"]["valid"] and got["top"]["missing"]
    assert {i: r["gold"] for i, r in got.items()} == {"max": "ok", "top": "ok", "tied": "reran", "old": "stale", "broken": "error"}
    line = scores.summary.first()
    assert (line["n"], line["missing"], line["ex"], line["gold_reran"]) == (5, 3, 0.2, 1)
    assert line["cost_per_query_usd"] == round(3 * 7 * 2 / 1e6 / 3, 6)  # the unknown id is paid for


def test_order_and_width_are_found_from_the_texts(spark, tables):
    wrong_order = "SELECT player FROM scores WHERE team = 'red' ORDER BY points"
    right = "SELECT player FROM (SELECT player, points FROM scores WHERE team LIKE 'red') ORDER BY points DESC"
    one = {r["id"]: r for r in score(spark, tables, [("top", wrong_order), ("max", "SELECT player, max(points) FROM scores GROUP BY 1")]).outcomes.collect()}
    two = {r["id"]: r for r in score(spark, tables, [("top", right), ("max", "SELECT * FROM (SELECT max(points), 1 FROM scores)")]).outcomes.collect()}
    assert not one["top"]["ex"] and one["top"]["tag"] == "other" and two["top"]["ex"]
    # Two columns where one was asked for: the text alone (SELECT *) does not tell.
    assert two["max"]["tag"] == "wrong column or table" and not two["max"]["ex"]


def test_equal_texts_run_once(spark, tables, started, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    texts = spark.createDataFrame([("SELECT 1 AS x",)] * 10 + [("SELECT 2 AS x",), (None,), ("",)], "sql string")
    first = Ledger(spark, tables, folder=folder)
    assert first.run(texts).count() == 2 and started == [["SELECT 1 AS x", "SELECT 2 AS x"]]
    more = texts.unionByName(spark.createDataFrame([("SELECT 3 AS x",), ("SELECT nope",)], "sql string"))
    again = Ledger(spark, tables, folder=folder)
    ends = again.run(more)
    assert started[1:] == [["SELECT 3 AS x", "SELECT nope"]]
    assert again.rows(ends).count() == 3 and ends.filter("error is not null").count() == 1
    Ledger(spark, tables, folder=folder).run(more)
    assert started[2] == []
    Ledger(spark, tables, folder=folder, version="other data").run(texts)
    assert len(started[3]) == 2
    checks = again.check(texts)
    assert checks.count() == 2 and started[4:] == [[], ["SELECT 1 AS x", "SELECT 2 AS x"], []]
    assert sorted(map(tuple, again.check(texts).collect())) == sorted(map(tuple, checks.collect()))
    assert started[7:] == [[]]


def test_a_text_out_of_time_is_not_remembered(spark, tables, started):
    slow = "SELECT count(*) FROM range(0, 10000000000, 1, 1) WHERE sha2(cast(id AS string), 512) = 'x'"
    texts = spark.createDataFrame([(slow,)], "sql string")
    held = Ledger(spark, tables, timeout=3)
    assert "longer than 3 s" in held.run(texts).first()["error"]
    assert held.run(texts).count() == 1 and started == [[slow], [slow]]


def test_a_batch_runs_equal_texts_once(spark, tables):
    asked = [Query(f"q{i}", "SELECT team FROM scores ORDER BY points, team, player", ordered=i == 1) for i in range(3)]
    rows, errors = run_batch(spark, [*asked, Query("bad", "SELECT 1 +")])
    assert [r["query_id"] for r in errors.collect()] == ["bad"]
    found = {}
    for r in rows.collect():
        found.setdefault(r["query_id"], []).append((r["row_ix"], r["cells"][0]["str"]))
    assert {k: len(v) for k, v in found.items()} == {"q0": 5, "q1": 5, "q2": 5}
    assert [i for i, _ in sorted(found["q1"])] == [0, 1, 2, 3, 4]


REFUSED = [
    "SELECT reflect /* c */ ('java.lang.System', 'exit', 1)",
    "SELECT `REFLECT`\n('java.lang.System', 'exit', 1)",
    "SELECT Java_Method -- c\n('java.lang.System', 'exit', 1)",
    "SELECT system.builtin.try_reflect('a', 'b')",
    "SELECT 1 WHERE EXISTS (SELECT 1 WHERE 1 IN (SELECT reflect('a', 'b')))",
    "WITH a AS (SELECT reflect('a', 'b') AS x) SELECT 1",
    "SELECT rank() OVER w FROM scores WINDOW w AS (ORDER BY reflect('a', 'b'))",
    "SELECT x FROM VALUES (reflect('a', 'b')) AS t(x)",
    "SELECT * FROM explode(array(reflect('a', 'b')))",
    "SELECT e FROM scores LATERAL VIEW explode(array(reflect('a', 'b'))) v AS e",
    "FROM scores |> SELECT reflect('a', 'b')",
    "SELECT transform(array(1), x -> reflect('a', 'b'))",
    "SELECT IDENTIFIER('ref' || 'lect')('a', 'b')",
    "SELECT * FROM IDENTIFIER('scores')",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "SELECT TRANSFORM(team) USING 'cat' AS (x) FROM scores",
    "WITH a AS (SELECT 1) INSERT INTO scores SELECT 1, 2, 3",
    "SELECT my_own_function(1)",
    "SELECT other.abs(1)",
    "DESCRIBE scores",
    "CACHE TABLE scores",
    "DELETE FROM scores",
]
ALLOWED = [
    "SELECT reflect + (1) FROM (SELECT 1 AS reflect)",
    "SELECT 'reflect(1)' AS `java_method(` -- reflect('a')\n FROM scores /* reflect('b') */",
    "WITH a(x) AS (SELECT 1) SELECT x, count(*) FILTER (WHERE x > 0) FROM a GROUP BY CUBE(x) HAVING max(x) > 0 ORDER BY ALL",
    "SELECT DISTINCT sum(points) OVER (PARTITION BY team) FROM scores NATURAL JOIN scores s2 LIMIT 3 OFFSET 1",
    "(SELECT 1 UNION SELECT 2) EXCEPT SELECT 3 INTERSECT VALUES (4)",
    "SELECT * FROM range(3) r, LATERAL (SELECT r.id + 1), explode(array(1)) AS t(x)",
    "SELECT * FROM scores PIVOT (sum(points) FOR team IN ('red', 'blue'))",
    "SELECT extract(year FROM current_date()), points::string, builtin.abs(points) FROM scores TABLESAMPLE (2 ROWS)",
    "SELECT /*+ BROADCAST(scores) */ percentile_cont(0.5) WITHIN GROUP (ORDER BY points) FROM scores",
    "SELECT team FROM scores SORT BY team",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_what_is_no_query_is_refused(spark, tables, sql):
    with pytest.raises(NotAQuery):
        check_reads_only(spark, sql)


def test_queries_are_let_through(spark, tables):
    for sql in ALLOWED:
        check_reads_only(spark, sql)
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        check_reads_only(spark, "SELECT 1; SELECT 2")


def test_ties_are_broken_in_the_outermost_order(spark, tables):
    def both(sql, n=2):
        return tie_broken(sql, n, False), tie_broken(sql, n, True)

    assert both("SELECT a, b FROM t") == both("SELECT (SELECT x FROM u ORDER BY x), 1 FROM t") == (None, None)
    assert both("SELECT a FROM t ORDER BY ALL") == (None, None)
    assert both("SELECT a, b FROM t ORDER BY a;")[0] == "SELECT a, b FROM t ORDER BY a\n, 1 ASC, 2 ASC\n;"
    texts = [
        "SELECT team, points FROM scores ORDER /* LIMIT 1 */ BY points DESC -- LIMIT 2\n LIMIT 4",
        "SELECT 'order by', \"x\" FROM (SELECT 1 FROM scores ORDER BY 1 LIMIT 1) order by 'a)b', (1) offset 0",
        "SELECT team, 1 FROM scores UNION ALL SELECT player, rank() OVER (ORDER BY points) FROM scores ORDER BY 1 -- end",
        "SELECT team, sum(points) OVER w FROM scores ORDER BY `team` WINDOW w AS (PARTITION BY team ORDER BY player) LIMIT 3",
    ]
    for sql in texts:
        for broken in both(sql):
            assert spark.sql(broken).count() == spark.sql(sql).count()
            keys = spark.sql(broken)._jdf.queryExecution().analyzed().toString()
            assert "Sort [" in keys and keys.split("Sort [")[1].split("]")[0].count(" NULLS ") >= 3


def test_answers_may_have_no_text(spark, tables):
    got = {r["id"]: r for r in score(spark, tables, [("max", None), ("old", "")]).outcomes.collect()}
    assert not got["max"]["missing"] and not got["max"]["valid"] and got["max"]["tag"] == "formatting"
    assert score(spark, tables, [("unknown", "SELECT 1")]).outcomes.filter(F.col("ex")).count() == 0


def test_rows_are_numbered_without_a_sort(spark, monkeypatch):
    """Two tasks wrote an ordered result: its rows follow on, and nothing is sorted again."""
    from pairlake.operators import positions, runner

    def no_sort(*args):
        raise AssertionError("rows were sorted again")

    monkeypatch.setattr(positions, "_sorted", no_sort)
    lines = [("q", s, (task << 33) + i, f"{task}{i}") for s in "ab" for task, n in ((0, 3), (2, 2), (5, 4)) for i in range(n)]
    lines += [("free", "a", (7 << 33) + 1, "x")]
    rows = spark.createDataFrame(lines, "query_id string, side string, row_ix bigint, cells string")
    asked = spark.createDataFrame([("q", True), ("free", False)], "query_id string, ordered boolean")
    got = {}
    for r in runner.dense(rows, asked).collect():
        got.setdefault((r["query_id"], r["side"]), []).append((r["row_ix"], r["cells"]))
    order = ["00", "01", "02", "20", "21", "50", "51", "52", "53"]
    for side in "ab":
        assert sorted(got["q", side]) == list(enumerate(order))
    assert got["free", "a"] == [((7 << 33) + 1, "x")]

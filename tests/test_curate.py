import hashlib

from pyspark.sql import functions as F

from pairlake.operators import consensus as V
from pairlake.operators import curate as K
from pairlake.operators import similarity as S

RECORD = (
    "id string, seq bigint, db_id string, question string, sql string, result_hash string, "
    "decision string, difficulty string"
)
TESTS = "id string, db_id string, question string, gold_sql string, gold_result_hash string"


def test_finalize_funnel(spark):
    def rec(n, q, s, h, decision="agreed"):
        return (f"c{n}", n, "db", q, s, h, decision, "easy")

    tests = spark.createDataFrame(
        [("t", "db", "How many lakes are there?", "SELECT count(*) FROM lake;", "g"), ("u", "db", "zz", "zz", "")],
        TESTS,
    )
    records = spark.createDataFrame(
        [
            rec(0, "How many lakes are there?", "SELECT 1;", "a"),
            rec(1, "Number of lakes in total?", "SELECT 2;", "g"),
            rec(2, "Largest lake by area?", "SELECT 3;", "b"),
            rec(3, "largest lake, by area", "SELECT 4;", ""),
            rec(4, "Smallest lake of all?", "SELECT 5;", "c"),
            rec(5, "Deepest one?", "SELECT 6;", "d", "no_agreement"),
        ],
        RECORD,
    )
    kept, drops = K.finalize(records, tests, 1)
    assert [r["id"] for r in kept.collect()] == ["c2"]
    assert {r["reason"]: r["n"] for r in drops.collect()} == {
        "test_leakage_text": 1,
        "test_leakage_same_result": 1,
        "duplicate_question": 1,
        "over_target": 1,
    }
    ids = K.sequence_ids(kept).collect()
    assert ids[0]["new_id"] == "synth_db_0001"


def test_finalize_normalises_every_text_once(spark, monkeypatch):
    """The leak check goes on with the words that the dedupe has found."""
    questions = [f"how many lakes lie in country {n}" for n in range(30)]
    records = spark.createDataFrame(
        [(f"c{n}", n, "db", q, f"SELECT {n};", "h", "agreed", "easy") for n, q in enumerate(questions)], RECORD
    )
    tests = spark.createDataFrame([("t", "db", "How many lakes lie in country 7?", "SELECT x;", "g")], TESTS)
    calls, known = [], S.token_sets
    monkeypatch.setattr(S, "token_sets", lambda rows, *a: calls.append(1) or known(rows, *a))
    kept, _ = K.finalize(records, tests, 100)
    assert {r["id"] for r in kept.collect()} == {f"c{n}" for n in range(30)} - {"c7"}
    assert len(calls) == 2  # the records and the tests


def test_hold_out_includes_the_crossing_database(spark):
    sizes = {"a": 5, "b": 10, "c": 20, "d": 40, "e": 3}
    rows = [(db, "spider") for db, n in sizes.items() for _ in range(n)] + [("f", "other")] * 60
    df = spark.createDataFrame(rows, "db_id string, source string")
    for fraction in (0.05, 0.1, 0.4):
        order = sorted(sizes, key=lambda d: hashlib.sha256(f"s1:{d}".encode()).hexdigest())
        want, n = set(), 0
        for db in order:
            if n >= fraction * len(rows):
                break
            want.add(db)
            n += sizes[db]
        assert {r["db_id"] for r in K.hold_out(df, "s1", fraction).collect()} == want


def test_seeded_subsets_are_nested(spark):
    df = spark.createDataFrame([(f"i{i}",) for i in range(981)], "id string")
    small = [r["id"] for r in K.seeded_subset(df, 100, "s").collect()]
    large = {r["id"] for r in K.seeded_subset(df.repartition(7), 200, "s").collect()}
    assert len(small) == 100 and len(large) == 200 and set(small) <= large
    assert small == sorted(small) == [r["id"] for r in K.seeded_subset(df, 100, "s").collect()]


def test_review_quotas():
    assert K.quotas(("x", "y", "z"), 50) == {"x": 17, "y": 17, "z": 16}


def test_systematic_sample(spark):
    df = spark.createDataFrame([("s", f"{i:03d}") for i in range(25)] + [("t", "000")], "set string, id string")
    got = sorted((r["set"], r["id"]) for r in K.systematic_sample(df).collect())
    assert got == [("s", "000"), ("s", "010"), ("s", "020"), ("t", "000")]


def test_length_percentiles(spark):
    import random
    import statistics

    rnd = random.Random(1)
    for n in (1, 2, 7, 40):
        xs = [rnd.randint(1, 30) for _ in range(n)]
        df = spark.createDataFrame([("g", x) for x in xs], "g string, n bigint")
        got = K.length_percentiles(df, "g", "n").first()
        s = sorted(xs)
        assert (got["p50"], got["p95"], got["max"]) == (int(statistics.median(s)), s[int(0.95 * (n - 1))], s[-1])


CANDIDATE = "question_id string, cand_ix int, sql string, ordered boolean, hash string"


def test_vote(spark):
    cases = {
        "agree": [("SELECT x AS y;", False, "h1"), ("SELECT x;", False, "h1"), ("S;", False, "h2")],
        "split": [("a;", False, "h1"), ("b;", False, "h2"), ("c;", False, None)],
        "none": [("a;", False, None)],
        "order_differs": [("a;", True, "h1"), ("b;", False, "h1")],
        "tie": [("aa;", False, "h1"), ("b;", False, "h2"), ("cc;", False, "h1"), ("d;", False, "h2")],
        "same_length": [("b;", False, "h1"), ("a;", False, "h1")],
    }
    rows = [(q, i, *c) for q, cs in cases.items() for i, c in enumerate(cs)]
    got = {
        r["question_id"]: (r["sql"], r["votes"], r["valid"])
        for r in V.vote(spark.createDataFrame(rows, CANDIDATE).repartition(3)).collect()
    }
    assert got == {
        "agree": ("SELECT x;", 2, 3),
        "split": (None, 1, 2),
        "none": (None, 0, 0),
        "order_differs": (None, 1, 2),
        "tie": ("aa;", 2, 4),
        "same_length": ("b;", 2, 2),
    }


def test_decisions(spark):
    questions = spark.createDataFrame(
        [("a", "q", "easy"), ("b", "", "easy"), ("c", "q", "huge"), ("d", "q", "hard"), ("e", "q", "extra"), ("f", "q", "easy")],
        "question_id string, question string, difficulty string",
    )
    votes = spark.createDataFrame(
        [("a", 2, 2, "s;", "h"), ("b", 2, 2, "s;", "h"), ("d", 2, 1, None, None), ("e", 1, 1, None, None)],
        "question_id string, valid bigint, votes bigint, sql string, result_hash string",
    )
    got = {r["question_id"]: r["decision"] for r in V.decide(questions, votes).collect()}
    assert got == {
        "a": "agreed", "b": "bad_item", "c": "bad_item", "d": "no_agreement", "e": "too_few_valid", "f": "too_few_valid",
    }


def test_candidate_problems(spark):
    schema = (
        "n int, sql string, error string, n_rows int, all_null boolean, deterministic boolean, "
        "ties boolean, limit_without_order boolean, hash string"
    )
    fine = ("s;", None, 3, False, True, False, False, "h")
    rows = [fine, ("", *fine[1:]), ("s;", "boom", None, None, None, None, None, None),
            ("s;", None, 0, True, True, False, False, "h"), ("s;", None, 1, True, True, False, False, "h"),
            ("s;", None, 1, False, False, False, False, "h"), ("s;", None, 1, False, True, True, False, "h"),
            ("s;", None, 1, False, True, False, True, "h")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    got = {r["n"]: (r["problem"], r["hash"]) for r in V.evaluate(df).collect()}
    assert got == {
        0: (None, "h"), 1: ("missing", None), 2: ("error", None), 3: ("empty", None), 4: ("all_null", None),
        5: ("nondeterministic", None), 6: ("order_ties", None), 7: ("limit_without_order", None),
    }


def test_same_result_needs_database_and_hash(spark):
    rows = spark.createDataFrame([("a", "db", "r1"), ("b", "x", "r1"), ("c", "db", "")], "id string, db_id string, result_hash string")
    tests = spark.createDataFrame([("db", "r1"), ("db", ""), ("db", None)], "db_id string, gold_result_hash string")
    assert [r["id"] for r in K.same_result_as_test(rows, tests).collect()] == ["a"]


def test_split_overlap(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "db_id string")
    val = spark.createDataFrame([("b",), ("c",)], "db_id string")
    assert [r["db_id"] for r in K.shared_databases(train, val).collect()] == ["b"]


def test_exact_dedupe_keeps_the_first_id(spark):
    df = spark.createDataFrame(
        [(3, "db", "A b", "S;"), (1, "db", "a, B!", "s ;"), (2, "x", "a b", "s"), (4, "db", "a b", "t")],
        "id int, db_id string, question string, sql string",
    )
    assert sorted(r["id"] for r in K.exact_dedupe(df).collect()) == [1, 2, 4]
    assert K.exact_dedupe(df).filter("id = 1").select(F.col("question")).first()[0] == "a, B!"


def test_agreed_pairs_replace_the_old_synthetic_rows(spark):
    from pairlake.operators import flows

    questions = spark.createDataFrame(
        [("q1", "c1", 1, "db", "Where is the lake?", "easy"), ("q2", "c2", 2, "db", "where is the lake", "easy"),
         ("q3", "c3", 3, "db", "Who owns it?", "hard"), ("q4", "c4", 4, "x", "How deep is it?", "extra")],
        "question_id string, id string, seq bigint, db_id string, question string, difficulty string",
    )
    answers = [("q1", "A1;", "h1"), ("q1", "A;", "h1"), ("q2", "B;", "h2"), ("q2", "B2;", "h2"),
               ("q3", "C;", "h3"), ("q3", "D;", "h4"), ("q4", "E;", "h5"), ("q4", "", "h5"), ("q4", "EE;", "h5")]
    candidates = spark.createDataFrame(
        [(q, i, s, None, 1, False, True, False, False, False, h) for i, (q, s, h) in enumerate(answers)],
        "question_id string, cand_ix int, sql string, error string, n_rows int, all_null boolean, "
        "deterministic boolean, ties boolean, limit_without_order boolean, ordered boolean, hash string",
    )
    tests = spark.createDataFrame([("t", "db", "zzz", "zzz", None)], TESTS)
    train = spark.createDataFrame(
        [("old", "db", "q", "s", "synthetic", "easy"), ("kept", "db", "q", "s", "spider", "easy")],
        "id string, db_id string, question string, sql string, source string, difficulty string",
    )
    out = flows.add_agreed_pairs(questions, candidates, tests, train, 5, ("db", "x"), "seed")
    got = {r["id"]: r["sql"] for r in out.train.collect()}
    assert got == {"kept": "s", "synth_db_0001": "A;", "synth_x_0001": "E;"}
    stats = {r["db_id"]: (r["questions"], r["agreed"], r["no_agreement"], r["kept"]) for r in out.stats.collect()}
    assert stats == {"db": (3, 2, 1, 1), "x": (1, 1, 0, 1)}
    assert {r["reason"]: r["n"] for r in out.drops.collect()} == {"duplicate_question": 1}
    assert out.review.count() == 2


def test_finalize_signs_every_set_once(spark, monkeypatch):
    """The leak check goes on with the sets and keys that the dedupe has made."""
    records = spark.createDataFrame(
        [(f"c{n}", n, "db", f"how many lakes lie in country {n}", f"SELECT {n};", "h", "agreed", "easy") for n in range(9)],
        RECORD,
    )
    tests = spark.createDataFrame([("t", "db", "Country 7: how many lakes lie in?", "SELECT x;", "g")], TESTS)
    calls, known = [], S.signed
    monkeypatch.setattr(S, "signed", lambda *a: calls.append(1) or known(*a))
    kept, drops = K.finalize(records, tests, 100)
    assert {r["id"] for r in kept.collect()} == {f"c{n}" for n in range(9)} - {"c7"}
    assert [(r["reason"], r["n"]) for r in drops.collect()] == [("test_leakage_text", 1)]
    assert len(calls) == 2  # the records and the tests


def test_finalize_looks_up_the_texts_of_marked_records(spark):
    """Rows of one id and order stay apart, as without marks; marks do not come out."""
    rows = [
        ("a", 1, "db", "First lake?", "SELECT 1;", "h", "agreed", "easy"),
        ("b", 2, "db", "Second river?", "SELECT 2;", "h", "agreed", "easy"),
        ("b", 2, "db", "Third hill?", "SELECT 3;", "h", "agreed", "easy"),
        ("c", 3, "db", "first lake", "SELECT 4;", "h", "agreed", "easy"),
        (None, 4, None, "Fourth town?", "SELECT 5;", "h", "agreed", "easy"),
    ]
    records = spark.createDataFrame(rows, RECORD)
    tests = spark.createDataFrame([("t", "db", "None?", "SELECT x;", "g")], TESTS)
    plain, _ = K.finalize(records, tests, 3)
    looked_up, _ = K.finalize(S.marked(records), tests, 3)
    assert set(looked_up.columns) == set(records.columns)
    assert sorted(plain.select(records.columns).collect(), key=str) == sorted(
        looked_up.select(records.columns).collect(), key=str
    )


def test_keys_of_agreed_pairs_carry_numbers(spark, monkeypatch):
    """What is joined by many keys names sets by 8 bytes; copies in another word order still meet."""
    from pairlake.operators import flows

    written, cut = [], S.cut

    def watched(df):
        written.append(dict(df.dtypes))
        return cut(df)

    monkeypatch.setattr(S, "cut", watched)
    texts = ["how deep is the lake", "is the lake how deep", "who owns the old mill", "the lake", None]
    questions = spark.createDataFrame(
        [(f"q{n}", f"c{n}", n, "db", q, "easy") for n, q in enumerate(texts)],
        "question_id string, id string, seq bigint, db_id string, question string, difficulty string",
    )
    candidates = spark.createDataFrame(
        [(f"q{n}", i, f"S{n};", None, 1, False, True, False, False, False, f"h{n}") for n in range(5) for i in range(2)],
        "question_id string, cand_ix int, sql string, error string, n_rows int, all_null boolean, "
        "deterministic boolean, ties boolean, limit_without_order boolean, ordered boolean, hash string",
    )
    tests = spark.createDataFrame([("t", "db", "Mill: the old who owns?", "zzz", None)], TESTS)
    train = spark.createDataFrame([], "id string, db_id string, question string, sql string, source string, difficulty string")
    stats = flows.add_agreed_pairs(questions, candidates, tests, train, 5, ("db",), "seed").stats.collect()
    assert [(r["questions"], r["agreed"], r["bad_item"], r["kept"]) for r in stats] == [(5, 4, 1, 2)]
    named = [t for t in written if "set_id" in t and ("sig" in t or "sigs" in t or "key" in t)]
    assert len(named) > 4 and {t["set_id"] for t in named} == {"bigint"}
    assert {t[c] for t in written for c in ("left_id", "right_id") if c in t} == {"bigint"}


def test_finalize_writes_tokens_once(spark, monkeypatch):
    """One table of tokens for the records and one for the tests; copies are left out by number."""
    written, cut = [], S.cut

    def watched(df):
        written.append(df.columns)
        return cut(df)

    monkeypatch.setattr(S, "cut", watched)
    rows = [(f"c{n}", n, "db", f"which hill of land {n // 2} is high", f"SELECT {n};", "h", "agreed", "easy") for n in range(12)]
    tests = spark.createDataFrame([("t", "db", "Land 4: is which hill of high?", "SELECT x;", "g")], TESTS)
    _, drops = K.finalize(spark.createDataFrame(rows, RECORD), tests, 3)
    assert {r["reason"]: r["n"] for r in drops.collect()} == {
        "duplicate_question": 6, "test_leakage_text": 1, "over_target": 2
    }
    assert sum("tokens" in columns for columns in written) == 2

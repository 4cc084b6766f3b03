import hashlib
import json

from pyspark.sql import functions as F

from pairlake.operators import catalog as C
from pairlake.operators import prompts as P
from pairlake.operators import repair
from pairlake.operators.merge import not_in, replace_source, upsert
from pairlake.sources import files


def test_declared_types_are_applied_where_every_value_fits(spark):
    """Each declared column by what its values allow; the others stay as they are."""
    columns = {
        "whole": (["7", "-3", "0"], "int", "cast"),
        "gaps": (["7", "", None], "int", "empty_as_null"),
        "words": (["7", "seven", "8"], "int", "kept"),
        "price": (["1.5", "2", "-0.25"], "double", "cast"),
    }
    rows = list(zip(*[values for values, _, _ in columns.values()], ["0012", "0034", "0056"]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*columns, "zip_code"]))
    fixed, notes = repair.retype(df, {c: kind for c, (_, kind, _) in columns.items()})
    assert notes == {c: note for c, (_, _, note) in columns.items()}
    kinds = dict(fixed.dtypes)
    assert kinds == {"whole": "int", "gaps": "int", "words": "string", "price": "double", "zip_code": "string"}
    assert sorted(r["whole"] for r in fixed.collect()) == [-3, 0, 7]
    assert [r["gaps"] for r in fixed.orderBy("zip_code").collect()] == [7, None, None]


def test_text_columns_of_numbers_become_numbers(spark):
    rows = [("0012", "31", "2.50"), ("0034", "-4", "7"), (None, None, None)]
    fixed, inferred = repair.numbers_from_text(spark.createDataFrame(rows, "zip_code string, stock string, price string"))
    assert inferred == {"stock": "bigint", "price": "double"}
    assert [r["zip_code"] for r in fixed.collect()] == ["0012", "0034", None]


def test_number_forms(spark):
    def inferred(*values):
        df = spark.createDataFrame([(v,) for v in values], "c string")
        return repair.numbers_from_text(df)[1].get("c")

    assert inferred("0", "-12", None) == "bigint"
    assert inferred("0", "1.50") == "double"
    assert inferred("007") is None
    assert inferred("+1") is None
    assert inferred("1 ") is None
    assert inferred("1", "1\n") is None
    assert inferred(None, None) is None
    assert inferred("9" * 19) is None


def test_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xff\xfec"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(repair.decode(F.col("b"))).collect()] == ["ab��c", "", None]


def test_loose_csv_tells_null_from_empty(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a",\n"",1\n"say ""x""","2"\n', encoding="utf-8")
    rows = files.read_loose_csv(spark, str(tmp_path / "t.csv"), ["x", "y"]).collect()
    assert [tuple(r) for r in rows] == [("a", None), ("", "1"), ('say "x"', "2")]


def test_table_names(spark):
    names = ["My Sales-2024.csv", "2024.parquet", "___.csv", "a.b.CSV", "ok", "été.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(repair.table_name(F.col("n"))).collect()]
    assert got == ["my_sales_2024", "t_2024", "t_data", "a_b", "ok", "t"]


def test_schema_text(spark):
    columns = [
        ("order", 1, "Order ID", "BIGINT", None),
        ("order", 2, "group", "VARCHAR", ["O'Neil & Co", "it's"]),
        ("order", 3, "3rd", "VARCHAR", []),
        ("order", 4, 'say "x"', "VARCHAR", None),
        ("order", 5, "Select_Count", "BIGINT", None),
        ("Beta", 1, "größe", "DECIMAL(10,2)", None),
        ("alpha", 1, "_p", "DATE", None),
    ]
    df = spark.createDataFrame(columns, "table string, ordinal int, column string, type string, examples array<string>")
    assert C.serialize(df.repartition(3)).first()["schema_text"].split("\n") == [
        "CREATE TABLE alpha (_p DATE);",
        'CREATE TABLE Beta ("größe" DECIMAL(10,2));',
        'CREATE TABLE "order" ("Order ID" BIGINT, "group" VARCHAR /* e.g. \'O\'\'Neil & Co\', \'it\'\'s\' */, '
        '"3rd" VARCHAR, "say ""x""" VARCHAR, Select_Count BIGINT, _private BIGINT);'.replace(", _private BIGINT", ""),
    ]


def test_example_values(spark):
    rows = [("b", "fine", f"v{i}") for i in range(24)] + [("a", "x" * 41, "v0")] * 3 + [("b", "no */ way", None)] * 5
    rows += [("c", "tab\there", "v1")] * 40 + [(None, "", "v2")] * 2
    alpha = spark.createDataFrame(rows, "kind string, note string, many string")
    zeta = spark.createDataFrame([(1,)], "a bigint")
    got = {r["column"]: r["examples"] for r in C.example_values(spark, {"Alpha": alpha, "zeta": zeta}).collect()}
    assert got == {"kind": ["c", "b"], "note": ["fine"]}
    lines = C.catalog(spark, {"zeta": zeta, "Alpha": alpha}).collect()
    assert [(r["table"], r["ordinal"], r["column"], r["type"]) for r in lines][-1] == ("zeta", 1, "a", "BIGINT")


def test_data_notes(spark):
    trips = spark.sql("SELECT * FROM VALUES (1988L, DATE'2011-05-06', 'x'), (1990L, NULL, NULL), (1979L, NULL, 'y') AS t(Year, left_on, who)")
    stops = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-02-03 04:05:06') AS t(n, seen)")
    plain = spark.sql("SELECT * FROM VALUES (1), (2) AS t(n)")
    assert C.data_notes(C.profile({"trips": trips, "stops": stops})).first()["notes"] == (
        "Row counts: stops 1, trips 3.\n"
        "Ranges: stops.seen 2024-02-03 to 2024-02-03; trips.Year 1979 to 1990; trips.left_on 2011-05-06 to 2011-05-06.\n"
        "NULLs: trips.left_on (2 of 3), trips.who (1 of 3)."
    )
    assert C.data_notes(C.profile({"plain": plain})).first()["notes"] == "Row counts: plain 2."


def test_pivot_takes_the_last_value(spark):
    obs = spark.createDataFrame(
        [("A", 1, "pop", 5.5, 1), ("A", 1, "pop", 2.5, 2), ("A", 1, "gdp", 1.239, 3), ("A", 2, "pop", None, 4),
         ("A", 3, "pop", 7.0, 5), ("A", 3, "pop", None, 6), ("A", 3, "gdp", 1.0, 7), ("X", 1, "pop", 1.0, 8)],
        "iso3 string, year int, indicator string, value double, seq int",
    )
    known = spark.createDataFrame([("A",)], "iso3 string")
    got = {r["year"]: (r["pop"], r["gdp"]) for r in repair.pivot_indicators(obs, known, {"pop": 0, "gdp": 2}).collect()}
    assert got == {1: (2, 1.24), 3: (None, 1.0)}


def test_manifest(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text(name)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pinned = spark.createDataFrame(
        [("a.txt", digest("a")), ("b.txt", digest("x")), ("c.txt", None), ("d.txt", digest("d"))], "file string, sha256 string"
    )
    got = {r["file"]: r["status"] for r in files.verify_manifest(files.file_digests(spark, str(tmp_path), "*.txt"), pinned).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "unpinned", "d.txt": "missing"}


def test_large_files_are_digested_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    monkeypatch.setattr(files, "PIECE", 1000)
    rnd = random.Random(1)
    contents = {"a b%20é.bin": rnd.randbytes(50_000), "sub/one": b"1", "sub/two": rnd.randbytes(999), "x,y": rnd.randbytes(1001)}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for whole in (0, 1000, 10**9):
        got = {r["file"]: (r["length"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path), whole=whole).collect()}
        assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}, whole


def test_prediction_logs_keep_the_last_line(spark, tmp_path):
    log = tmp_path / "tiny-0.5b-v2__torch-cpu__own_test.jsonl"
    lines = [{"id": "a", "sql": "1"}, {"id": "b", "sql": "2", "tokens_in": 4}, {"id": "a", "sql": "3", "latency_ms": 5}]
    log.write_text("\n".join(map(json.dumps, lines)) + "\n\n", encoding="utf-8")
    rows = sorted(files.read_predictions(spark, str(tmp_path)).collect(), key=lambda r: r["id"])
    assert [(r["id"], r["sql"], r["latency_ms"], r["tokens_in"]) for r in rows] == [("a", "3", 5.0, None), ("b", "2", None, 4)]
    assert (rows[0]["model"], rows[0]["runtime"], rows[0]["set"]) == ("tiny-0.5b-v2", "torch-cpu", "own_test")


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ('"q"\n', "x")], "id string, sql string")
    files.write_jsonl(df, f"{tmp_path}/out")
    back = files.read_jsonl(spark, f"{tmp_path}/out", "id string, sql string")
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_merges(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "synthetic"), ("c", None)], "id string, source string")
    fresh = spark.createDataFrame([("d", "synthetic")], "id string, source string")
    assert sorted(r["id"] for r in replace_source(train, fresh).collect()) == ["a", "c", "d"]
    report = spark.createDataFrame([("s", "m", 1), ("s", "n", 2)], "`set` string, model string, v int")
    new = spark.createDataFrame([("s", "n", 9), ("a", "m", 8)], "`set` string, model string, v int")
    assert [tuple(r) for r in upsert(report, new, ["set", "model"]).collect()] == [("a", "m", 8), ("s", "m", 1), ("s", "n", 9)]


def test_prompts(spark):
    df = spark.createDataFrame([("CREATE TABLE t (x BIGINT);", " \t Why? \n", "SELECT 1;")], "schema_text string, question string, sql string")
    row = P.training_example(df).first()
    assert [m["role"] for m in row["prompt"]] == ["system", "user"]
    assert row["prompt"][1]["content"] == "CREATE TABLE t (x BIGINT);\n\nQuestion: Why?"
    assert row["completion"][0]["content"] == "SELECT 1;"


def test_batches(spark):
    df = spark.createDataFrame([("g", i, f"q{i}") for i in range(9)], "g string, i int, question string")
    got = {r["batch"]: r["prompt"] for r in P.pack_batches(df, ["g"], "i", 4).collect()}
    assert got == {
        0: "1. q0\n2. q1\n3. q2\n4. q3", 1: "1. q4\n2. q5\n3. q6\n4. q7", 2: "1. q8",
    }


def test_recent_context_against_a_plain_loop(spark):
    import random

    rnd = random.Random(6)
    data = [(rnd.choice("ab"), rnd.randint(0, 9), i, f"q{i}") for i in range(200)]
    df = spark.createDataFrame(data, "g string, round int, i int, question string")
    for keep in (1, 3, 30):
        got = {(r["g"], r["round"]): r["previous"] for r in P.recent_context(df, ["g"], "round", "i", keep).collect()}
        for (g, rnd_no), previous in got.items():
            earlier = sorted((r, i, q) for h, r, i, q in data if h == g and r < rnd_no)
            assert previous == [q for _, _, q in earlier][-keep:]
        assert set(got) == {(g, r) for g, r, _, _ in data}


def test_replies(spark):
    replies = [
        ("plain", '{"answers": [{"n": 2, "sql": "B;"}, {"n": 1, "sql": "A;"}]}'),
        ("wrapped", 'Sure!\n```json\n{"answers": [{"n": 1, "sql": "A; {x}"}]}\n```'),
        ("bad_entries", '{"answers": [{"n": 7, "sql": "Z;"}, {"n": "x", "sql": "Y;"}, {"n": 2}, {"sql": "W;"}]}'),
        ("twice", '{"answers": [{"n": 1, "sql": "A;"}, {"n": 1, "sql": "B;"}]}'),
        ("mistyped", '{"answers": [{"n": "1", "sql": "A;"}, {"n": 2, "sql": 5}, "x", 7]}'),
        ("list", '[{"answers": [{"n": 1, "sql": "A;"}]}]'),
        ("broken", "no json here"),
        ("other", '{"items": []}'),
    ]
    df = spark.createDataFrame([(k, 2, v) for k, v in replies], "batch_id string, n int, reply string")
    got = {}
    for r in P.align_answers(df).collect():
        got.setdefault(r["batch_id"], {})[r["n"]] = r["sql"]
    assert got == {
        "plain": {1: "A;", 2: "B;"}, "wrapped": {1: "A; {x}", 2: ""}, "bad_entries": {1: "", 2: ""},
        "twice": {1: "B;", 2: ""}, "mistyped": {1: "", 2: ""}, "list": {1: "A;", 2: ""}, "broken": {1: "", 2: ""}, "other": {1: "", 2: ""},
    }


def test_pending(spark):
    digest = P.request_digest({"b": F.col("q"), "a": F.lit(1)})
    asked = spark.createDataFrame([("x",), ("é",)], "q string").withColumn("digest", digest)
    want = hashlib.sha256('{"a":1,"b":"é"}'.encode()).hexdigest()
    assert asked.filter("q = 'é'").first()["digest"] == want
    done = asked.filter("q = 'x'").select("digest")
    assert [r["q"] for r in P.pending(asked, done).collect()] == ["é"]


def test_not_in_follows_sql(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for listed in ([], [(2,), (2,)], [(2,), (None,)]):
        other = spark.createDataFrame(listed, "v int")
        df.createOrReplaceTempView("not_in_left")
        other.createOrReplaceTempView("not_in_right")
        want = spark.sql("SELECT k FROM not_in_left WHERE k NOT IN (SELECT v FROM not_in_right)")
        got = not_in(df, "k", other, "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_lines_go_to_the_file_of_a_language(spark, monkeypatch):
    """The texts behind the digests are not moved with them."""
    from pyspark.sql.classic.dataframe import DataFrame

    from pairlake.plans import QUERIES, Tables

    moved, repartition = [], DataFrame.repartition

    def noted(df, *args):
        moved.append(set(df.columns))
        return repartition(df, *args)

    monkeypatch.setattr(DataFrame, "repartition", noted)
    t = Tables(spark, "/root/testdata/sf0.001")
    found = {r["lang"]: r["length"] for r in QUERIES["s7_text_digests"](t).collect()}
    want = {}
    for r in t.documents.select("lang", "doc_id").collect():
        want[r["lang"]] = want.get(r["lang"], 0) + 64 + 1 + len(str(r["doc_id"])) + 1
    assert found == want
    assert moved and not any("text" in columns for columns in moved)

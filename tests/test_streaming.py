import json
import random

from pyspark.sql import functions as F

from pairlake.sources import files
from pairlake.streaming import ingest, keyed


def write(path, rows):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")


def test_ingest_is_resumable(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("log", "sink", "progress"))
    write(tmp_path / "log" / "a.json", [{"id": "x", "sql": "1"}, {"id": "y", "sql": "2"}, {"id": "x", "sql": "3"}])
    ingest.ingest_predictions(spark, source, sink, progress).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    write(tmp_path / "log" / "b.json", [{"id": "y", "sql": "9"}, {"id": "z", "sql": "4"}])
    for _ in range(2):
        ingest.ingest_predictions(spark, source, sink, progress).awaitTermination()
    got = {r["id"]: r["sql"] for r in spark.read.parquet(sink).collect()}
    assert set(got) == {"x", "y", "z"} and got["y"] == "2"


def test_the_last_line_of_an_id_is_kept(spark, tmp_path, monkeypatch):
    """A log resumed in many runs gives what the batch reader reads; with compactions."""
    monkeypatch.setattr(keyed, "COMPACT_EVERY", 3)
    source, sink, progress = (str(tmp_path / n) for n in ("log", "sink", "progress"))
    rnd = random.Random(4)
    assert ingest.latest_predictions(spark, sink) is None
    for run in range(6):
        for model in ("m1", "m2")[: 1 + run % 2]:
            rows = [{"id": f"i{rnd.randrange(8)}", "sql": f"{run}.{n}", "tokens_out": n if n % 3 else None} for n in range(6)]
            write(tmp_path / "log" / f"{model}__app__s{run // 3}.jsonl" / f"part-{run}.json", rows)
        ingest.ingest_latest(spark, source, sink, progress).awaitTermination()
        kept = sorted(map(str, ingest.latest_predictions(spark, sink).collect()))
        assert kept == sorted(map(str, files.read_predictions(spark, source).collect())) and kept
    names = sorted(p.name for p in (tmp_path / "sink").iterdir())
    assert names == ["base=5"]
    # A batch that is repeated after it was merged changes nothing.
    table = keyed.KeyedTable(spark, sink, ingest.LOG_KEYS, files.LOG_ORDER)
    table.add(spark.read.parquet(f"{sink}/base=5").withColumn("sql", F.lit("changed")).drop("_batch"), 4)
    assert sorted(map(str, ingest.latest_predictions(spark, sink).collect())) == kept


def test_arriving_pairs_are_checked(spark, tmp_path):
    tests = spark.createDataFrame([("t", "db", "How many lakes?", "S;")], "id string, db_id string, question string, gold_sql string")
    source, accepted, report, progress = (str(tmp_path / n) for n in ("in", "ok", "report", "progress"))
    schema = "id string, db_id string, question string, sql string"
    first = [{"id": "a", "db_id": "db", "question": "how many lakes", "sql": "1"}, {"id": "b", "db_id": "x", "question": "how many lakes", "sql": "1"}]
    second = [{"id": "c", "db_id": "db", "question": "another", "sql": "2"}]
    for name, rows in (("1.json", first), ("2.json", second)):
        write(tmp_path / "in" / name, rows)
        ingest.filter_new_pairs(spark, source, tests, accepted, report, progress, schema).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(accepted).collect()) == ["b", "c"]
    latest = {r["db_id"]: (r["pairs"], r["leaks"]) for r in ingest.latest_report(spark, report).collect()}
    assert latest == {"db": (1, 0), "x": (1, 0)}


def test_scoped_tables_are_deleted(spark):
    import os

    from pairlake.session import cut, scratch_root, scratch_scope

    outside = cut(spark.range(3))
    with scratch_scope(spark):
        folder = scratch_root(spark)
        assert cut(spark.range(5)).count() == 5
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    assert outside.count() == 3


def test_scopes_of_threads_do_not_meet(spark):
    """Two jobs side by side: the one that ends first deletes only its own tables."""
    import threading

    from pairlake.session import cut, scratch_scope

    opened, ended, found = threading.Event(), threading.Event(), []

    def long_job():
        with scratch_scope(spark):
            table = cut(spark.range(7))
            opened.set()
            ended.wait(120)
            found.append(table.count())

    job = threading.Thread(target=long_job)
    job.start()
    opened.wait(120)
    with scratch_scope(spark):
        with scratch_scope(spark):
            inner = cut(spark.range(2))
            assert inner.count() == 2
        assert cut(spark.range(4)).count() == 4
    ended.set()
    job.join()
    assert found == [7]

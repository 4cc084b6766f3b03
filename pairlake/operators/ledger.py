"""What SQL texts give on one state of the data, remembered: every text runs once.

The ledger is a folder of Parquet tables keyed by (data version, SHA-256 of the text):
``runs`` (error, number of columns), the canonical rows of each text, and ``checks`` (what
changes with the stored order or with ties, and the result's hash). Texts already in it are
not run again, neither in one batch nor in a later one; a text that ran out of time is told
as failed, but not remembered. Only distinct unseen texts come to the driver, from where each
is started as a Spark job; results stay in the folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.functions.sqltext import has_order_by, tie_broken, unordered_limit
from pairlake.operators.results import emptiness, result_hash, results_match, reversed_copy
from pairlake.operators.runner import (
    TIMEOUT_S,
    dense,
    digest_of,
    read_rows,
    reading_session,
    run_texts,
)
from pairlake.session import cut, exists, scratch

RUNS = "digest string, error string, n_cols int"
CHECKS = (
    "digest string, error string, ordered boolean, limit_without_order boolean, n_rows bigint, "
    "all_null boolean, deterministic boolean, ties boolean, result_hash string"
)


def digest(sql: str) -> F.Column:
    return F.sha2(F.col(sql), 256)


class Ledger:
    """Runs and checks of texts over ``tables``, views of the session or (``views``) folders.

    ``folder`` keeps the ledger between calls; without it a fresh one is begun. ``version``
    names the state of the tables: the same name is taken for the same data.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Sequence[str],
        views: Mapping[str, str] | None = None,
        folder: str | None = None,
        version: str = "0",
        timeout: float = TIMEOUT_S,
        parallel: int = 4,
    ):
        self.spark, self.tables, self.views = spark, list(tables), dict(views or {})
        self.folder = f"{folder or scratch(spark, 'ledger')}/{digest_of(version)}"
        self.timeout, self.parallel = timeout, parallel
        self._backwards: dict[str, str] = {}

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        # Two batches at once may have run a text both; either line will do.
        return self.spark.read.schema(schema).parquet(path).dropDuplicates(["digest"])

    def _start(self, texts: Mapping[str, str], folder: str, views: Mapping[str, str]):
        return run_texts(self.spark, texts, folder, self.timeout, self.parallel, views)

    def run(self, texts: DataFrame) -> DataFrame:
        """(digest, error, n_cols) of the distinct texts in column ``sql``; null and empty
        ones are left out."""
        wanted = cut(
            texts.filter(F.coalesce("sql", F.lit("")) != "").select("sql").distinct().withColumn("digest", digest("sql"))
        )
        unseen = wanted.join(self._table("runs", RUNS), "digest", "left_anti").collect()
        ends = self._start({r["digest"]: r["sql"] for r in unseen}, f"{self.folder}/rows", self.views)
        lines = [(d, e.error, e.n_cols, e.late) for d, e in ends.items()]
        fresh = self.spark.createDataFrame(lines, f"{RUNS}, late boolean")
        kept = [x[:3] for x in lines if not x[3]]
        if kept:
            self.spark.createDataFrame(kept, RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        known = self._table("runs", RUNS).unionByName(fresh.filter("late").drop("late"))
        return cut(wanted.select("digest").join(known, "digest"))

    def rows(self, digests: DataFrame) -> DataFrame:
        """(digest, row_ix, cells) of the texts in ``digests`` that ended without an error."""
        sound = self._table("runs", RUNS).filter(F.col("error").isNull()).select("digest")
        asked = cut(digests.select("digest").distinct().join(sound, "digest"))
        return read_rows(self.spark, f"{self.folder}/rows").join(asked, "digest")

    def _reversed(self) -> Mapping[str, str]:
        if not self._backwards:
            reader = reading_session(self.spark)
            for name in self.tables:
                stored = reader.read.parquet(self.views[name]) if name in self.views else reader.table(name)
                path = scratch(self.spark, "backwards")
                reversed_copy(stored).write.parquet(path)
                self._backwards[name] = path
        return self._backwards

    def check(self, texts: DataFrame) -> DataFrame:
        """``CHECKS`` of the distinct texts in column ``sql``.

        Every text also runs over copies of the tables in reverse order, which tells whether
        it is ``deterministic``; one with an outermost ORDER BY runs twice more, with all its
        columns appended to it ascending and descending, which tells whether ``ties`` decide
        its result. Whether order counts is read from the text itself.
        """
        ends = self.run(texts)
        named = texts.filter(F.coalesce("sql", F.lit("")) != "").select("sql").distinct()
        named = named.select(
            "sql",
            digest("sql").alias("digest"),
            has_order_by(F.col("sql")).alias("ordered"),
            unordered_limit(F.col("sql")).alias("limit_without_order"),
        )
        open_ = (
            named.join(ends.filter(F.col("error").isNull()), "digest")
            .join(self._table("checks", CHECKS), "digest", "left_anti")
            .collect()
        )
        if open_:
            fresh = cut(self._check(open_))
            fresh.coalesce(1).write.mode("append").parquet(f"{self.folder}/checks")
        failed = named.join(ends.filter(F.col("error").isNotNull()), "digest").select(
            "digest", "error", "ordered", "limit_without_order"
        )
        known = self._table("checks", CHECKS).join(ends.select("digest"), "digest")
        return known.unionByName(failed, allowMissingColumns=True)

    def _check(self, texts: Sequence) -> DataFrame:
        spark = self.spark
        behind, broken = scratch(spark, "behind"), scratch(spark, "broken")
        back = self._start({r["digest"]: r["sql"] for r in texts}, behind, self._reversed())
        ties = {
            (r["digest"], down): sql
            for r in texts
            if r["ordered"]
            for down in (False, True)
            if (sql := tie_broken(r["sql"], r["n_cols"], down))
        }
        tied = self._start({digest_of(s): s for s in ties.values()}, broken, self.views)
        errors = {r["digest"]: back[r["digest"]].error for r in texts}
        for (d, _), sql in ties.items():
            errors[d] = errors[d] or tied[digest_of(sql)].error
        # The lists of texts are written, so that Spark knows them to be small: rows stay in
        # place where they meet them.
        asked = cut(spark.createDataFrame(
            [(r["digest"], errors[r["digest"]], r["ordered"], r["limit_without_order"]) for r in texts],
            "digest string, error string, ordered boolean, limit_without_order boolean",
        ))
        own = read_rows(spark, f"{self.folder}/rows").join(asked.select("digest"), "digest")
        again = read_rows(spark, behind)
        # The two orders of a text are the sides of one comparison; its name is the text's.
        sides = cut(spark.createDataFrame(
            [(digest_of(s), d, "b" if down else "a") for (d, down), s in ties.items()],
            "digest string, owner string, side string",
        ))
        both = read_rows(spark, broken).join(sides, "digest")

        def lines(rows: DataFrame, name, side) -> DataFrame:
            return rows.select(name.alias("query_id"), side.alias("side"), "row_ix", "cells")

        plain = F.concat(F.lit("d"), F.col("digest"))
        everything = (
            lines(own, plain, F.lit("a"))
            .unionByName(lines(again, plain, F.lit("b")))
            .unionByName(lines(both, F.concat(F.lit("t"), F.col("owner")), F.col("side")))
        )
        queries = asked.select(plain.alias("query_id"), "ordered").unionByName(
            sides.select(F.concat(F.lit("t"), F.col("owner")).alias("query_id"), F.lit(True).alias("ordered")).distinct()
        )
        queries = cut(queries)
        numbered = cut(dense(everything, queries))
        same = results_match(numbered, queries)
        forward = numbered.filter((F.col("side") == "a") & F.col("query_id").startswith("d"))
        plainly = queries.filter(F.col("query_id").startswith("d"))
        facts = (
            plainly.join(emptiness(forward, plainly), "query_id")
            .join(result_hash(forward, plainly).select("query_id", "result_hash"), "query_id", "left")
            .join(same.select("query_id", F.col("matched").alias("deterministic")), "query_id")
            .withColumn("digest", F.substring("query_id", 2, 64))
            .drop("query_id", "ordered")
        )
        decided = same.filter(F.col("query_id").startswith("t")).select(
            F.substring("query_id", 2, 64).alias("digest"), (~F.col("matched")).alias("ties")
        )
        return (
            asked.join(facts, "digest")
            .join(decided, "digest", "left")
            .withColumn("ties", F.coalesce("ties", F.lit(False)))
            .select(*[c.split()[0] for c in CHECKS.split(", ")])
        )

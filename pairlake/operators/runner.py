"""Run a table of SQL queries on a database's views and collect their results."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlake.functions.cells import CELL, row_cells
from pairlake.session import cut, exists, scratch

TIMEOUT_S = 10.0
ROWS = f"digest string, row_ix bigint, cells array<{CELL}>"
ERRORS = "query_id string, side string, error string"


@dataclass(frozen=True)
class Query:
    query_id: str
    sql: str
    side: str = "a"
    ordered: bool = False


# Built-in functions that reach beyond the tables.
_OUTSIDE = frozenset(("from_protobuf", "java_method", "reflect", "to_protobuf", "try_reflect"))
# What a parsed query may consist of. Commands, inserts, scripts and names
# made at run time are not among them, and neither is what a later version may add.
_QUERY_NODES = frozenset((
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot",
    "Project", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "WithWindowDefinition",
))
_CATALYST = "org.apache.spark.sql.catalyst"


class NotAQuery(Exception):
    pass


_ALLOWED: dict[str, frozenset[str]] = {}


def allowed_functions(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions, without those that reach beyond the tables."""
    app = spark.sparkContext.applicationId
    if app not in _ALLOWED:
        names = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
        _ALLOWED[app] = frozenset((names | {"range"}) - _OUTSIDE)
    return _ALLOWED[app]


def reading_session(spark: SparkSession) -> SparkSession:
    """A copy of the session: the same views, settings of its own, no reading of paths.

    What model output does to its settings or views ends with the copy.
    """
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.runSQLOnFiles", "false")
    return copy


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_reads_only(spark: SparkSession, sql: str) -> None:
    """Raises unless the text is one query that only reads.

    The parsed text is walked through, with its subqueries, named queries and windows: every
    node has to be one that queries consist of, and every function one of Spark's own that
    stays inside the tables. Comments, quotes and case make no difference to it.
    """
    jvm = spark.sparkContext._jvm
    is_plan, is_query, is_call, is_generator = (
        jvm.java.lang.Class.forName(f"{_CATALYST}.{name}").isInstance
        for name in (
            "plans.logical.LogicalPlan",
            "expressions.PlanExpression",
            "analysis.UnresolvedFunction",
            "analysis.UnresolvedGenerator",
        )
    )
    allowed = allowed_functions(spark)

    def refuse() -> None:
        raise NotAQuery("not a query")

    def call(parts: list[str]) -> None:
        own = len(parts) == 1 or [p.lower() for p in parts[:-1]] in (["builtin"], ["system", "builtin"])
        if not own or parts[-1].lower() not in allowed:
            refuse()

    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += _listed(node.children())
        if is_plan(node):
            if name not in _QUERY_NODES:
                refuse()
            if name == "UnresolvedTableValuedFunction":
                call(_listed(node.name()))
            if name == "WithWindowDefinition":
                todo += _listed(node.windowDefinitions().values().toSeq())
            if name == "UnresolvedWith":
                todo += [pair._2() for pair in _listed(node.cteRelations())]
            todo += _listed(node.expressions())
        elif is_query(node):
            todo.append(node.plan())
        elif is_call(node):
            call(_listed(node.nameParts()))
        elif is_generator(node):
            call([node.name().funcName()])
        elif "UnresolvedIdentifier" in name:
            refuse()


class Outcome(NamedTuple):
    """How a text ended: an error, or the number of its columns."""

    error: str | None
    n_cols: int | None = None
    late: bool = False


def digest_of(sql: str) -> str:
    return hashlib.sha256(sql.encode()).hexdigest()


def _run(spark: SparkSession, digest: str, sql: str, path: str, timeout: float) -> Outcome:
    """Write one result as canonical rows."""
    sc = spark.sparkContext
    group = f"pairlake-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    timer.start()
    try:
        sc.setJobGroup(group, digest, interruptOnCancel=True)
        sql = sql.strip().rstrip(";")
        check_reads_only(spark, sql)
        df = spark.sql(sql)
        if late.is_set():  # analysis cannot be cancelled; its time counts all the same
            raise TimeoutError
        df.select(
            F.lit(digest).alias("digest"),
            F.monotonically_increasing_id().alias("row_ix"),
            row_cells(df).alias("cells"),
        ).write.mode("overwrite").parquet(path)
        return Outcome(None, len(df.columns))
    except NotAQuery as e:
        return Outcome(str(e))
    except Exception as e:  # any failure of one query is that query's result
        if late.is_set():
            return Outcome(f"The query took longer than {timeout:g} s and was stopped.", late=True)
        kind = type(e).__name__ if isinstance(e, PySparkException) else "Error"
        return Outcome(f"{kind}: {str(e).splitlines()[0] if str(e) else ''}")
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def run_texts(
    spark: SparkSession,
    texts: Mapping[str, str],
    folder: str,
    timeout: float = TIMEOUT_S,
    parallel: int = 4,
    views: Mapping[str, str] | None = None,
) -> dict[str, Outcome]:
    """Run each text of ``texts`` (digest → SQL) once, as a Spark job with its own time limit
    that writes (digest, row_ix, cells) to ``folder/digest``; nothing is collected.

    ``views`` names Parquet folders that stand in for the session's views.
    """
    reader = reading_session(spark)
    for name, stand_in in (views or {}).items():
        reader.read.parquet(stand_in).createOrReplaceTempView(name)
    with ThreadPoolExecutor(parallel) as pool:
        ends = pool.map(lambda d: _run(reader, d, texts[d], f"{folder}/{d}", timeout), texts)
        return dict(zip(texts, ends, strict=True))


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, row_ix, cells) of all texts that wrote into ``folder``."""
    if not exists(spark, folder):
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(folder)


def dense(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """``lines`` of a results table, with rows numbered 0, 1, 2, … where ``asked`` (query_id,
    ordered) says that order counts.

    ``row_ix`` is as ``run_texts`` writes it: the task above bit 33, and below it 0, 1, 2, …
    inside the task. So rows are not sorted again; what a task needs is how many rows the
    tasks before it wrote.
    """
    told = lines.join(asked.select("query_id", "ordered"), "query_id")
    task = F.shiftright("row_ix", 33)
    place = ["query_id", "side", "_task"]
    sizes = told.filter("ordered").groupBy("query_id", "side", task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("query_id", "side").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select(*place, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    ordered = told.filter("ordered").withColumn("_task", task).join(starts, place)
    numbered = ordered.withColumn("row_ix", F.col("_start") + F.col("row_ix").bitwiseAND(F.lit((1 << 33) - 1)))
    return (
        told.filter(~F.col("ordered"))
        .select(*lines.columns)
        .unionByName(numbered.select(*lines.columns))
    )


def run_batch(
    spark: SparkSession,
    queries: Sequence[Query],
    timeout: float = TIMEOUT_S,
    parallel: int = 4,
    views: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results table, errors table) of the queries, each with its own time limit.

    Equal texts run once, whatever their ids. Rows of ordered queries are numbered 0, 1, 2, …
    in result order. Queries only read: commands, scripts, inserts, reads of paths and calls
    that leave the tables give an error row and change nothing. ``views`` as in ``run_texts``.
    """
    folder = scratch(spark, "results")
    texts = {digest_of(q.sql): q.sql for q in queries}
    ends = run_texts(spark, texts, folder, timeout, parallel, views)
    told = [(q.query_id, q.side, q.ordered, digest_of(q.sql)) for q in queries]
    failed = [(i, side, ends[d].error) for i, side, _, d in told if ends[d].error is not None]
    asked = cut(spark.createDataFrame(
        [t for t in told if ends[t[3]].error is None],
        "query_id string, side string, ordered boolean, digest string",
    ))
    # A failed text may have left rows behind; they meet no query.
    lines = read_rows(spark, folder).join(asked, "digest").select("query_id", "side", "row_ix", "cells")
    orders = cut(asked.groupBy("query_id").agg(F.max("ordered").alias("ordered")))
    return dense(lines, orders), spark.createDataFrame(failed, ERRORS)

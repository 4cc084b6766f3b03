"""Prompts, batches and replies: what goes to a model and what comes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.text import strip
from pairlake.operators.positions import with_positions

# Fixed value: the system message of every prompt.
SYSTEM_PROMPT = "Write one DuckDB SQL query that answers the question. Output only SQL."
# Questions per call, earlier questions shown.
BATCH = 20
AVOID = 30


def user_prompt(schema_text: Column, question: Column) -> Column:
    return F.concat(schema_text, F.lit("\n\nQuestion: "), strip(question, " \t\n\r"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(schema_text: Column, question: Column) -> Column:
    return F.array(
        _message("system", F.lit(SYSTEM_PROMPT)),
        _message("user", user_prompt(schema_text, question)),
    )


def training_example(pairs: DataFrame) -> DataFrame:
    """``prompt`` and ``completion`` messages for each pair."""
    return pairs.withColumn("prompt", chat(F.col("schema_text"), F.col("question"))).withColumn(
        "completion", F.array(_message("assistant", F.col("sql")))
    )


def fit_length(pairs: DataFrame, length: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(pairs within the budget, ids of the pairs over it)."""
    return pairs.filter(length <= limit), pairs.filter(length > limit).select("id")


def pack_batches(
    questions: DataFrame, groups: Sequence[str], order: str, size: int = BATCH
) -> DataFrame:
    """Numbered lists of up to ``size`` questions → ``…groups, batch, n, prompt``."""
    placed = with_positions(questions, groups, [order], "_pos")
    batch = F.floor((F.col("_pos") - 1) / size).cast("bigint")
    number = (F.pmod(F.col("_pos") - 1, F.lit(size)) + 1).cast("int")
    line = F.concat(number.cast("string"), F.lit(". "), F.col("question"))
    items = F.array_sort(F.collect_list(F.struct(number.alias("i"), line.alias("line"))))
    return placed.groupBy(*groups, batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(items, lambda i: i["line"]), "\n").alias("prompt"),
    )


def recent_context(
    questions: DataFrame,
    groups: Sequence[str],
    batch: str,
    order: str,
    keep: int = AVOID,
) -> DataFrame:
    """For each (group, batch): the last ``keep`` questions of earlier batches, in order.

    Questions are numbered inside their group and cut into blocks of ``keep``; a batch
    looks into at most two blocks, so no task ever holds a whole group.
    """
    placed = with_positions(questions, groups, [batch, order], "_pos")
    starts = placed.groupBy(*groups, batch).agg(F.min("_pos").alias("_start"))
    block = F.floor((F.col("_pos") - 1) / keep)
    wanted = starts.withColumn(
        "_block",
        F.explode(
            F.array_distinct(
                F.array(
                    F.floor((F.col("_start") - 1 - keep) / keep),
                    F.floor((F.col("_start") - 2) / keep),
                )
            )
        ),
    )
    earlier = placed.select(*groups, block.alias("_block"), F.col("_pos"), "question")
    near = (F.col("_pos") < F.col("_start")) & (F.col("_pos") >= F.col("_start") - keep)
    found = wanted.join(earlier, [*groups, "_block"]).filter(near)
    lists = found.groupBy(*groups, batch).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "question"))), lambda q: q["question"]
        ).alias("previous")
    )
    return starts.drop("_start").join(lists, [*groups, batch], "left").withColumn(
        "previous", F.coalesce("previous", F.array().cast("array<string>"))
    )


def json_object(text: Column) -> Column:
    """A JSON object, taken from the outermost braces when the whole text is not one."""
    whole = F.try_parse_json(text)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole).otherwise(
        F.try_parse_json(F.when(braces != "", braces))
    )


def align_answers(batches: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies ``{"answers": [{"n", "sql"}]}`` → one line per question, ``''`` when absent.

    ``batches``: a key ``batch_id``, ``n`` questions and the reply text. Entries count only
    with a whole number from 1 to n and SQL text; the last one for a number wins.
    """
    answers = F.try_variant_get(json_object(F.col(reply)), "$.answers", "array<variant>")
    asked = batches.select(
        "batch_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("n")
    )

    def field(name: str, kind: str, dtype: str) -> Column:
        value = F.try_variant_get("_a", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == kind, F.try_variant_get("_a", f"$.{name}", dtype))

    given = (
        batches.select("batch_id", F.posexplode(answers).alias("_i", "_a"))
        .select(
            "batch_id", "_i", field("n", "BIGINT", "int").alias("n"), field("sql", "STRING", "string").alias("sql")
        )
        .filter(F.col("n").isNotNull() & F.col("sql").isNotNull())
        .groupBy("batch_id", "n")
        .agg(F.max_by("sql", "_i").alias("sql"))
    )
    return asked.join(given, ["batch_id", "n"], "left").withColumn(
        "sql", F.coalesce("sql", F.lit(""))
    )


def request_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a request as JSON with sorted keys."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered), 256)


def pending(requests: DataFrame, done: DataFrame, key: str = "digest") -> DataFrame:
    """Requests that have no answer yet."""
    return requests.join(done.select(key), key, "left_anti")

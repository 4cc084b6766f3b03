"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled rows (``SAMPLE_ROWS``, by a hash of the id; one row per id) is
   split by hash into a fitting and a calibrating part.
2. A lexicon is learned on the fitting part: words and word beginnings that stand out in
   toxic documents, so that inflected and compounded forms count too.
3. Every document becomes one short vector: lexicon densities, lexicon words near a second
   person, capitals, punctuation, and how much of it is obfuscated. Spaced letters are found
   in every text as a whole, and those of one run are looked up as one word.
4. Trees are fitted on the vectors; isotonic regression on the calibrating part turns their
   margins into probabilities.

Only the text is an input of a score. Defined cases: null and empty texts have the vector of
an empty text and are scored like all others; labels without a document, with a null id or
a null label are ignored, the largest label of an id counts, and of its rows the text with
the smallest digest is learned from; with one class or no label the
score is the rate of toxic labels (0 if there are none); an empty table gives an empty
result; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairlake.llm.digests import digest
from pairlake.session import cut

SAMPLE_ROWS = 20_000  # labelled rows used at most
LEXICON_TERMS = 4_000  # terms kept at most
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that may be terms
KNOWN_WORDS = 150_000  # words a worker remembers before it starts afresh
NEAR = 4  # words between a lexicon word and a second person

# Pronouns of the second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine "
    "euch ihr usted ustedes tú vosotros vuestro".split()
)
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_STRIP = ".,;:?\"'()[]{}<>*_-`~"
# Words of one letter, which may stand before a run of spaced letters.
ONE_LETTER = frozenset("aeiouyà")
# Possessive, with a look ahead in place of going back: a run of any length takes no memory.
_SPACED = re.compile(r"\b(?:\w[ .*_-](?=\w(?![^\W_]))){3,}+\w")


def _plain(word: str) -> str:
    return word.strip(_STRIP).rstrip("!")


def _open(word: str) -> str:
    """The word behind an obfuscated spelling: look-alikes read as letters, signs dropped."""
    return "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())


def terms_of(word: str) -> list[str]:
    """A word itself, and its beginnings (written with a trailing asterisk)."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Term → log odds, from (text, label); at most ``LEXICON_TERMS`` reach the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                words = {_plain(w) for w in (text or "").lower().split()}
                seen[int(label > 0)].update({t for w in words if w for t in terms_of(w)})
        for label, counts in seen.items():
            if counts:
                yield pd.DataFrame(
                    {"term": list(counts), "toxic": label, "n": list(counts.values())}
                )

    sizes = rows.groupBy((F.col("label") > 0).alias("t")).agg(F.count("*").alias("n")).collect()
    totals = {bool(r["t"]): r["n"] for r in sizes}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    counted = (
        rows.select("text", "label")
        .mapInPandas(count, "term string, toxic int, n long")
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
        )
        .filter(F.col("a") >= max(4, pos // 400))
        .withColumn("odds", (F.col("a") + 0.5) / (pos + 1.0) / ((F.col("b") + 0.5) / (neg + 1.0)))
        .filter(F.col("odds") >= 6)
        .orderBy(F.desc(F.col("a") * F.log("odds")), "term")
        .limit(LEXICON_TERMS)
    )
    return {r["term"]: log(r["odds"]) for r in counted.collect()}


FEATURES = (
    "hits", "density", "weight", "strongest", "stem_density", "near_you", "second_person",
    "capitals", "shouted", "exclaims", "punctuation", "digits", "obfuscated", "opened", "words",
)


class Features:
    """The feature vector of a text. Words are looked up once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def weights(self, plain: str) -> tuple[float, float]:
        """(weight of the word, of its best beginning)."""
        stems = [self.lexicon.get(f"{plain[:n]}*", 0.0) for n in STEMS if len(plain) >= n]
        return self.lexicon.get(plain, 0.0), max(stems or [0.0])

    def look_up(self, word: str) -> tuple[float, float, bool, bool]:
        """(weight of the word, of its best beginning, obfuscated, found by opening)."""
        plain = _plain(word)
        exact, stem = self.weights(plain)
        odd = any(c.isalpha() for c in plain) and any(not c.isalpha() and c not in "'’-" for c in plain)
        opened = False
        if odd and not exact and not stem:
            exact, stem = self.weights(_open(plain))
            opened = bool(exact or stem)
        return exact, stem, odd, opened

    def spaced(self, text: str) -> tuple[int, list[tuple[int, float, float]]]:
        """(runs of spaced letters, (place among the words, weights) of those in the lexicon).

        Runs without a blank are parts of one word, which ``look_up`` opens.
        """
        runs, found, at, before = 0, [], 0, 0
        for run in _SPACED.finditer(text):
            runs += 1
            if " " not in run[0]:
                continue
            letters = _open(run[0].lower())
            exact, stem = self.weights(letters)
            if not exact and not stem and letters[:1] in ONE_LETTER:
                exact, stem = self.weights(letters[1:])
            if exact or stem:
                start = run.start()
                inside = start > at > 0 and not text[at - 1].isspace() and not text[at].isspace()
                before += len(text[at:start].split()) - inside
                at = start
                begun = start > 0 and not text[start - 1].isspace()
                found.append((before - begun, exact, stem))
        return runs, found

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.lower().split()
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        special, you = [], []
        for w in set(words).difference(known):
            found = self.look_up(w)
            person = _plain(w) in SECOND_PERSON
            known[w] = (found, person) if any(found) or person else None
        weight = strongest = 0.0
        exact = stems = odd = opened = 0
        for at, hit in enumerate(map(known.__getitem__, words)):
            if hit is None:
                continue
            (x, s, o, op), person = hit
            best = max(x, s)
            if best:
                special.append(at)
                weight += best
                strongest = max(strongest, best)
                exact += x > 0
                stems += s > 0
            odd += o
            opened += op
            if person:
                you.append(at)
        runs, hidden = self.spaced(text)
        for at, x, s in hidden:
            special.append(at)
            weight += max(x, s)
            strongest = max(strongest, x, s)
            exact += x > 0
            stems += s > 0
            opened += 1
        near = 0
        if special and you:
            a, b = np.array(special), np.array(you)
            right = np.searchsorted(b, a)
            gap = np.minimum(
                np.abs(b[np.minimum(right, len(b) - 1)] - a), np.abs(a - b[np.maximum(right - 1, 0)])
            )
            near = int((gap <= NEAR + 1).sum())
        raw = text.encode("utf-8", "surrogatepass")
        n, chars = max(len(words), 1), max(len(raw), 1)
        capitals = len(raw) - len(raw.translate(None, _CAPITALS))
        digits = len(raw) - len(raw.translate(None, _DIGITS))
        marks = sum(raw.count(m) for m in (b"!", b"?", b".", b",", b"*", b"#", b"@"))
        shouted = sum(map(str.isupper, text.split())) if capitals > 3 else 0
        return [
            float(len(special)), len(special) / n, weight / n, strongest, stems / n, near / n,
            len(you) / n, capitals / chars, shouted / n, raw.count(b"!") / chars, marks / chars,
            digits / chars, (odd + runs) / n, opened / n, log1p(len(words)),
        ]


def with_features(rows: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` and ``vector``."""
    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(batches):
        features = Features(lexicon)
        for batch in batches:
            vectors = pa.array([features.of(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            names = [*batch.schema.names, "vector"]
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=names)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema).withColumn("vector", array_to_vector("vector"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns of ``keep``, per row of ``docs``.

    ``labels`` has doc_id and toxic; labels of held-out ids are not read.
    """
    known = (
        labels.select("doc_id", F.col("toxic").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = known.orderBy(order, "doc_id").limit(sample_rows)
    sample = cut(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
        .groupBy("doc_id", "label")  # and one row of each
        .agg(F.min_by("text", digest("text")).alias("text"))
        .select(
            F.coalesce("text", F.lit("")).alias("text"),
            F.col("label").cast("double").alias("label"),
            (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0).alias("calibrate"),
        )
    )
    mine = {f"_own_{i}": c for i, c in enumerate(keep)}
    out = docs.select(
        F.col("doc_id").alias("_id"),
        F.col("text").alias("_text"),
        *[F.col(c).alias(name) for name, c in mine.items()],
    )

    def shown(rows: DataFrame, score: Column) -> DataFrame:
        return rows.select(
            F.col("_id").alias("doc_id"),
            held_out(F.col("_id")).alias("held_out"),
            score.alias("score"),
            (score >= threshold).cast("int").alias("predicted"),
            *[F.col(name).alias(c) for name, c in mine.items() if c != "doc_id"],
        )

    counts = sample.groupBy("calibrate", (F.col("label") > 0).alias("toxic")).count().collect()
    sizes = {(r["calibrate"], r["toxic"]): r["count"] for r in counts}
    if len(sizes) < 4:  # a class is missing in one of the parts
        toxic, total = sum(n for (_, t), n in sizes.items() if t), sum(sizes.values())
        return shown(out, F.lit(float(toxic / total if total else 0.0)))

    fitting = F.col("calibrate") == F.lit(False)
    lexicon = learn_lexicon(sample.filter(fitting))
    vectors = cut(
        with_features(sample, lexicon).select(
            "label", "calibrate", vector_to_array("vector").alias("vector")
        )
    ).withColumn("vector", array_to_vector("vector"))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=7
    ).fit(vectors.filter(fitting).coalesce(4))

    def margin(rows: DataFrame) -> DataFrame:
        scored = trees.transform(rows)
        return scored.withColumn("margin", vector_to_array("rawPrediction")[1])

    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
        margin(vectors.filter("calibrate")).select("margin", "label")
    )
    scored = isotonic.transform(margin(with_features(out, lexicon, "_text")))
    return shown(scored, F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))

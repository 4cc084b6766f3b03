"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, source string, rank int, vector string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def documents(spark, rows):
    """doc_id and text (and source), with columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "v", "n") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

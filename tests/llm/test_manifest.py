"""The manifest against a plain Merkle tree."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlake.llm.manifest import folded, leaf, manifest, proof


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root, and for every leaf its (left, right) per level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            left = nodes[at - 1] if at % 2 else ""
            right = nodes[at + 1] if at % 2 == 0 and at + 1 < len(nodes) else ""
            paths[i].append((left, right))
        where = [at // 2 for at in where]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    """Multiset of (id, lang, leaf, subroot, root, path)."""
    groups: dict = {}
    for i, lang, text in rows:
        groups.setdefault(lang, []).append((i, sha(framed(i), framed(lang), framed(text))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub, inner = {}, {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub[g], inner[g] = tree([x[1] for x in groups[g]])
    root, outer = tree([sub[g] for g in names])
    return [
        (i, g, one, sub[g], root, tuple(inner[g][k] + outer[n]))
        for n, g in enumerate(names)
        for k, (i, one) in enumerate(groups[g])
    ]


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs = docs.withColumns({"lo": F.lit("x"), "group": F.lit(1), "path": F.lit(2), "_up_lo": F.lit(3)})
    return docs.select("*", leaf(F.col("doc_id"), F.col("lang"), F.col("text")).alias("leaf"))


def rows_of(sizes):
    return [(i, lang, f"text {lang} {i}") for lang, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 2, "b": 1},
        {None: 3, "": 5, "z": 33, "é": 64, "Z": 65, "y": 32},
        {"one": 1057, "two": 31, None: 1},
        {f"l{i}": 1 for i in range(40)},
    ],
)
def test_paths_are_those_of_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    found = manifest(table(spark, rows[::-1]), "doc_id", "lang").collect()
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(None, None, None), (None, "a", ""), (7, "a", "é" * 50_000), (2, "a", None)]
    rows += [(3, "a", "same")] * 70 + [(3, "a", "other"), (4, None, "x")]
    found = manifest(table(spark, rows), "doc_id", "lang").collect()
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_fold_finds_what_has_changed(spark):
    rows = rows_of({"a": 45, None: 7})
    docs = table(spark, rows).withColumn("shown", F.when(F.col("doc_id") == 5, F.sha2(F.lit("else"), 256)).otherwise(F.col("leaf")))
    found = manifest(docs, "doc_id", "lang", carried=["shown"])
    checked = found.select("doc_id", "root", folded(F.col("shown"), F.col("path")).alias("end"), proof(F.col("path")).alias("p"))
    for r in checked.collect():
        assert (r["end"] == r["root"]) == (r["doc_id"] != 5)
    one = next(b for b in brute(rows) if b[0] == 44)
    assert checked.filter("doc_id = 44").first()["p"] == sha(*[x for pair in one[5] for x in pair])


def test_empty_table(spark):
    none = manifest(table(spark, [(1, "a", "x")]).filter(F.lit(False)), "doc_id", "lang")
    assert none.columns == ["doc_id", "lang", "leaf", "path", "subroot", "root"] and none.collect() == []

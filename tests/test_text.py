import pytest

from pairlake.functions import text

OUTPUTS = [
    ("SELECT 7", "SELECT 7;"),
    ("\n SELECT 7;\nSELECT 8;", "SELECT 7;"),
    ("```sql\nSELECT x FROM u;\n```\nThat is it.", "SELECT x FROM u;"),
    ("<think>\nwell; fine\n</think>\nSELECT 'p;q' FROM u", "SELECT 'p;q' FROM u;"),
    ("half a thought; still\n</think>SELECT 3", "SELECT 3;"),
    ('SELECT "m;n" -- k; l\nFROM u;', 'SELECT "m;n" -- k; l\nFROM u;'),
    ("SELECT 4 /* k; l */ + 5; SELECT 6", "SELECT 4 /* k; l */ + 5;"),
    ("SELECT 4 /* open; comment", "SELECT 4 /* open; comment;"),
    ("SELECT 'open; quote", "SELECT 'open; quote;"),
    ("SELECT 8/2 - 1; x", "SELECT 8/2 - 1;"),
    ("```\nSELECT 9", "SELECT 9;"),
    ("", ""),
    (" ;", ""),
]


@pytest.mark.parametrize(("raw", "sql"), OUTPUTS)
def test_clean_sql(one, raw, sql):
    assert one(text.clean_sql, raw) == sql


def test_clean_sql_survives_long_input(one):
    long = "SELECT '" + "a''b " * 100_000 + "' -- " + "x" * 50_000 + "\n + 1; SELECT 2"
    assert one(text.clean_sql, long) == long.split("; SELECT 2")[0] + ";"


@pytest.mark.parametrize(
    ("raw", "sql"),
    [
        ("```sql\nSELECT x,  -- why\n  'p  q'\nFROM u /* w */ WHERE y = 2 ;\nSELECT 3;\n```",
         "SELECT x, 'p  q' FROM u WHERE y = 2;"),
        ("SELECT 'it''s',\t\"a\n b\"", "SELECT 'it''s', \"a\n b\";"),
        ("-- only a comment", ""),
        ("", ""),
    ],
)
def test_one_line(one, raw, sql):
    assert one(text.one_line, raw) == sql


def test_plain_text(one):
    assert one(text.plain_text, " wind‑mill  he’s “in” – x ") == 'wind-mill he\'s "in" - x'


def test_normal_forms(one):
    assert one(text.normalize_question, "How MANY  été_1 are-there?") == "how many été_1 are there"
    assert one(text.normalize_sql, "  SELECT\n\t1 ;\n; ") == "select 1"
    assert one(text.normalize_question, "?!") == ""


def test_jaccard(one):
    score = lambda a, b: text.jaccard(text.token_set(a), text.token_set(b))
    assert one(score, "a b c d", "d c x a") == pytest.approx(3 / 5)
    assert one(score, "", "?") == 1.0
    assert one(score, "", "a") == 0.0
    assert one(score, "a a b", "b a") == 1.0

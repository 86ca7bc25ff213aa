"""Small inline inputs with known answers: texts to grade, calls to describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, text, kind, gold, choices, and what the lenient and the strict reading give: parsed, source, correct; then the confidence.
GRADED: tuple[tuple, ...] = (
    (1, "Two crates hold 21 each.\nANSWER: 42", "int", "42", None, "42", "marker", True, "42", "marker", None),
    (2, "that leaves 58 of them.\nCONFIDENCE: 65", "int", "58", None, "58", "fallback", True, None, "none", 65),
    (3, "Hard to tell from this.\nCONFIDENCE: 58", "int", "58", None, None, "none", False, None, "none", 58),
    (4, "some 31 came\nANSWER: thirty and one", "int", "31", None, "31", "fallback", True, None, "none", None),
    (5, "ANSWER: 8 pears among 70 fruits", "int", "8", None, "8", "marker", True, "8", "marker", None),
    (6, "we began at 15 and stop at 27", "int", "27", None, "27", "fallback", True, None, "none", None),
    (7, "ANSWER: 20,480", "int", "20480", None, "20480", "marker", True, "20480", "marker", None),
    (8, "ANSWER: -3", "int", "-3", None, "-3", "marker", True, "-3", "marker", None),
    (9, "ANSWER: -0012", "int", "-12", None, "-12", "marker", True, "-12", "marker", None),
    (10, "ANSWER: 987654321098765432109876543210", "int", "987654321098765432109876543210", None, "987654321098765432109876543210", "marker", True, "987654321098765432109876543210", "marker", None),
    (11, "ANSWER: \nCONFIDENCE: 64", "int", "64", None, "64", "marker", True, "64", "marker", 64),
    (12, "By the third clue.\nANSWER: Kofi\nCONFIDENCE: 90", "choice", "Kofi", ["Ida", "Kofi", "Bruno"], "Kofi", "marker", True, "Kofi", "marker", 90),
    (13, "which leaves Ida on top", "choice", "Ida", ["Ida", "Kofi"], "Ida", "fallback", True, None, "none", None),
    (14, "ANSWER: it has to be Bruno.", "choice", "Bruno", ["Ida", "Kofi", "Bruno"], "Bruno", "marker", True, "Bruno", "marker", None),
    (15, "Either a knave or a knight would say so.", "choice", "knight", ["knight", "knave", "UNDETERMINED", "NO_SOLUTION"], None, "none", False, None, "none", None),
    (16, "ANSWER: undetermined\nCONFIDENCE: 180", "choice", "UNDETERMINED", ["knight", "knave", "UNDETERMINED", "NO_SOLUTION"], "UNDETERMINED", "marker", True, "UNDETERMINED", "marker", 100),
    (17, "ANSWER: Kofi, Ida", "set", "Ida, Kofi", None, "ida,kofi", "marker", True, "ida,kofi", "marker", None),
    (18, "ANSWER: none", "set", "", None, "", "marker", True, "", "marker", None),
    (19, "ANSWER: Ida and Bruno", "set", "Ida", None, "bruno,ida", "marker", False, "bruno,ida", "marker", None),
    (20, "4 looks fine, yet 6 does not follow.\nANSWER: 6", "justified_choice", "6", None, "6", "marker", True, "6", "marker", None),
    (21, "4 looks fine, yet 6 does not follow.", "justified_choice", "6", None, None, "none", False, None, "none", None),
    (22, "answer = perhaps\nAnswer: certainly", "text", "CERTAINLY", None, "certainly", "marker", True, "certainly", "marker", None),
    (23, "", "int", "1", None, None, "none", False, None, "none", None),
)
GRADED_COLUMNS = "id int, text string, kind string, gold string, choices array<string>, parsed string, source string, correct boolean, strict_parsed string, strict_source string, confidence int"

#: Names of models' endpoints and the services behind them.
ENDPOINTS = (
    ("https://api.openai.example.com/v1", "example"), ("https://openrouter.ai/api/v1", "openrouter"), ("http://localhost:11434/v1", "local"), ("http://127.0.0.1:8000", "local"),
    ("https://www.my-models.io", "my_models"), ("nothing", "local"), ("https://api", "api"),
)


def graded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRADED, GRADED_COLUMNS)


def sql_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(sql_value, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql_rows(rows: tuple[tuple, ...], names: str) -> str:
    """``(VALUES ...) t(names)`` for an oracle."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_value, row)) + ")" for row in rows) + f") t({names})"

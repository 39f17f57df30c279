"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

BASE = " ".join(f"w{k}" for k in range(60)) + "\nthe end of it"
TEXTS = [
    (1, BASE, "en", "a", 1),
    (2, BASE.replace("w59", "x59"), "en", "a", 1),
    (3, BASE, "en", "b", 1),
    (3, BASE, "en", "b", 1),  # a repeated row
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \t\r\n", "en", "c", 4),
    (7, "one", "en", "c", 3),
    (8, "ONE", "en", "c", 3),
    (9, "two words", "en", None, 9),
    (10, "Two  words\n", "en", None, 9),
    (None, "no id here at all", "en", "a", 17),
    (11, "é é ñ ñ ﬁ ß SS ς Σ １２ x y", "fr", "d", 20),
    (12, "long " * 60_000 + "z" * 70_000, "en", "d", 370_000),
    (-5, "don't it's <|endoftext|> 12 ½ 你好 😀", "en", "e", 20),
    (13, "the same line here\n" * 30, "en", "e", 570),
]


def docs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """df with extra columns of these names."""
    for name in names:
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))

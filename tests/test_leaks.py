from pyspark.sql import functions as F

from quire.functions import leaks

NOTES = "Leggi la pagina con la massima cura.\n\nNon inventare nomi\ndi luoghi che non ci sono."


def of(spark, column, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    return [r.r for r in sorted(df.select("i", column(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect(), key=lambda r: r.i)]


def test_without_notes(spark):
    cases = [
        ("# Titolo\n\n## Operator notes\nuna\n\ndue\n## Operator notes\ntre\n# Altro\nfine\n", None, "# Titolo\n\n# Altro\nfine\n"),
        ("a\n**Operator Notes**\nb\n## Operator notes extra\nc", None, "a\n## Operator notes extra\nc"),
        ("a <operator_notes>x\ny</OPERATOR_NOTES>\n\nb", None, "a b"),
        ("a\n***\n| ANNO | EVENTI |\n|-|-|\n***\nb", None, "a\n\nb"),
        ("a\n" + "Leggi la pagina con la massima cura." + "\n\n\n\nb\n", NOTES, "a\n\nb\n"),
        ("<!-- model=m -->\n" + NOTES, NOTES, "<!-- model=m -->"),
        ("a\r\nb", "", "a\nb"),
        ("", NOTES, ""),
        (None, NOTES, None),
        ("## Operator notes\n" + "riga\n" * 200_000, None, ""),
    ]
    assert of(spark, lambda a, b, c: leaks.without_notes(a, b), [(a, b, None) for a, b, _ in cases]) == [w for _, _, w in cases]


def test_has_leak(spark):
    rows = [("x di luoghi che non ci sono. y", NOTES, True), (" ## operator  notes \n", None, True), ("a\n## Operator notes\nb", None, False), ("Please provide the RAW markdown", None, True), ("<operator_notes></operator_notes>", "", True), ("niente", NOTES, False), (None, NOTES, False)]
    assert of(spark, lambda a, b, c: leaks.has_leak(a, b), [(a, b, None) for a, b, _ in rows]) == [w for *_, w in rows]


def test_settled_page(spark):
    long = "parola " * 40
    rows = [("buona", "fonte", NOTES), ("", "fonte", NOTES), (None, None, None), (NOTES + "\nresto", long, NOTES), (NOTES + "\n" + "x" * 120, long, NOTES), ("please provide the raw markdown", "", None)]
    got = [(r.text, r.from_source) for r in of(spark, leaks.settled_page, rows)]
    assert got == [("buona", False), ("fonte", True), ("", False), (long, True), ("x" * 120, False), ("", True)]
    assert of(spark, lambda a, b, c: leaks.meaningful_length(a), [(" a \n\n<!-- x -->\nbc", None, None), (None, None, None)]) == [4, 0]


def test_stage_body(spark):
    rows = [("<!-- model=m -->\na\nb", "m"), ("<!-- model=m -->\na", "n"), ("a\nb", "m"), (" \n", "m"), (None, "m"), ("<!-- model=m -->", "m")]
    assert of(spark, lambda a, b, c: leaks.stage_body(a, b), [(a, b, None) for a, b in rows]) == ["a\nb", None, "a\nb", None, None, ""]

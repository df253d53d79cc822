"""Small awkward tables for the operators' tests."""

PROSE = ("the ship sailed from the old harbour at dawn and nobody on the pier could tell whether the captain knew "
         "about the storm that was gathering behind the northern islands or simply did not care at all")


def awkward_rows():
    near = PROSE.replace("harbour", "port")
    return [
        (0, PROSE, "en", "a", len(PROSE)),
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, PROSE, "en", "b", len(PROSE)),
        (4, PROSE, "en", "b", len(PROSE)),          # a repeated row
        (5, near, "en", "a", len(near)),
        (6, "word", "en", "a", 4),
        (7, "12 34 --", "de", "a", 8),
        (8, " ".join(f"{PROSE} {i}" for i in range(400)), "en", "a", 70000),  # long
        (None, "a row without an id", "en", "a", 19),
        (9, "Der Hund läuft über die Straße und bellt, weil niemand zu Hause ist.", "de", "c", 70),
        (10, "x" * 30000, "de", "c", 30000),
        (11, "déjà vu — ça alors 😀 naïve", "fr", "c", 25),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra: str = ""):
    """The rows as a table in four partitions; ``extra``: names of string columns to add."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4, "doc_id")
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df

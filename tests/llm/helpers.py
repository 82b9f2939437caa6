"""Small tables with the odd cases that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, recipe string, node long, score double, root long"


def documents(spark, rows):
    """Documents from (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "k", 1, "r", 5, 0.5, 3) for i, t in rows], DOCS)


def odd_rows():
    """Null and empty texts, blanks, repeated rows, a null id, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "same words here"), (4, "same words here"), (5, "same  words\there"), (None, "no id at all"), (6, long), (7, long + " end")]

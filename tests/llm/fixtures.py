"""Awkward documents that every operator on texts must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size long, key string, n string, row string, first int, class string, __id int, __text string, __copy int, `a.b` int"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "de", "b"),
    (6, "one", "fr", "b"),
    (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 😀😀 l'été", "de", "b"),
    (8, "word " * 30_000, "en", "a"),
    (9, "x" * 5_000, None, "a"),
    (10, "12 34 !!! ??", None, "c"),
    (6, "one", "fr", "b"),
    (None, "two words", "fr", None),
    (12, "The quick brown fox jumps over the lazy dog today", "en", "a"),
]


def documents(spark, rows=ROWS):
    """The rows with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 0, "fp", 0, "key", "n", "row", 1, "class", 2, "text", 3, 4) for r in rows], SCHEMA)

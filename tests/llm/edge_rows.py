"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, and an extra column of a clashing name."""

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, shard string, score string, rows array<int>"
LONG = "word and more words here " * 5000


def documents(spark, empty=False):
    rows = [] if empty else [
        (1, "a b c d e f g", "en", "s", 13, 7, "x", "y", [1]), (1, "a b c d e f g", "en", "s", 13, 7, "x", "y", [1]),
        (2, "A b C d e f g", None, None, None, None, None, None, None), (3, None, "en", "s", 0, 0, "x", "y", None),
        (4, "", "de", "t", 0, 0, "x", "y", []), (5, " \t\n\x0b ", "de", "t", 4, 0, "x", "y", [2]), (None, "no id at all", "en", None, 1, 1, "x", "y", None),
        (6, LONG, "en", "s", len(LONG), 1, "x", "y", None), (7, "drei\nWörter\n\nhier ###", "de", "t", 1, 1, "x", "y", None), (8, "one two", "en", "u", 1, 1, "x", "y", None),
        (9, "one two", "en", "u", 1, 1, "x", "y", None), (10, "12 34 !!", "fr", "u", 1, 1, "x", "y", None), (11, "日本語 😀 text", "fr", "u", 1, 1, "x", "y", None),
    ]
    return spark.createDataFrame(rows, DOC)


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (1, 1, 0), (3, None, None), (4, 0, 0), (6, 1, 0), (7, 0, 1), (None, 1, 0), (99, 1, 0), (10, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

"""Awkward documents that every operator is tried on."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, sequence_id string, size string"


def awkward(spark):
    long = "lorem ipsum dolor " * 4000
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Café ÀB \U0001f600 über straße 中文 x\x1cy"), (7, long), (8, long),
        (9, "one two three four five"), (9, "one two three four five"), (None, "no id at all here"), (None, None), (10, "a  b\n\n c"), (11, "<|endoftext|> x"),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i == 5 else "s1", None, "x", "y", "z") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

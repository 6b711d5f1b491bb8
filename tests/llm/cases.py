"""Small inputs with every awkward case."""

LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))
KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, _id string, base string"
ROWS = [
    (1, "plain words of a text that is here", "en", "s1", 34, "x", "y", "z"),
    (1, "plain words of a text that is here", "en", "s1", 34, "x", "y", "z"),
    (2, None, None, None, None, None, None, None),
    (None, "", "en", "s2", 0, "x", "y", "z"),
    (None, None, None, None, None, None, None, None),
    (3, "", "fr", "s1", 0, "x", "y", "z"),
    (4, LONG, "en", "s3", len(LONG), "x", "y", "z"),
    (5, " \n\t ", "de", "s2", 4, "x", "y", "z"),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, KIND)


def nothing(spark):
    return spark.createDataFrame([], KIND)

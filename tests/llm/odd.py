"""Documents with every oddity: null columns, empty and long texts, repeated rows, ids of
two texts, and columns whose names clash with those of results."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, fp int, size int, words int, key string"
WORDS = [f"w{k}" for k in range(120)]
LONG = " ".join(f"{w}x{k % 7}" for k in range(400) for w in WORDS[:50])


def rows():
    base = " ".join(WORDS)
    texts = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, LONG), (8, base + " tail"),
        (None, base), (None, None), (9, "é ß 漢字 😀 " * 30), (9, "other text of one id"), (10, "\x00 odd \x1f control   spaces"), (11, "A b\nA b\nA b\n" * 20),
    ]
    langs, sources = ["en", "fr", None], ["s1", None, "s2"]
    return [(i, t, langs[k % 3], sources[k % 3], None if k % 4 == 0 else len(t or ""), 0.5, "x", k, k, k, "k") for k, (i, t) in enumerate(texts)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def counted(values):
    """Rows as a sorted list that nulls don't break."""
    return sorted(values, key=lambda r: tuple((x is None, str(x)) for x in r))

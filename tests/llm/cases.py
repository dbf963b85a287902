"""Small awkward tables shared by the tests."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n, step=1, start=0):
    return " ".join(WORDS[(start + i * step + i * i // 7) % len(WORDS)] + str((i * 13 + start) % 29) for i in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, score double, rank string, id int, key string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None, 0.5, "x", 7, None) for i, t, lang, s in rows], SCHEMA)


def awkward(spark):
    base = prose(120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " one more", "en", None), (3, base + " one more", "en", None),
        (4, None, "en", "a"), (5, "", None, "b"), (6, "  \n\t", "de", "b"), (7, "Hi", "de", "b"), (8, "hi", "de", "b"),
        (9, "two words", "en", "b"), (10, prose(60, 3, 5), "de", "c"), (None, "no id here", None, None),
        (None, base, "en", "a"), (11, "x" * 20_000 + " " + "é" * 3_000, "fr", "c"), (12, prose(4000, 2), "fr", "a"),
        (13, "12 34 -- !!", "fr", "c"), (14, base.upper(), "en", "a"),
    ]
    return docs(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

WORDS = "the quick brown fox jumps over the lazy dog while nine wizards mix a potion of moonlight and rain near old mills".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] for i in range(3000))
BASE = " ".join(WORDS) + " and everyone who saw it said that it was a fine thing to have seen at least once in a life"
NEAR = BASE.replace("once in a life", "once in a year")
SCHEMA = "doc_id long, text string, class string, part int, token string, lang string, source string, n_chars long"


def documents(spark):
    texts = [(1, BASE), (2, None), (3, ""), (None, BASE), (4, NEAR), (5, BASE), (5, BASE), (6, LONG), (7, " \t\n "), (8, "One"), (9, "one"), (10, "é 日本 \U0001f642 naïve"), (12, LONG[:9000] + " tail"), (None, None), (20, "x" * 5000)]
    return spark.createDataFrame([(i, t, "c", 1, "t", None, "s", None) for i, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

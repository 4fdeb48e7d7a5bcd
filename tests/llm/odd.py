"""Documents with nulls, empty and long texts, repeated rows, and columns named like results."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, k int, line string, score string"
PROSE = "The old house of the town was in the middle of a field and it had no roof. " * 12
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.replace("roof", "door", 1), "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, " \n\t ", "de", "b"),
    (7, "Σ!? one", None, "c"),
    (8, "word " * 60000, "en", "c"),
    (9, "x" * 70000, "en", "c"),
    (None, PROSE, "en", "a"),
    (None, None, None, None),
    (10, "Der alte Turm steht am Rand der Stadt.\nEin Satz mit 5 Worten hier.\n\nUnd Ende", "de", "b"),
    (11, "Ein Satz mit 7 Worten hier.\nNeu <|endoftext|>İß\x1c ﬁ́", "de", "b"),
    (11, "another text under the same id", "en", "b"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x", 0, "y", "z") for i, t, l, s in rows], SCHEMA)


def empty(spark):
    return documents(spark, []).where(F.lit(False))

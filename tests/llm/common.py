"""Awkward documents, and pages, for all operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, digest int, h int, kept string, key string, label int"
WORDS = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the river bank at night".split()


def sentence(k, n=60):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str((k + i) % 11) for i in range(n))


def awkward():
    """Nulls, empties, repeats, long texts, ties, odd characters; extra columns that operators use inside."""
    texts = [None, "", " \n", "x", "Ünïcode “q” 🎉 ß", "SAME text here", "same TEXT here", "same text here", "##!!", "word " * 4000, sentence(1), sentence(1), sentence(2, 300), "CC BY 4.0. All rights reserved"]
    rows = [(k, t, ("en", None, "fr")[k % 3], ("a", None, "b", "")[k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(3, "x", "en", "a", 1), (None, None, None, None, None), (None, sentence(3), None, None, None)]
    return [(*r, "u", 1, 2, "k", "y", 3) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)

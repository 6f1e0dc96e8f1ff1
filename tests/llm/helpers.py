"""Small documents with every awkward case the operators must define."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, language string, bits string, id string, chunk string"

LONG = " ".join(f"word{i % 700} filler{i % 31}" for i in range(30_000))


def documents(spark, texts, langs=None):
    """A documents table with extra columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear"),
    (7, "a" * 50_000),
    (8, LONG),
    (9, "naïve café — 日本語 \U0001f600 ﬁn"),
    (None, "no id here"),
    (10, "12345 67890 !!! ???"),
]

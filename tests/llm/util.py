from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consetetur " * 3000
SHARED = "this very passage of more than fifty words recurs in several documents and must be found wherever it stands, " * 2
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today. " + SHARED),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today. " + SHARED),
    (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG + " tail"), (8, "Ümläute é 漢字 😀  double  spaces ▁ mark\n\n\nend"),
    (9, "single"), (10, "x" * 500), (11, "ab" * 400), (12, "Something else. " + SHARED + " and its end."),
    (12, "Something else. " + SHARED + " and its end."), (13, "one two three"), (14, "one two three four"), (15, "ONE two three four"),
]
EXTRA = "n_tokens long, spans string, hit boolean, id long, print long, row long, mark long, key_id long, score double"


def docs(spark, texts=TEXTS):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(i, t, "en", "src", len(t or ""), 1, "s", True, 2, 3, 4, 5, 6, 0.5) for i, t in texts],
        f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}",
    )


def none(spark):
    return docs(spark, [(1, "x")]).where("doc_id < 0")

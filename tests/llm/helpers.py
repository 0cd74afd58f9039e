"""Small corpora with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG_LINE = "This very line is longer than forty code points, é included."


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, sources=None):
    """Documents 0, 1, 2 ... with these texts."""
    rows = [(k, t, "en", (sources or {}).get(k, "a"), len(t) if t is not None else None) for k, t in enumerate(texts)]
    return frame(spark, rows)


def awkward(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, and extra columns with clashing names."""
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    long_text = " ".join(rnd.choices(words, k=30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, long_text, "en", None, len(long_text)), (None, "some text here", None, "b", 14), (4, "tie tie tie", None, "b", 11),
        (5, "tie tie tie", "en", "b", 11), (5, "tie tie tie", "en", "b", 11), (6, LONG_LINE, "en", None, None),
    ]
    from pyspark.sql import functions as F

    made = frame(spark, rows)
    names = ("size", "target", "position", "bucket", "n_words", "kept", "label", "score", "pos", "h1", "words", "rep", "bitmap", "key", "path", "license")
    return made.withColumns({n: F.lit(n) for n in names})


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())

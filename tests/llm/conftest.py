"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def make(spark, tmp_path):
    """Writes tables to a folder: make(documents=rows, ...)."""

    def run(extra=False, **tables):
        schemas = {"documents": DOCS, "pages": PAGES, "benchmark": BENCH, "labels": LABELS, "conversations": TURNS}
        for name, schema in schemas.items():
            df = spark.createDataFrame(tables.get(name, []), schema)
            if extra:
                from pyspark.sql import functions as F

                for c in ("_t", "_w", "_f", "_row", "n_words", "h", "key", "fp", "value", "_d"):
                    df = df.withColumn(c, F.lit("clash"))
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return run


def docs(*texts, sources=None, langs=None):
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, langs[i] if langs else "en", sources[i] if sources else "src0", len(t) if t else 0))
    return out


def prose(n, seed=0, words=400):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


HARD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, prose(60, 1), "en", "a", 1), (4, prose(60, 1), "en", "a", 1), (5, prose(60, 1), "en", "b", 1),
    (None, prose(70, 2), "de", "b", 1), (6, "x", "de", None, 1), (7, "ä ß   日本 😀 #|", "fr", "c/d", 9), (8, "same line here\nsame line here\n\n" * 30, "en", "c/d", 1), (9, prose(20000, 3), "en", "a", 1), (10, "a b " * 3000, "en", "a", 1),
]

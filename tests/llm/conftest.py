import pytest
from pyspark.sql import functions as F

#: Columns whose names the operators use inside, as extra columns of an input.
CLASHING = ("host", "features", "g", "__g", "__doc_id", "__spans", "digest", "place", "rank", "revisit", "words", "first", "bucket", "label", "suffix")


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra: bool = False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if extra else df

    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and very long texts, repeated rows and ids, ties, bytes beyond ASCII, white space of all kinds."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, other = text(150), text(60), text(80)
    near = base.split()
    near[70] = "zz"
    long = text(40_000)
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, text(30) + " " + passage + "\n" + text(30)), (5, passage), (6, "x " + passage + " y"),
        (7, None), (8, ""), (9, " \t\n"), (None, base), (None, None), (10, "A b"), (11, "a  B"), (12, "one"), (13, long), (14, long[:100_000] + " end"), (15, other), (15, text(80)),
        (16, "é" * 200), (17, "é" * 60), (18, "the same words " * 40), (19, other.replace(" ", "\u00a0")), (20, "\x1ca\x0bb\x0cc\rd\te\nf"), (-5, base.upper()),
    ]

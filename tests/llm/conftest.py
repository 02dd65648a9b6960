import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text) pairs, with the other columns filled in."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def clash(spark):
    """The same rows with extra columns named like the operators' own."""

    def make(docs):
        names = (
            "digest kept keep_id node component key gram version id one n first last score own tree "
            "word item_id host path rule verdict chunk tuning url page_id label"
        ).split()
        from pyspark.sql import functions as F

        return docs.withColumns({n: F.lit("x") for n in names if n not in docs.columns})

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a very long text, ties, repeated rows and a null id."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    middle = " ".join(rng.choice(words) for _ in range(150))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, middle), (8, middle),
        (8, middle), (9, middle + " end"), (10, "Ünï çödé ß Σίσυφος İ 🙂 <|endoftext|> x"), (None, "one"),
        (12, long), (13, "a" * 3000), (14, "a" * 3000), (15, "\x00\x01 \x85 tab"),
    ]

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeats, ties, non-ASCII, a long text, and columns with clashing names."""
    import random

    rng = random.Random(5)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    long = "\n".join(" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(600))
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, base), (5, base), (6, base + " tail end"), (7, base.replace("alpha", "omega")), (8, long), (9, long + " x"),
        (10, "é ü ß 日本語 テキスト 😀 " * 20), (11, "A B C D E"), (12, "a b c d e"), (12, "a b c d e"), (None, "no id here at all but five words"), (13, "the same three words the same three words"), (14, base.upper()),
    ]
    return spark.createDataFrame([(i, t, "en", -1, "x", 7) for i, t in rows], "doc_id long, text string, lang string, n int, kept string, comp int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

import pytest

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs home. It sleeps well today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs home. It sleeps well today.", "en", "a"),
    (2, None, None, None),
    (3, "", "de", "b"),
    (4, "ein zwei drei", "de", "b"),
    (5, "Der Hund und die Katze gehen mit dem alten Mann in den dunklen Wald und kommen nicht zurück. " * 40, "de", None),
    (5, "Der Hund und die Katze gehen mit dem alten Mann in den dunklen Wald und kommen nicht zurück. " * 40, "de", None),
    (None, "Home | News | About | Contact | Login\nword", "en", "c"),
    (7, "\U0001F600 é 12 345 +1 (017) 555-7713 x@mail2.example.com", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(*r, len(r[1] or ""), 9, "x", 0.5, 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, score double, size int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

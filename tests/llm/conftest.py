import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "light", "Über", "naïve", "house", "tree", "cloud", "field", "north", "paper", "glass"]


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture
def table(spark):
    """Documents with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", h long, rep long, key string, label string" if extra else "")
        full = [(i, t, "en", "s", len(t or "")) + ((1, 2, "k", "l") if extra else ()) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make

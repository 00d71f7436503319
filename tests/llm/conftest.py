import random

import pytest

CLASHING = "row_key long, row string, kept string, name string, n long, part long, level long, component long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns named like the operators' own."""
    def build(pairs, source=None):
        rows = [(i, t, "en", source(i) if source else f"src{(i or 0) % 3}", len(t) if t is not None else None,
                 7, "x", "y", "z", 1, 2, 3, 4) for i, t in pairs]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        return spark.createDataFrame(rows, schema).repartition(3)
    return build


@pytest.fixture(scope="session")
def prose():
    """Random words; the same seed gives the same words."""
    def build(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]
    return build


@pytest.fixture(scope="session")
def odd_pairs(prose):
    """Nulls, empty and long texts, ties, repeated rows and near copies."""
    base = prose(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    pairs = [(i, " ".join(prose(i, 5 + i % 40))) for i in range(10, 60)]
    pairs += [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base).upper()), (4, " ".join(near)), (5, None), (6, ""),
              (7, "  \n "), (8, "one"), (9, "one two"), (9, "one two"), (9, "three four"), (None, "one two"), (None, None),
              (61, " ".join(prose(7, 6000))), (62, "z" * 9000), (63, " ".join(base * 3))]
    return pairs

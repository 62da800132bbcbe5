import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with columns whose names might clash."""

    def made(rows):
        full = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
PASSAGE = " ".join(f"{w}{k}" for k in range(3) for w in WORDS)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x " * 6000), (6, PASSAGE), (6, PASSAGE), (7, f"begin {PASSAGE} end"), (8, "É é 文字 \U0001f600 a.b@c.de"), (None, PASSAGE), (9, "ten ten ten " * 30)]

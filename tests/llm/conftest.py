import random
import string

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows to documents, with columns whose names the operators also use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, token string, bucket int, pii int"
        return spark.createDataFrame([(i, t, "en", "s", None, "d", 1, "t", 2, 3) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def texts():
    """Some hundred texts: copies, near copies, nulls, empty, odd and long ones."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) + (". " if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    passage = prose(70)
    out = [None, "", " ", "\n\t ", "a", "The", "one two three four", "é漢字🎉 x", "A a A a", "x" * 5000, prose(6000)]
    for _ in range(60):
        out.append(prose(rng.randint(3, 200)))
    base = prose(150)
    for _ in range(40):  # near copies of one text
        w = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    for _ in range(15):  # a passage that many share
        out.append(prose(rng.randint(10, 120)) + " " + passage + " " + prose(rng.randint(10, 120)))
    out += [out[15], out[15], out[15].upper(), out[16].replace(" ", "  \n"), out[17] + " end", None, ""]
    return out

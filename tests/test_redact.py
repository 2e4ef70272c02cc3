"""Redaction in one pass against one finding after the other, and the exact rounding of sizes."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from leaksieve.functions import text as tx
from leaksieve.operators.redact import redact


def fold(text, steps):
    n = 0
    for needle, token in steps:
        if needle and needle in text:
            text, n = text.replace(needle, token, 1), n + 1
    return text, n


def test_the_outcome_is_that_of_one_after_the_other():
    rng = random.Random(4)
    for _ in range(20000):
        letters = "abR1_"[: rng.randint(1, 5)]
        word = lambda m, least=0: "".join(rng.choice(letters) for _ in range(rng.randint(least, m)))  # noqa: E731, B023
        text, steps = word(30), [(word(rng.randint(1, 5)), rng.choice(["", word(4, 1), "R_1", "ab"][rng.random() > 0.02 :])) for _ in range(rng.randint(0, 9))]
        assert redact(text, steps) == fold(text, steps)


def test_many_findings_in_one_text():
    keys = [hashlib.sha256(str(i).encode()).hexdigest()[:24] for i in range(100_000)]
    text = "\n".join(f'password = "{k}"' for k in keys)
    began = time.perf_counter()
    out, n = redact(text, [(k, f"REDACTED_{i % 9}") for i, k in enumerate(keys)])
    assert n == 100_000 and out == "\n".join(f'password = "REDACTED_{i % 9}"' for i in range(100_000)) and time.perf_counter() - began < 60


def test_sizes_and_shares_round_by_their_binary_value(spark):
    def size(n):
        v, u = float(n), 0
        while v >= 1000 and u < 3:
            v, u = v / 1000, u + 1
        return f"{v:.1f} {('B', 'KB', 'MB', 'GB')[u]}" if u else f"{n} B"

    rng = random.Random(1)
    numbers = [*range(2001), *(rng.randrange(10**k) for k in range(4, 19) for _ in range(99)), *(10**k * 115 // 100 for k in range(3, 18)), 999949, 999950]
    assert all(r.s == size(r.n) for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", tx.human_bytes(F.col("n")).alias("s")).collect())
    shares = [*(k / 8 for k in range(64)), *(k / 1000 for k in range(3000)), *(rng.random() * 8 for _ in range(2000))]
    assert all(r.s == f"{r.h:.2f}" for r in spark.createDataFrame([(h,) for h in shares], "h double").select("h", tx.fixed(F.col("h"), 2).alias("s")).collect())

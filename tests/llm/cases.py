"""Inputs that every text operator must take: nulls, empty and long texts, ties, repeated rows, odd column names."""

import random

SCHEMA = "doc_id long, text string, `_chunk` int, `a.b` string, score double, blob string"


def words(seed: int, n: int, size: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def rows() -> list[tuple]:
    a, b, long = words(1, 60), words(2, 45), words(3, 30_000, 5000)
    line = "A line that several documents share, here"
    texts = [
        (1, " ".join(a)), (2, " ".join(a)), (3, " ".join(a[:30] + ["x"] + a[31:])), (4, " ".join(b + a[10:50])), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "One  two"), (10, " ".join(long)),
        (11, f"{line}\nown text of eleven\n  {line.upper()} "), (12, f"{line}\n{line}\nshort"), (13, f"\x0b{line}\x0c\n"), (14, "schön und gut   über ÄÖÜ " + " ".join(b)), (15, " ".join(["same"] * 100)), (16, "x" * 300_000), (None, " ".join(b)), (None, None),
        (17, " ".join(b)), (17, " ".join(b)), (18, "\n\n\n"), (-5, " ".join(a[5:40])), (2**60, "last " + " ".join(a[:25])),
    ]
    return [(i, t, 0, "x", 0.5, "y") for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

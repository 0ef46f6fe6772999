"""Small tables with the awkward cases, and plain-Python word splitting."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, id long, words string, copy int, shard int, hash long, score double"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward(spark, more=()):
    """Nulls, blanks, ties, repeated rows, one long text, and columns whose names the operators use themselves."""
    base = prose(1, 60)
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, "!!! ..."), (4, "word"), (5, base), (6, base), (7, base.upper() + "!"), (8, base.replace("w", "v", 1)), (9, prose(2, 30_000)), (None, base), (11, None), (12, "é ñ 日本語 x"), (13, base), (13, base), *more]
    rows = [(i, t, None if k % 5 == 0 else "xy"[k % 2], None if k % 4 == 0 else f"s{k % 3}", None, k, None, "clash", 7, 9, 1, 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

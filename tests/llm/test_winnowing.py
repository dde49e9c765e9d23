import random
import re

import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import winnow


def plain(text, k, window):
    """(hash, position) of each chosen gram, by the definition."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    one = lambda w: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64(w.encode(), seed=42).intdigest()) % winnow._PRIME
    if not words:
        return []
    if len(words) < k:
        return [(one(" ".join(words)), 0)]
    hashes = [sum(one(w) * winnow._BASE ** (k - 1 - j) for j, w in enumerate(words[i : i + k])) % winnow._PRIME for i in range(len(words) - k + 1)]
    out = []
    for a in range(max(1, len(hashes) - window + 1)):
        best = min((h, -(a + i)) for i, h in enumerate(hashes[a : a + window]))
        if (best[0], -best[1]) not in out:
            out.append((best[0], -best[1]))
    return out


def test_every_window_gives_its_least_gram_the_rightmost_of_ties(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "ÉE", "dd"]) for _ in range(n)) for n in [*range(0, 40), 90, 300]]
    texts += ["same word " * 50, "a " * 30, None, " \t\n", "x" * 50000, texts[20], texts[20]]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "i long, t string, _one string")
    for k, window in ((5, 8), (1, 1), (2, 3), (7, 4), (8, 5)):
        rows = winnow.fingerprints(df.select("i", F.coalesce("t", F.lit("")).alias("t")), "t", "fp", k, window).orderBy("i").collect()
        for t, g in zip(texts, rows, strict=True):
            assert [(v >> 32, winnow._LOW - (v & winnow._LOW)) for v in g.fp] == plain(t or "", k, window), (t, k)


def test_next_rows_over_many_ranges(spark):
    r = random.Random(9)
    ids = [r.randint(0, 10**6) for _ in range(3000)] + [5] * 40 + [None] * 3
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, t string").repartition(5)
    got = {g.t: g.next_t for g in winnow.with_next(df, "id", F.col("t"), ["t"], per=2).collect()}
    order = [t for _, t in sorted(((-1 if i is None else i, f"t{n}") for n, i in enumerate(ids)))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    assert winnow.with_next(df.limit(0), "id", F.col("t"), ["t"]).count() == 0

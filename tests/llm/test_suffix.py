import hashlib
import random

from rasterloom.llm.suffix import remove_repeats


def brute(texts, t):
    data = [(x or "").encode() for x in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - t + 1):
            seen[d[i : i + t]] = seen.get(d[i : i + t], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - t + 1):
            if seen[d[i : i + t]] > 1:
                gone[i : i + t] = [True] * t
        left = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), len(d) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def sample():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = " ".join(word() for _ in range(200))
    texts = [None, "", "a", "aaaaaaaa" * 30, base, base, base[:300], base[100:] + "x" * 90]
    for _ in range(25):
        cut, own = r.randint(0, 700), " ".join(word() for _ in range(40))
        texts.append(own + base[cut : cut + r.randint(10, 200)] + own[::-1] + base[cut : cut + 37])
    return texts


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, x, "q") for i, x in enumerate(texts)], "doc_id long, text string, k1 string")
    rows = remove_repeats(df, **more).collect()
    return [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sorted(rows, key=lambda x: x.doc_id)]


def test_against_brute_force(spark):
    texts = sample()
    for hot in (20000, 3):
        assert run(spark, texts, threshold=40, gram=8, digit=10, spans_in_memory=hot) == brute(texts, 40)


def test_production_parameters_and_empty_table(spark):
    texts = [None, "é" * 99, "é" * 100, "é" * 100, "ab" * 150, "x" * 200, "y" + "x" * 199]
    assert run(spark, texts) == brute(texts, 200)
    assert run(spark, []) == []


def test_text_longer_than_a_batch(spark, monkeypatch):
    from rasterloom.llm import suffix

    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(suffix, "_BATCH", 1000)
    texts = [long, long[4000:4500] + "zz", long[:3000]]
    parts = [p for p in suffix._pieces([x.encode() for x in texts], 40)]
    assert sum(len(p[3]) for p in parts) > len(texts)
    assert run(spark, texts, threshold=40, gram=8, digit=16) == brute(texts, 40)

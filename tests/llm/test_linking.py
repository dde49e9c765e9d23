import random
import re
import time

from pyspark.sql import functions as F

from rasterloom.llm import credentials
from rasterloom.llm.credentials import KINDS, STRONG, WEAK


def plain(t, scope=300):
    """(start, kind, stop) of strong and of all reported parts, by tests of every pair."""
    found = {}
    for kind, (p, group, least) in (STRONG | WEAK).items():
        hits = [m for m in re.finditer(p, t) if len(m[group]) >= least]
        if kind == "key":
            hits = [m for m in hits if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        found[kind] = [(m.start(), KINDS.index(kind), m.end()) for m in hits]
    base = [s for k in STRONG for s in found[k]]
    over = lambda s, o: o[0] < s[2] and s[0] < o[2]
    beside = lambda s, others: any(o[0] <= s[2] + scope and s[0] <= o[2] + scope and not over(s, o) for o in others)
    key = [s for s in found["key"] if not any(over(s, o) for o in base)]
    ids, secrets = found["access"] + found["user"], found["assign"] + found["hex"] + key
    more = [s for s in key if beside(s, ids)] + [s for s in found["user"] if beside(s, secrets)]
    more += [s for s in found["endpoint"] if beside(s, ids) and beside(s, secrets)]
    return sorted(base), sorted(base + more)


def hidden(t, spans, mask="[SECRET]"):
    out, at = [], None
    for a, _, b in spans:
        if at is not None and a <= at:
            at = max(at, b)
            continue
        out.append(t[at or 0 : a])
        at = b
    return mask.join([*out, t[at:]]) if spans else t


def test_links_and_masks_equal_a_test_of_every_pair(spark):
    r = random.Random(6)
    key = "Ab1" + "zQ" * 20
    bits = [f"password={'x' * 9}", "AKIA" + "Q" * 16, "0af3" * 9, key, "username: alice", "https://h.example.com/x?y=1", "éü", "secret=short", "token=" + key, "AKIA" + "0af3" * 9, "login=" + key, "\x01", "𝒳"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "\n", " word " * r.choice([1, 20, 50, 120]), ","]) for _ in range(r.randint(1, 40))) for _ in range(150)]
    texts += ["", " ", None, texts[0], texts[0], (texts[1] + " ") * 40]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, r string")
    for scope in (300, 20):
        got = credentials.scan(df, scope=scope).withColumn("m", credentials.masked(F.col("text"), F.col("secret_spans"))).orderBy("doc_id").collect()
        for t, g in zip(texts, got, strict=True):
            base, every = plain(t or "", scope)
            assert [tuple(s) for s in g.secret_base] == base
            assert [tuple(s) for s in g.secret_spans] == every
            assert g.m == (t if t is None else hidden(t, every))
    assert credentials.scan(df.limit(0)).count() == 0


def test_a_text_of_many_parts_takes_seconds(spark):
    one = f"user: bob1 password={'x' * 9} AKIA{'Q' * 16} https://h.example.com/x Ab1{'zQ' * 20} word word\n"
    text = one * (5_000_000 // len(one))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    begin = time.time()
    got = credentials.scan(df).withColumn("m", credentials.masked(F.col("text"), F.col("secret_spans"))).first()
    assert len(got.secret_spans) == 5 * (len(text) // len(one)) and got.m == hidden(text, [tuple(s) for s in got.secret_spans])
    assert time.time() - begin < 60

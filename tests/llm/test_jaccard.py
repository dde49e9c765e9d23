import random
import re

import numpy as np

from rasterloom.llm import jaccard
from rasterloom.llm.jaccard import join_region, link_documents


def brute(texts):
    sets = []
    for t in texts:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 100 * len(a & b) >= 75 * len(a | b):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [(len(s), root(i), links[i]) for i, s in enumerate(sets)]


def sample(seed, n=140):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 4)))
    line = [word() for _ in range(12)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One two", "x\x0by", "X y", "x y"]
    bases = [[word() for _ in range(r.randint(5, 90))] for _ in range(6)]
    while len(texts) < n:
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = w + line
        if r.random() < 0.2:
            w = [word() for _ in range(r.randint(1, 60))] + line
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        texts.append(" ".join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in w))
    return texts


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, x, "q", 1) for i, x in enumerate(texts)], "doc_id long, text string, k string, n int")
    rows = sorted(link_documents(df, **more).collect(), key=lambda x: x.doc_id)
    return [(x.n_shingles, x.component_id, x.n_links) for x in rows]


def test_against_brute_force(spark):
    for seed, more in ((1, {}), (2, {"most": 6, "often": 3}), (3, {"leaf": 3, "near": 0.0})):
        texts = sample(seed)
        assert run(spark, texts, **more) == brute(texts)


def test_empty_table_and_null_ids(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None), (3, "a b c")], "doc_id long, text string")
    got = sorted(((x.doc_id or -1, x.n_shingles, x.component_id, x.n_links) for x in link_documents(df).collect()), key=str)
    assert got == sorted([(-1, 1, 3, 2), (3, 1, 3, 2), (-1, 0, None, 0), (3, 1, 3, 2)], key=str)


def test_regions_cut_recursively_lose_no_link(monkeypatch):
    sizes, real = [], jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda s: sizes.append(len(s)) or real(s))
    r = np.random.default_rng(4)
    for seed in range(12):
        rng, s = random.Random(seed), []
        centres = [rng.sample(range(2000), 60) for _ in range(8)]
        for _ in range(260):
            c = list(rng.choice(centres))[: rng.randint(20, 60)]
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                c[rng.randrange(len(c))] = rng.randrange(4000)
            s.append(np.unique(np.array(c, np.uint64)))
        copies = r.integers(1, 4, len(s))
        member, other = r.random(len(s)) < 0.7, r.random(len(s)) < 0.8
        want, got = (join_region(s, member, copies, 75, 100, other, ~member, leaf) for leaf in (1 << 20, 8))
        assert (want[1] == got[1]).all() and want[1].any()
        assert [want[0].root(i) for i in range(len(s))] == [got[0].root(i) for i in range(len(s))]
        if seed > 1:
            continue
        plain = np.zeros(len(s), int)
        for i in np.flatnonzero(member):
            for j in np.flatnonzero(other):
                o = len(np.intersect1d(s[i], s[j]))
                if i != j and 100 * o >= 75 * (len(s[i]) + len(s[j]) - o):
                    plain[i] += copies[j]
                    plain[j] += copies[i] * (not member[j])
        assert (plain == got[1]).all()
    # One region uncut, one and its 8 at most: beyond that there are regions of regions.
    assert len(sizes) > 12 * 10 and min(sizes) <= 8 < max(sizes)

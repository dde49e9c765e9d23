import random

import numpy as np

from rasterloom.llm import pii


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "le", "ti", "on", "sch", "á", "ou"]) for _ in range(r.randint(1, 4)))
    return [" ".join(word() for _ in range(r.randint(5, 200))) + r.choice(["", f" {r.randint(1, 9999)} on", " a.b@mail.example.com"]) for _ in range(n)]


def test_forms_that_no_pattern_takes_are_found():
    net = pii.fit(texts(1, 400), steps=400)
    r = np.random.default_rng(3)
    held = [pii.planted(r, t) for t in texts(2, 120)]
    right = wrong = missed = 0
    for (t, made, _), (base, every) in zip(held, pii.tag_texts(net, [t for t, _, _ in held]), strict=True):
        assert base == pii.base_spans(t) and set(base) <= set(every)
        want = {s for s in made if not any(x[1] < s[2] and s[1] < x[2] for x in base)}
        added = set(every) - set(base)
        right, wrong, missed = right + len(want & added), wrong + len(added - want), missed + len(want - added)
    assert right / (right + missed) > 0.8 and right / (right + wrong) > 0.8, (right, wrong, missed)


def test_windows_left_out_of_the_trace_have_no_path_but_outside():
    net = pii.fit(texts(1, 60), steps=30)
    ids = np.random.default_rng(0).integers(0, pii.SYMBOLS, (40, 300))
    ids[:, :200] = np.frombuffer(("er an ti le " * 4)[:40].encode(), np.uint8)[:, None]
    ids[:20, 150:200] = ids[:20, 200:250]
    for shift in (0.0, 3.0, 6.0):
        net.p["b"][0] += shift
        path, gain = net.decode(ids)
        want, want_gain = net._trace(net.emissions(ids))
        some = want.any(0)
        assert (path == want).all() and np.allclose(gain[:, some], want_gain[:, some], atol=1e-4)


def test_odd_tables(spark):
    net = pii.fit([])
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "a@b.cd " * 40000, "z"), (3, "a@b.cd", "z"), (None, "+1 555 123 4567", None)], "doc_id long, text string, kind string")
    got = pii.find(rows, net).collect()
    assert sorted(len(g.pii_base) for g in got) == [0, 0, 0, 1, 1, 40000]
    assert pii.find(rows.limit(0), net).count() == 0

import math
import random
import re
from collections import Counter
from hashlib import md5
from zlib import crc32

import numpy as np
from test_jaccard import brute
from test_linking import hidden, plain


def passes(rows):
    """How often each (doc_id, text, source) is in the mix, by all points of the exponent's grid and one sum over each pass."""
    n = [max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t, _ in rows]
    tokens = Counter()
    for (_, _, s), k in zip(rows, n, strict=True):
        tokens[s] += k
    ln = np.log(np.array(list(tokens.values())) / sum(n))
    e = np.arange((1 << 20) + 1)[:, None] / (1 << 20)
    x = np.exp(e * ln)
    z, s, m = x.sum(1), (x * e * ln).sum(1), np.exp((e - 1) * ln).max(1)
    last = lambda ok: np.flatnonzero(ok).max(initial=0) / (1 << 20)
    by_entropy, by_passes = last(np.log(z) - s / z >= 0.98 * math.log(len(tokens)) - 1e-12), last(m / z > 4)
    a = max(by_entropy, min(1.0, by_passes + 1 / (1 << 20)) if by_passes else 0.0)
    w = np.exp(a * ln) / np.exp(a * ln).sum()
    out = Counter()
    for source, weight in zip(tokens, w, strict=True):
        goal, at, k = round(weight * sum(n)), 0, 0
        own = [(r, c) for r, c in zip(rows, n, strict=True) if r[2] == source]
        while at < goal:
            for r, c in sorted(own, key=lambda x: (md5("|".join(str(v) for v in ("mix", k, x[0][0], x[1]) if v is not None).encode()).hexdigest(), str(x[0][0]), x[1])):
                if at < goal:
                    out[r] += 1
                at += c
            k += 1
    return out


def test_run_equals_a_plain_version_of_all_stages(spark, tmp_path):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    key = "Ab1" + "zQ" * 20
    rows, toxic = [], {}
    for i in range(420):
        w = [word() for _ in range(r.randint(5, 60))]
        toxic[i] = int(i % 5 == 0)
        for _ in range(6 if toxic[i] else 0):
            w.insert(r.randrange(len(w)), r.choice(["zorgon", "zorglex", "vuzzik"]))
        rows.append((i, " ".join(w), "src%d" % min(2, i % 7)))
    for i in range(420, 460):  # copies, near ones and chains of near ones of clean texts
        _, t, s = rows[r.choice([j for j in range(1, len(rows)) if not toxic.get(j)])]
        rows.append((i, t if i % 2 else t + " more", s))
    rows += [(460, f"user: alice password=abcdefgh12 {key} https://h.example.com/x {word()}", "src1"), (461, f"lone {key}", "src2"), (462, "0af3" * 10 + " é token: 12345678", None)]
    rows += [(463, " ".join(word() for _ in range(9000)), "src0"), (464, None, "src1"), (465, "", None), (466, " \n", "src0")]
    r.shuffle(rows)
    d = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()

    # Toxic rows go, held out or not; of each component the smallest id stays; empty texts stay.
    rows = sorted(x for x in rows if not toxic.get(x[0]))
    up = [c for _, c, _ in brute([t for _, t, _ in rows])]
    rows = [x for k, x in enumerate(rows) if up[k] == k]
    assert len(rows) < 380
    rows = [(i, t if t is None else hidden(t, plain(t)[1]), s) for i, t, s in rows]
    assert {i for i, t, _ in rows if t and "[SECRET]" in t} == {460, 462}
    mixed = passes(rows)
    assert max(mixed.values()) > 1
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (i, x, _), k in mixed.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32)
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096 : p * 4096 + 4096]
            want[i, p, p * 4096, len(part), crc32(part.tobytes())] += k
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(g.length for g in got) // 4096) + 1

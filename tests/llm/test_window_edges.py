import numpy as np

from rasterloom.llm import pii


class Marks:
    """Stands for the network: every run of "#" and "7" is a span of the last kind."""

    def decode(self, ids):
        hit = np.isin(ids, pii.symbols("#7"))
        path = np.where(hit, 8, 0)
        path[hit & ~np.vstack([np.zeros((1, ids.shape[1]), bool), hit[:-1]])] = 7
        return path.astype(np.int8), np.where(hit, 1.0, 0.0)


def test_learned_spans_are_found_at_every_alignment():
    for n in (8, 31, 32, 40, 63, 64, 65, 100, 300, 1000):
        mark = ("#7" * n)[:n]
        texts = ["w" * a + " " + mark + " " + "w" * 200 + " #7#7#7#7 " + "w" * b for a in range(0, 70, 3) for b in (0, 90)]
        got = pii.tag_texts(Marks(), texts, batch=64)
        for t, (base, spans) in zip(texts, got, strict=True):
            a, b = t.index("#"), t.rindex("w #7#7#7#7") + 2
            assert not base and spans == [(3, a, a + n), (3, b, b + 8)], (n, a)

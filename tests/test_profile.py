import numpy as np

from rasterloom.plans import catalogue, graph


def test_profile_sizes_covers_every_tile(spark, tmp_path):
    r = np.random.default_rng(3)
    price = {k: float(90000 + 40 * (k % 100) + r.integers(0, 900)) for k in range(3 * 1500)}
    # The last tile ends inside a row, which no method takes.
    price |= {k: 1.0 for k in range(4500, 4650)}
    spark.createDataFrame(list(price.items()), "o_orderkey long, o_totalprice double").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    got = {}
    for x in catalogue.QUERIES["profile_sizes"](spark, str(tmp_path)).collect():
        got.setdefault(x.tile, {})[x.graph] = (x.bytes, x.ratio, x.shannon_pct)
    assert sorted(got) == [0, 1, 2]
    for t, rows in got.items():
        data = np.array([int(price[k]) & 65535 for k in range(t * 1500, (t + 1) * 1500)], np.uint16).tobytes()
        want = {x["graph"]: (x["bytes"], x["ratio"], x["shannon_pct"]) for x in graph.profile_tile(data, 2, 100, reps=1)}
        assert rows == want

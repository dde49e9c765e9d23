import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from rasterloom.plans import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "embeddings")


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, name):
    got = catalogue.QUERIES[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert data or name == "noise_fit"
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert rows(got.columns, data) == rows(cols, cur.fetchall())

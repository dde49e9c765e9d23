from pyspark.sql import functions as F

from rasterloom.llm import credentials


def test_keys_of_any_length_are_linked(spark):
    runs = ["Ab1" + "zQ" * 31, "Ab1" + "zQ" * 42 + "x", "qz" * 50 + "Z" * 200 + "9", "Ab1" + "zQ" * 10000]
    texts = [f"id AKIA{'Q' * 16} value {r}== end" for r in runs]
    texts += [f"lone {runs[1]} end", f"id AKIA{'Q' * 16} value {'q' * 90}Z end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = credentials.scan(df).withColumn("m", credentials.masked(F.col("text"), F.col("secret_spans"))).orderBy("doc_id").collect()
    kinds = [[(credentials.KINDS[s.kind], t[s.start : s.stop]) for s in g.secret_spans] for g, t in zip(got, texts, strict=True)]
    access = ("access", "AKIA" + "Q" * 16)
    assert kinds == [*([access, ("key", r)] for r in runs), [], [access]]
    assert all(r not in g.m for g, r in zip(got, runs, strict=False)) and got[4].m == texts[4]

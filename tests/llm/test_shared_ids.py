def test_texts_that_share_an_id_are_decided_each_for_itself(spark):
    import corpus_pipeline as cp

    base = [" ".join("w%d" % ((i * 7 + j * j) % 97) for j in range(40)) for i in range(12)]
    rows = [(i, base[i]) for i in range(5)]
    # Of each shared id one text links to a smaller id and the other stands alone.
    rows += [(10 + i, base[i] + " more") for i in range(5)] + [(10 + i, base[5 + i]) for i in range(5)]
    rows += [(-3, base[10]), (-3, base[10]), (2, base[10]), (None, base[11]), (None, base[10])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in cp._drop_near_copies(spark, d, "").collect()), key=str)
    want = [*rows[:5], *rows[10:15], (-3, base[10]), (None, base[11])]
    assert got == sorted(want, key=str)

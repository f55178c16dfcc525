"""Repeated ids in the near-copy stage."""

from collections import Counter


def test_texts_that_are_no_copies_stay_under_a_repeated_id(spark):
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (2, ""), (3, three), (3, two), (3, three), (None, one)]
    got = p.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(map(tuple, got.collect())) == Counter([(1, one), (2, two), (2, ""), (3, three), (None, one)])

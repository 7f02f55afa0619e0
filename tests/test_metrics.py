import math

from loomspark.operators import metrics as M


def test_hand_values_and_edges(spark):
    listed = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 10, 3), (2, 5, 4), (3, 1, 1)], "query_id long, id long, rank int")
    expected = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (1, 11), (2, 5), (4, 7), (4, None), (None, 1)], "query_id long, id long")
    got = {r.query_id: tuple(r)[1:] for r in M.quality(listed, expected, 3).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got == {1: (3, round(2 / 3, 6), 0.5, round(dcg / ideal, 6)), 2: (1, 0.0, 0.25, 0.0), 4: (1, 0.0, 0.0, 0.0)}
    assert M.quality(listed.limit(0), expected.limit(0)).count() == 0

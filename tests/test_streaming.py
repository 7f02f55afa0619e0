from datetime import datetime

from loomspark.streaming import windows as S

EVENTS = "at timestamp, kind string, v double, start string"


def test_stream_equals_table(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    first = spark.createDataFrame([(day(1), "a", 1.0, ""), (day(1, 5), "a", 2.0, ""), (day(2), None, None, ""), (None, "a", 9.0, "")], EVENTS)
    late = spark.createDataFrame([(day(1, 6), "a", 4.0, ""), (day(3), "b", 1.0, "")], EVENTS)
    for part in (first, late):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    read = S.stream(spark, str(tmp_path / "in"), first.schema, files_per_trigger=1)
    got = S.drain(S.window_counts(read, "at", "kind", "v", "1 day"))
    whole = S.window_counts(first.unionByName(late), "at", "kind", "v", "1 day")
    rows = {(r.key, r.n, r.total) for r in got.collect()}
    assert rows == {("a", 3, 7.0), (None, 1, None), ("b", 1, 1.0)}
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    read = S.stream(spark, str(tmp_path / "none"), EVENTS)
    assert S.drain(S.window_counts(read, "at", "kind", "v", "1 day")).count() == 0

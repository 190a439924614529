"""Category index tables and sparse rows: any number of values, missing and unseen ones."""

from vigilflow.operators import encoding

SCHEMA = "id long, c string, d int, index string, value string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, d, "x", "y", 1) for i, c, d in rows], SCHEMA)


def test_thousands_of_values_get_their_positions(spark):
    rows = [(i, f"v{i % 2500:05d}", i % 3) for i in range(5000)]
    index = encoding.fit_index(frame(spark, rows), ["c", "d"])
    found = {(r.column_name, r.value): (r["index"], r.rows) for r in index.collect()}
    values = sorted({c for _, c, _ in rows})
    assert found == {("c", v): (i, 2) for i, v in enumerate(values)} | {("d", str(k)): (2500 + k, sum(d == k for *_, d in rows)) for k in range(3)}
    encoded = encoding.encode(frame(spark, rows), index, ["c", "d"])
    assert encoded.columns == ["id", "c", "d", "index", "value", "part", "categories"]
    assert {(r.id, r.categories.size, tuple(r.categories.indices)) for r in encoded.collect()} == {(i, 2503, (values.index(c), 2500 + d)) for i, c, d in rows}


def test_missing_unseen_and_repeated_rows(spark):
    index = encoding.fit_index(frame(spark, [(1, "b", None), (2, "a", None), (3, None, None)]), ["c", "d"])
    assert [tuple(r) for r in encoding.modes(index).collect()] == [("c", "a", 2)]  # of equally frequent ones the smaller
    rows = frame(spark, [(1, None, None), (2, "new", 7), (3, "b", 1), (3, "b", 1)])
    found = sorted((r.id, r.c, tuple(r.categories.indices)) for r in encoding.encode(rows, index, ["c", "d"]).collect())
    assert found == [(1, "a", (0,)), (2, "new", ()), (3, "b", (1,)), (3, "b", (1,))]


def test_empty_tables(spark):
    none = frame(spark, [])
    index = encoding.fit_index(none, ["c"])
    assert index.count() == encoding.modes(index).count() == encoding.encode(none, index, ["c"]).count() == 0
    assert [tuple(r.categories.indices) for r in encoding.encode(frame(spark, [(1, "a", 1)]), index, ["c"]).collect()] == [()]

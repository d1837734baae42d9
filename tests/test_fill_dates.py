"""Days made between those of a series."""

import datetime as dt

from tideline.operators import seasonal

D = lambda n: dt.date(2024, 2, 27) + dt.timedelta(days=n)


def test_days_between(spark, capsys):
    rows = [
        ("a", D(0), 1, "x"), ("a", D(4), 2, None), ("a", D(3), None, "y"),
        # a day with several rows, in the middle and at the end; a row without a day; a series without any; a null key
        ("b", D(1), 3, "p"), ("b", D(1), 4, "q"), ("b", D(3), 5, "r"), ("b", D(3), 5, "r"), ("b", None, 6, "s"),
        ("c", None, 7, "t"), ("d", D(2), 8, "u"), (None, D(5), 9, "v"), (None, D(7), 10, "w"),
    ]
    daily = spark.createDataFrame(rows, "k string, d date, n long, note string")
    out = seasonal.fill_dates(daily, ["k"])
    assert out.columns == ["k", "d", "n", "note"]
    want = [r for r in rows if r[1]] + [("a", D(1), None, None), ("a", D(2), None, None), ("b", D(2), None, None), (None, D(6), None, None)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert seasonal.fill_dates(daily.where("false"), ["k"]).collect() == []
    # made days are neither shuffled nor joined
    out.explain()
    assert "Join" not in capsys.readouterr().out


def test_several_keys(spark):
    rows = [(1, "x", D(0), 1.0), (1, "y", D(9), 2.0), (1, "x", D(2), 3.0), (2, "x", D(1), 4.0)]
    out = seasonal.fill_dates(spark.createDataFrame(rows, "i int, s string, at date, v double"), ["i", "s"], "at")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([*rows, (1, "x", D(1), None)], key=repr)

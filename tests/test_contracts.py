"""A JSON schema as columns, and the contract of a matrix."""

import datetime as dt
import json

import pytest

from tideline.operators import contracts
from tideline.plans.daily_queries import SIGNALS_SCHEMA

GOOD = {"asof": "2024-01-01T00:00:00Z", "index": 1, "change": -0.5, "direction": {"prob_up": 0.5, "top_decile": False}, "nowcast": {"2024-01-01": 2}, "annotations": []}


@pytest.mark.parametrize(
    "document, want",
    [
        (GOOD, []),
        (GOOD | {"direction": None}, []),
        (GOOD | {"index": None}, ["$.index: not number"]),
        (GOOD | {"index": True}, ["$.index: not number"]),
        (GOOD | {"direction": {"prob_up": -0.1, "top_decile": 1, "more": 2}}, ["$.direction.prob_up: beyond minimum", "$.direction.top_decile: not boolean", "$.direction: more not allowed"]),
        (GOOD | {"nowcast": {"2024-01-01": "x", "2024-01-02": 1}}, ["$.nowcast.^[0-9]{4}-[0-9]{2}-[0-9]{2}$: not number"]),
        (GOOD | {"annotations": ["a", 1, None]}, ["$.annotations[]: not string"]),
        ({}, ["$: asof missing", "$: change missing", "$: index missing"]),
        ([1], ["$: not object"]),
        ("not json", ["$: no JSON"]),
        (None, ["$: no JSON"]),
    ],
)
def test_violations(spark, document, want):
    text = document if document is None or document == "not json" else json.dumps(document)
    df = spark.createDataFrame([(text,)], "t string")
    assert contracts.with_violations(df, SIGNALS_SCHEMA, "t").first().violations == want


def test_integers_enums_and_unknown_words(spark):
    df = spark.createDataFrame([('{"a": 2, "b": "x"}',), ('{"a": 2.5, "b": "z"}',), ('{"a": 3.0, "b": 1}',)], "t string")
    schema = {"properties": {"a": {"type": "integer"}, "b": {"enum": ["x", "y"]}}}
    assert [r.violations for r in contracts.with_violations(df, schema, "t").collect()] == [[], ["$.a: not integer", "$.b: not of the enum"], ["$.b: not of the enum"]]
    with pytest.raises(ValueError, match="oneOf"):
        contracts.with_violations(df, {"oneOf": []}, "t")


def test_matrix_and_columns(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, day(1), 1.0, None), (2, day(3), -8.5, 99.0), (3, day(2), None, 0.0), (4, None, float("nan"), 0.0), (5, day(4), 8.0, 0.0), (6, day(4), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, d date, a double, b double")
    found = {(r.d, r.column, r.problem) for r in contracts.matrix_report(df, "d", "i", ["a"], ["b"]).collect()}
    assert found == {
        (day(3), "a", "outside its bounds"), (day(2), "d", "not after the dates before"), (day(2), "a", "missing"), (None, "d", "missing"), (None, "a", "missing"), (day(4), "d", "not after the dates before"),
    }
    told = {tuple(r) for r in contracts.column_report(df, {"d": "date", "a": "float", "c": "double", "i": "int"}).collect()}
    assert told == {("c", "missing"), ("b", "not expected"), ("a", "is double, not float")}
    assert contracts.column_report(df, dict(df.dtypes)).count() == 0

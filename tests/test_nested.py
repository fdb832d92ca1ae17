import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators import nested

SCHEMA = "record_id long, walls string, spaces string, path string, kind string"


def kids(spark, *rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in nested.model_children(df).collect())


def test_places_in_order(spark):
    walls = [{"points": None, "geometry": {"points": [[0, 0], None, [1, 1]]}}, {"points": [], "geometry": {"points": [[5, 5]]}}, None, 7, {"points": "a", "geometry": {"points": [[1]]}}]
    spaces = [{"boundary": [[1, 2]], "geometry": {"boundary": [[3]]}, "neighbors": ["a", None, "a"]}, {"polygon": {"x": 1}}, [[1]]]
    assert kids(spark, (1, json.dumps(walls), json.dumps(spaces))) == [
        (1, "space", 0, "neighbor", 0),
        (1, "space", 0, "neighbor", 2),
        (1, "space", 0, "point", 0),
        (1, "wall", 0, "point", 0),
        (1, "wall", 0, "point", 2),
    ]


def test_single_object_is_a_list_of_one(spark):
    assert kids(spark, (1, '{"points": [1, 2], "related_spaces": ["q"]}', None)) == [(1, "wall", 0, "point", 0), (1, "wall", 0, "point", 1), (1, "wall", 0, "related_space", 0)]


@pytest.mark.parametrize("bad", ["", " ", "[", '[{"points": [1]}', '[{"points": [1]}] x', "[1,]", '{"points": [NaN]}', "{'points': [1]}", '[{"points": [01]}]', "nope"])
def test_broken_text_gives_no_rows_but_the_other_column_does(spark, bad):
    assert kids(spark, (1, bad, '[{"polygon": [1]}]')) == [(1, "space", 0, "point", 0)]


def test_nulls_repeats_and_empty_tables(spark):
    assert kids(spark, (None, None, None), (1, "[]", "null"), (1, "[]", "[]")) == []
    one = '[{"points": [1]}]'
    assert kids(spark, (2, one, None), (2, one, None)) == [(2, "wall", 0, "point", 0)]
    assert nested.model_children(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nested.model_points(spark.createDataFrame([], SCHEMA)).count() == 0


def test_points_and_owners(spark):
    walls = json.dumps([{"uuid": "a", "thickness": 1.50, "points": [[1, 2.25], {"y": 4, "x": 3, "z": None}, ["a", True]]}])
    df = spark.createDataFrame([(1, walls, "[{}]", "", "")], SCHEMA)
    assert [tuple(r)[2:] for r in nested.model_points(df).orderBy("child_ord").collect()] == [(0, 0, 1.0, 2.25, None), (0, 1, 3.0, 4.0, None), (0, 2, None, None, None)]
    got = {r["owner_kind"]: r for r in nested.model_owners(df).collect()}
    assert got["wall"]["thickness"] == "1.5" and got["space"]["uuid"] is None


def test_references_and_other_groups(spark):
    walls = json.dumps([{"related_spaces": ["q", None, 7, {"uuid": "r"}], "source": {"layer": "A", "block": None, "ancestry": ["b1", None, "b2"]}, "geometry": {"length": 2.5}}, None, {"source": 3}])
    spaces = json.dumps([{"related_walls": ["w"], "neighbors": ["n", "n"], "tags": {"use": "u", "finish": [{"mat": "m", "layer": 1}, None, "x"]}, "geometry": {"holes": [[], [[1, 2], None, {"x": 3, "y": 4}]]}}])
    df = spark.createDataFrame([(1, walls, spaces, "", "")], SCHEMA)
    got = lambda f: sorted((tuple(r)[1:] for r in f(df).collect()), key=repr)
    assert got(nested.model_references) == [
        ("space", 0, "neighbor", 0, "n"), ("space", 0, "neighbor", 1, "n"), ("space", 0, "related_wall", 0, "w"),
        ("wall", 0, "related_space", 0, "q"), ("wall", 0, "related_space", 2, "7"), ("wall", 0, "related_space", 3, None),
    ]
    assert got(nested.model_ancestry) == [("wall", 0, 0, "b1"), ("wall", 0, 2, "b2")]
    assert got(nested.model_finishes) == [("space", 0, 0, "m", "1"), ("space", 0, 2, None, None)]
    assert got(nested.model_holes) == [("space", 0, 1, 0, 1.0, 2.0, None), ("space", 0, 1, 2, 3.0, 4.0, None)]
    assert got(nested.model_details) == [("space", 0, None, None, "u", None), ("wall", 0, "A", None, None, "2.5"), ("wall", 2, None, None, None, None)]


def test_deep_and_long_texts(spark):
    deep = '[{"points": [1], "x": ' + "[" * 20_000 + "]" * 20_000 + "}]"
    long = json.dumps([{"points": [[i, i] for i in range(60_000)]}])
    assert len(kids(spark, (1, deep, None))) == 1
    assert len(kids(spark, (1, long + " " * nested.WHOLE_CHARS, None))) == 60_000


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(values)
def test_deep_parser_agrees_with_the_scanner(value):
    text = json.dumps(value)
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got, end = nested._deep_value(text, 0)
    assert end == len(text) and got == plain(value)
    assert list(nested.stream_items(text)) == (plain(value) if isinstance(value, list) else [plain(value)])
